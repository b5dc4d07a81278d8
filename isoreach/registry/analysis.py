"""Statistics, reshaping, ordering and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import naming, text
from isoreach.operators import geometry as g
from isoreach.operators import reshape, stats
from isoreach.plans import analysis, metrics
from isoreach.registry import REGISTRY
from isoreach.registry.core import CUMULATIVE, CUTS, EXTRA, NEAREST, duck, wide_access
from isoreach.session import materialise

IDS = ["mode", "time_of_day", "from_id"]
MORNING = "(time_of_day IS NULL OR time_of_day = 'am')"


def relative(spark, sf_dir):
    """The reports start from stored measures, as they are read more than once."""
    access, land_use = wide_access(spark, sf_dir, nearest={})
    return metrics.relative_long(materialise(access, "access"), land_use, CUMULATIVE)


def nearest_long(spark, sf_dir):
    return reshape.nearest_to_long(materialise(wide_access(spark, sf_dir, cumulative={})[0], "nearest"), IDS)


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def quantiles(value: str, names: dict[str, float], digits: int = 6) -> str:
    return ", ".join(f"ROUND(QUANTILE_CONT(CAST({value} AS DOUBLE), CAST({p} AS DOUBLE)), {digits}) AS {n}" for n, p in names.items())


# --- reshaping ---


@REGISTRY.add(
    "R01_unpivot_split",
    duck(
        "\nUNION ALL ".join(
            f"SELECT mode, time_of_day, from_id, '{s}' AS service, {c} AS time_cut, CAST({naming.access_name(s, c)} AS DOUBLE) AS accessibility FROM q_access"
            for s in CUMULATIVE
            for c in CUTS
        )
    ),
)
def r01(spark, sf_dir):
    access = wide_access(spark, sf_dir, nearest={})[0]
    doubles = access.withColumns({c: F.col(c).cast("double") for c in naming.starts_with(access, "access")})
    return reshape.access_to_long(doubles, IDS)


@REGISTRY.add("R02_unpivot", duck("SELECT mode, time_of_day, from_id, service, tt_minutes FROM q_nearest_long"))
def r02(spark, sf_dir):
    return nearest_long(spark, sf_dir)


_LAND = (
    "employment_all", "employment_promo_1", "employment_standard_2", "employment_economy_3", "hospitals", "gp_practices",
    "main_bua", "park_ha", "park_accesspoints",
)


@REGISTRY.add(
    "R03_totals_long",
    duck("\nUNION ALL ".join(f"SELECT '{c}' AS destination, CAST(SUM({c}) AS DOUBLE) AS total_23 FROM f_landuse" for c in _LAND)),
)
def r03(spark, sf_dir):
    return stats.totals_long(fx.view(spark, sf_dir, "f_landuse"), list(_LAND), "destination", "total_23")


@REGISTRY.add(
    "R04_pivot",
    duck(
        "SELECT from_id, MAX(CASE WHEN mode = 'bicycle' THEN nearest_hospitals END) AS bicycle,"
        " MAX(CASE WHEN mode = 'pt' THEN nearest_hospitals END) AS pt, MAX(CASE WHEN mode = 'walk' THEN nearest_hospitals END) AS walk"
        f" FROM q_nearest WHERE {MORNING} GROUP BY from_id"
    ),
)
def r04(spark, sf_dir):
    nearest = analysis.morning_only(wide_access(spark, sf_dir, {}, {"hospitals": "hospitals"})[0])
    return reshape.to_wide(nearest, ["from_id"], "mode", list(analysis.MODES), "nearest_hospitals")


# --- stacking ---


@REGISTRY.add(
    "U01_union_by_name",
    fx.duck_sql(
        "SELECT CAST(practice_code AS VARCHAR) AS source_id, name, postcode, CAST(NULL AS VARCHAR) AS brand FROM f_practice"
        " UNION ALL SELECT CAST(id AS VARCHAR), name, NULL, brand FROM f_named"
    ),
)
def u01(spark, sf_dir):
    a = fx.view(spark, sf_dir, "f_practice").select(F.col("practice_code").cast("string").alias("source_id"), "name", "postcode")
    b = fx.view(spark, sf_dir, "f_named").select(F.col("id").cast("string").alias("source_id"), "name", "brand")
    return reshape.stack(a, b)


@REGISTRY.add("U02_union_labelled", duck("SELECT mode, time_of_day, from_id, to_id, travel_time FROM f_ttm"))
def u02(spark, sf_dir):
    ttm = fx.view(spark, sf_dir, "f_ttm")
    slices = {m: ttm.filter(F.col("mode") == m).drop("mode") for m in analysis.MODES}
    return reshape.stack_labelled(slices, "mode")


@REGISTRY.add(
    "U03_union_many_shapes",
    duck(
        "SELECT from_id, mode, service, tt_minutes FROM q_nearest_long"
    ),
)
def u03(spark, sf_dir):
    wide = materialise(wide_access(spark, sf_dir, cumulative={})[0], "nearest")
    parts = [reshape.nearest_to_long(wide.select("from_id", "mode", f"nearest_{s}"), ["from_id", "mode"]) for s in NEAREST]
    return reshape.stack(*parts)


# --- aggregates ---


@REGISTRY.add("A01_count_by_key", fx.duck_sql("SELECT zone_id, COUNT(*) AS gp_practices FROM f_poi WHERE service = 'gp_practices' GROUP BY zone_id"))
def a01(spark, sf_dir):
    return stats.count_by(fx.view(spark, sf_dir, "f_poi").filter(F.col("service") == "gp_practices"), "zone_id", "gp_practices")


@REGISTRY.add("A02_sum_by_key", fx.duck_sql("SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS size, ROUND(SUM(p_retailprice), 4) AS price FROM part GROUP BY 1"))
def a02(spark, sf_dir):
    sums = fx.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("size"), F.sum("p_retailprice").alias("price"))
    return rounded(sums, ["price"], 4)


@REGISTRY.add(
    "A03_global_sums",
    duck(f"SELECT {', '.join(f'CAST(SUM({c}) AS DOUBLE) AS {c}' for c in _LAND)} FROM f_landuse"),
)
def a03(spark, sf_dir):
    totals = stats.column_totals(fx.view(spark, sf_dir, "f_landuse"), list(_LAND))
    return totals.select([F.col(c).cast("double").alias(c) for c in totals.columns])


@REGISTRY.add(
    "A05_distribution",
    fx.duck_sql(
        "SELECT p_type, ROUND(AVG(p_retailprice), 6) AS price_mean, ROUND(STDDEV_SAMP(p_retailprice), 6) AS price_sd,"
        " CAST(SUM(CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS price_n_null, "
        + quantiles("p_retailprice", {"price_q1": 0.25, "price_median": 0.5, "price_q3": 0.75})
        + " FROM part GROUP BY p_type"
    ),
)
def a05(spark, sf_dir):
    result = stats.distribution(fx.table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", "price")
    return rounded(result, ["price_mean", "price_sd", "price_q1", "price_median", "price_q3"])


@REGISTRY.add("A06_distinct", fx.duck_sql("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer"))
def a06(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@REGISTRY.add(
    "A08_nulls",
    fx.duck_sql(
        "SELECT status, CAST(COUNT(*) - COUNT(name) AS BIGINT) AS name, CAST(COUNT(*) - COUNT(postcode) AS BIGINT) AS postcode"
        " FROM f_practice GROUP BY status"
    ),
)
def a08(spark, sf_dir):
    return stats.null_counts(fx.view(spark, sf_dir, "f_practice"), ["name", "postcode"], ["status"])


@REGISTRY.add("A09_flag_tally", fx.duck_sql("SELECT phase = 'Primary' AS flag, COUNT(*) AS n FROM f_school WHERE phase IS NOT NULL GROUP BY 1"))
def a09(spark, sf_dir):
    flags = fx.view(spark, sf_dir, "f_school").select((F.col("phase") == "Primary").alias("flag"))
    return stats.count_by(flags.filter(F.col("flag").isNotNull()), "flag")


_PROFILED = {"p_size": "CAST(p_size AS DOUBLE)", "p_retailprice": "p_retailprice", "p_partkey": "CAST(p_partkey AS DOUBLE)"}


@REGISTRY.add(
    "A10_profile",
    fx.duck_sql(
        "\nUNION ALL ".join(
            f'SELECT \'{c}\' AS "column", ROUND(MIN({e}), 6) AS "min", ROUND(AVG({e}), 6) AS mean, ROUND(MAX({e}), 6) AS "max",'
            f" CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_null, {quantiles(e, stats.QUARTILES)} FROM part"
            for c, e in _PROFILED.items()
        )
    ),
)
def a10(spark, sf_dir):
    result = stats.profile(fx.table(spark, sf_dir, "part"), list(_PROFILED))
    return rounded(result, ["min", "mean", "max", *stats.QUARTILES])


_FENCED = """
    SELECT v.event_type, q.q1, q.median, q.q3, CAST(MIN(CASE WHEN v.value BETWEEN lo AND hi THEN v.value END) AS DOUBLE) AS whisker_low,
           CAST(MAX(CASE WHEN v.value BETWEEN lo AND hi THEN v.value END) AS DOUBLE) AS whisker_high,
           CAST(SUM(CASE WHEN v.value BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outside
    FROM events v JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
        SELECT event_type, QUANTILE_CONT(value, CAST(0.25 AS DOUBLE)) AS q1, QUANTILE_CONT(value, CAST(0.5 AS DOUBLE)) AS median,
               QUANTILE_CONT(value, CAST(0.75 AS DOUBLE)) AS q3 FROM events GROUP BY 1) f) q ON q.event_type = v.event_type
    GROUP BY ALL"""


@REGISTRY.add(
    "A12_boxplot",
    f"SELECT event_type, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, whisker_low, whisker_high, n_outside FROM ({_FENCED}) b",
)
def a12(spark, sf_dir):
    return rounded(stats.box_statistics(fx.table(spark, sf_dir, "events"), ["event_type"], "value"), list(stats.QUARTILES))


@REGISTRY.add(
    "A13_hexbin",
    fx.duck_sql(
        """SELECT cx, cy, COUNT(*) AS n FROM (
             SELECT CASE WHEN d1 <= d2 THEN i1 ELSE i2 + 0.5 END AS cx, CASE WHEN d1 <= d2 THEN j1 ELSE j2 + 0.5 END AS cy FROM (
               SELECT *, (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1) AS d1,
                      (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5) AS d2 FROM (
                 SELECT u, v, FLOOR(u + 0.5) AS i1, FLOOR(v + 0.5) AS j1, FLOOR(u) AS i2, FLOOR(v) AS j2 FROM (
                   SELECT (p.x - FLOOR(e.x0 / e.w) * e.w) / e.w AS u, (p.y - FLOOR(e.y0 / e.h) * e.h) / (e.h * SQRT(CAST(3 AS DOUBLE))) AS v
                   FROM f_point p, (SELECT MIN(x) AS x0, (MAX(x) - MIN(x)) / 70 AS w, MIN(y) AS y0, (MAX(y) - MIN(y)) / 90 AS h FROM f_point) e
                 ) a) b) c) d GROUP BY 1, 2"""
    ).replace("i2 + 0.5", "i2 + CAST(0.5 AS DOUBLE)").replace("j2 + 0.5", "j2 + CAST(0.5 AS DOUBLE)"),
)
def a13(spark, sf_dir):
    return stats.hex_bins(fx.view(spark, sf_dir, "f_point"), "x", "y", (70, 90))


_LOG = {
    "f_log": """SELECT event_id AS step, CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, ts AS started,
                       value AS minutes FROM {events}"""
}


@REGISTRY.add(
    "A14_run_log",
    fx.duck_sql(
        """SELECT COUNT(*) AS steps, CAST(SUM(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
                  CAST(SUM(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed, MIN(minutes) AS min_minutes,
                  MAX(minutes) AS max_minutes, ROUND(AVG(minutes), 6) AS mean_minutes, ROUND(SUM(minutes), 4) AS total_minutes,
                  (SELECT step FROM f_log ORDER BY minutes, step LIMIT 1) AS fastest_step,
                  (SELECT step FROM f_log ORDER BY minutes DESC, step LIMIT 1) AS slowest_step FROM f_log""",
        _LOG,
    ),
)
def a14(spark, sf_dir):
    log = fx.spark_sql(spark, sf_dir, "SELECT * FROM f_log", _LOG)
    result = stats.run_log_summary(log, "step", "status", "minutes")
    return result.withColumns({"mean_minutes": F.round("mean_minutes", 6), "total_minutes": F.round("total_minutes", 4)})


@REGISTRY.add(
    "A04_share_of_total",
    fx.duck_sql(
        "SELECT SUBSTRING(lsoa11, 1, 1) AS region, ROUND(SUM(lat), 6) AS emp, ROUND(SUM(lat) / (SELECT SUM(lat) FROM f_postcode), 6) AS percent"
        " FROM f_postcode GROUP BY 1"
    ),
)
def a04(spark, sf_dir):
    codes = fx.view(spark, sf_dir, "f_postcode")
    return rounded(stats.share_of_total(codes, text.first_letter("lsoa11"), "region", "lat", "emp", "percent"), ["emp", "percent"])


# --- order ---


@REGISTRY.add(
    "W01_rank_cities",
    fx.duck_sql(
        "SELECT c_custkey, c_acctbal, r AS pop_ranking, CASE WHEN r < 25 THEN 'city' ELSE 'other' END AS city_large FROM"
        " (SELECT *, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t"
    ),
)
def w01(spark, sf_dir):
    return analysis.ranked_cities(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")


@REGISTRY.add(
    "O01_sort",
    fx.duck_sql("SELECT pcds, doterm FROM f_postcode ORDER BY doterm ASC NULLS LAST, pcds"),
)
def o01(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_postcode").select("pcds", "doterm").orderBy(F.asc_nulls_last("doterm"), "pcds")


@REGISTRY.add(
    "O02_top_brands",
    fx.duck_sql("SELECT brand, COUNT(*) AS n FROM f_named WHERE brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 20"),
)
def o02(spark, sf_dir):
    return stats.most_frequent(fx.view(spark, sf_dir, "f_named"), "brand", 20)


@REGISTRY.add(
    "O03_order_by_median",
    fx.duck_sql(
        "SELECT event_type, ROUND(m, 6) AS median, ROW_NUMBER() OVER (ORDER BY m DESC, event_type) AS position FROM"
        " (SELECT event_type, QUANTILE_CONT(value, CAST(0.5 AS DOUBLE)) AS m FROM events GROUP BY 1) t"
    ),
)
def o03(spark, sf_dir):
    return rounded(analysis.order_by_median(fx.table(spark, sf_dir, "events"), "event_type", "value"), ["median"])


# --- reports ---


@REGISTRY.add(
    "L07_mode_ratio",
    duck(
        """SELECT *, ROUND(bicycle / NULLIF(pt, 0), 6) AS pt_bike_diff, CASE WHEN bicycle > pt THEN 'bike' WHEN bicycle <= pt THEN 'pt' END AS bike
           FROM (SELECT from_id, service, time_cut, MAX(CASE WHEN mode = 'bicycle' THEN accessibility END) AS bicycle,
                        MAX(CASE WHEN mode = 'pt' THEN accessibility END) AS pt, MAX(CASE WHEN mode = 'walk' THEN accessibility END) AS walk
                 FROM q_relative_long WHERE """
        + MORNING
        + " GROUP BY 1, 2, 3) t"
    ),
)
def l07(spark, sf_dir):
    return rounded(analysis.mode_ratio(relative(spark, sf_dir), "from_id"), ["pt_bike_diff"])


_REGIONS = f"""
    SELECT r.*, ROUND(bicycle / NULLIF(pt, 0), 6) AS pt_bike_diff, CASE WHEN bicycle > pt THEN 'bike' WHEN bicycle <= pt THEN 'pt' END AS bike,
           s.s_name AS lad17nm, n.n_name AS rgn11nm, z.zone_id AS ttwa, c.pop_ranking,
           CASE WHEN c.pop_ranking IS NULL THEN NULL WHEN c.pop_ranking < 25 THEN 'city' ELSE 'other' END AS city_large
    FROM (SELECT from_id AS geo_code, service, time_cut, MAX(CASE WHEN mode = 'bicycle' THEN accessibility END) AS bicycle,
                 MAX(CASE WHEN mode = 'pt' THEN accessibility END) AS pt, MAX(CASE WHEN mode = 'walk' THEN accessibility END) AS walk
          FROM q_relative_long WHERE {MORNING} AND service = 'employment_all' AND time_cut IN (30, 60) GROUP BY 1, 2, 3) r
    JOIN supplier s ON s.s_suppkey = r.geo_code JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_name = 'NATION_3'
    LEFT JOIN f_point p ON p.id = r.geo_code LEFT JOIN f_zonepoly z ON p.x BETWEEN z.xa AND z.xb AND p.y BETWEEN z.ya AND z.yb
    LEFT JOIN (SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY pop DESC, n_nationkey) AS pop_ranking
               FROM (SELECT n_nationkey, COUNT(c_custkey) AS pop FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) t) c
      ON c.n_nationkey = z.zone_id"""


@REGISTRY.add("L07_regions", duck(_REGIONS))
def l07_regions(spark, sf_dir):
    """Modes side by side in one region, with district, travel-to-work area and size class."""
    supplier, nation = fx.table(spark, sf_dir, "supplier"), fx.table(spark, sf_dir, "nation")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    regions = analysis.region_lookup(places.select(F.col("s_suppkey").alias("lsoa11cd"), F.col("s_name").alias("lad17nm"), F.col("n_name").alias("rgn11nm")))
    areas = l21(spark, sf_dir).withColumnRenamed("id", "geo_code")
    rows = relative(spark, sf_dir).withColumnRenamed("from_id", "geo_code")
    compared = analysis.area_comparison(rows, regions, materialise(areas, "areas"), "NATION_3", "employment_all", (30, 60))
    return rounded(compared, ["pt_bike_diff"])


@REGISTRY.add(
    "L08_access_stats",
    duck(
        "SELECT mode, service, time_cut, ROUND(AVG(accessibility), 9) AS access_mean, ROUND(STDDEV_SAMP(accessibility), 9) AS access_sd,"
        " CAST(COUNT(*) - COUNT(accessibility) AS BIGINT) AS access_n_null, "
        + quantiles("accessibility", {"access_q1": 0.25, "access_median": 0.5, "access_q3": 0.75}, 9)
        + f" FROM q_relative_long WHERE {MORNING} GROUP BY 1, 2, 3"
    ),
)
def l08(spark, sf_dir):
    result = analysis.access_statistics(relative(spark, sf_dir))
    # Shares have four places, so their means may end in a 5 at the seventh: round well below that.
    return rounded(result, ["access_mean", "access_sd", "access_q1", "access_median", "access_q3"], 9)


@REGISTRY.add(
    "L09_nearest_stats",
    duck(
        f"""SELECT service, mode, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, whisker_low, whisker_high, n_outside,
              CASE service WHEN 'gp_practices' THEN CONCAT('Gp', CHR(10), 'practices') WHEN 'hospitals' THEN 'Hospitals'
                   WHEN 'main_bua' THEN CONCAT('Main', CHR(10), 'bua') ELSE 'Parks' END AS label
            FROM (SELECT v.service, v.mode, q.q1, q.median, q.q3,
                    CAST(MIN(CASE WHEN tt_minutes BETWEEN lo AND hi THEN tt_minutes END) AS DOUBLE) AS whisker_low,
                    CAST(MAX(CASE WHEN tt_minutes BETWEEN lo AND hi THEN tt_minutes END) AS DOUBLE) AS whisker_high,
                    CAST(SUM(CASE WHEN tt_minutes BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outside
                  FROM (SELECT * FROM q_nearest_long WHERE tt_minutes IS NOT NULL AND {MORNING}) v
                  JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT service, mode,
                          QUANTILE_CONT(CAST(tt_minutes AS DOUBLE), CAST(0.25 AS DOUBLE)) AS q1,
                          QUANTILE_CONT(CAST(tt_minutes AS DOUBLE), CAST(0.5 AS DOUBLE)) AS median,
                          QUANTILE_CONT(CAST(tt_minutes AS DOUBLE), CAST(0.75 AS DOUBLE)) AS q3
                        FROM q_nearest_long WHERE {MORNING} GROUP BY 1, 2) f WHERE q1 IS NOT NULL) q
                    ON q.service = v.service AND q.mode = v.mode GROUP BY ALL) b"""
    ),
)
def l09(spark, sf_dir):
    return rounded(analysis.nearest_statistics(nearest_long(spark, sf_dir)), list(stats.QUARTILES))


@REGISTRY.add(
    "L09_unreachable",
    duck(
        "SELECT service, MAX(CASE WHEN mode = 'bicycle' THEN n END) AS bicycle, MAX(CASE WHEN mode = 'pt' THEN n END) AS pt,"
        f" MAX(CASE WHEN mode = 'walk' THEN n END) AS walk FROM (SELECT service, mode, COUNT(*) AS n FROM q_nearest_long WHERE tt_minutes IS NULL AND {MORNING}"
        " GROUP BY 1, 2) t GROUP BY 1"
    ),
)
def l09_unreachable(spark, sf_dir):
    return analysis.unreachable(nearest_long(spark, sf_dir))


_PARK = """
    SELECT a.mode, COALESCE(a.time_of_day, 'am') AS time_of_day, a.from_id AS geo_code, a.access_parks_30, s.s_name AS lad17nm, s.s_nationkey AS rgn11nm
    FROM q_access a LEFT JOIN supplier s ON s.s_suppkey = a.from_id
    WHERE (a.mode = 'bicycle' OR (a.mode = 'pt' AND COALESCE(a.time_of_day, 'am') = 'am'))
      AND a.from_id IN (SELECT z.zone_id FROM f_zonepoly z, f_point p WHERE p.id = 1 AND
            GREATEST(z.xa - p.x, 0, p.x - z.xb) * GREATEST(z.xa - p.x, 0, p.x - z.xb) +
            GREATEST(z.ya - p.y, 0, p.y - z.yb) * GREATEST(z.ya - p.y, 0, p.y - z.yb) <= CAST(100000 AS DOUBLE) * 100000)"""


@REGISTRY.add("L10_park_view", duck(_PARK))
def l10(spark, sf_dir):
    access = wide_access(spark, sf_dir, {"parks": "park_ha"}, {})[0]
    access = access.withColumnRenamed("from_id", "geo_code").select("mode", "time_of_day", "geo_code", "access_parks_30")
    lookup = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("geo_code"), F.col("s_name").alias("lad17nm"), F.col("s_nationkey").alias("rgn11nm")
    )
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    centre = fx.view(spark, sf_dir, "f_point").filter(F.col("id") == 1)
    return analysis.park_view(access, lookup, zones, centre, 100_000.0)


_TOTALS = """
    SELECT CASE WHEN cd = 'park_ha' THEN 'Parks and gardens (ha)' WHEN cd = 'pharmacies' THEN 'Pharmacies' ELSE CONCAT('Service ', p) END AS destination,
           cd AS destination_cd, total_22, total_23
    FROM (SELECT COALESCE(p.destination_cd, c.destination) AS cd, p.destination_cd AS p, p.total_22, c.total_23 FROM f_prev p
          FULL JOIN (SELECT * FROM q_long_totals WHERE destination NOT LIKE '%_1' AND destination NOT LIKE '%_2' AND destination NOT LIKE '%_3') c
            ON c.destination = p.destination_cd) t"""
_SERVICES = (
    "employment_all", "employment_promo_1", "employment_standard_2", "employment_economy_3",
    "hospitals", "gp_practices", "main_bua", "park_ha",
)
_LONG_TOTALS = {
    **EXTRA,
    "q_long_totals": "\nUNION ALL ".join(f"SELECT '{c}' AS destination, CAST(SUM({c}) AS DOUBLE) AS total_23 FROM f_landuse" for c in _SERVICES),
}


@REGISTRY.add("L11_totals", fx.duck_sql(_TOTALS.replace("CONCAT('Service ', p)", "'Service ' || p"), _LONG_TOTALS))
def l11(spark, sf_dir):
    previous = fx.view(spark, sf_dir, "f_prev").withColumn("destination", F.concat(F.lit("Education: Service "), "destination_cd"))
    return analysis.destination_totals(fx.view(spark, sf_dir, "f_landuse"), previous, _SERVICES)


@REGISTRY.add(
    "L12_sector_totals",
    fx.duck_sql(
        "SELECT t.destination, g.broad_group, t.total_23 FROM q_long_totals t LEFT JOIN (SELECT DISTINCT 'employment_' || LOWER(p_type) ||"
        " CASE p_type WHEN 'PROMO' THEN '_1' WHEN 'STANDARD' THEN '_2' ELSE '_9' END AS d, p_type AS broad_group FROM part) g ON g.d = t.destination"
        " WHERE regexp_matches(t.destination, '[0-9]$')",
        _LONG_TOTALS,
    ),
)
def l12(spark, sf_dir):
    kinds = fx.table(spark, sf_dir, "part").select("p_type").distinct()
    suffix = F.when(F.col("p_type") == "PROMO", "_1").when(F.col("p_type") == "STANDARD", "_2").otherwise("_9")
    groups = kinds.select(F.concat(F.lit("\ufeffemployment_"), F.lower("p_type"), suffix).alias("abbreviation"), F.col("p_type").alias("broad_group"))
    return analysis.sector_totals(fx.view(spark, sf_dir, "f_landuse"), groups, _SERVICES)


_RANKED = "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY pop DESC, n_nationkey) AS pop_ranking FROM (SELECT n_nationkey, COUNT(c_custkey) AS pop FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) t"


@REGISTRY.add(
    "L21_zone_area",
    fx.duck_sql(
        "SELECT p.id, z.zone_id AS ttwa, r.pop_ranking, CASE WHEN r.pop_ranking IS NULL THEN NULL WHEN r.pop_ranking < 25 THEN 'city' ELSE 'other' END AS city_large"
        f" FROM f_point p LEFT JOIN f_zonepoly z ON p.x BETWEEN z.xa AND z.xb AND p.y BETWEEN z.ya AND z.yb LEFT JOIN ({_RANKED}) r ON r.n_nationkey = z.zone_id"
    ),
)
def l21(spark, sf_dir):
    people = stats.count_by(fx.table(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", "pop")
    areas = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ttwa"))
    areas = areas.join(people.withColumnRenamed("c_nationkey", "ttwa"), "ttwa", "left").fillna(0, ["pop"])
    cities = analysis.ranked_cities(areas, "ttwa", "pop").drop("pop")
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    return analysis.zone_areas(fx.view(spark, sf_dir, "f_point"), zones, cities, "ttwa")
