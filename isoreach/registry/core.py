"""The accessibility measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import naming
from isoreach.operators import joins, reshape
from isoreach.plans import increments, metrics
from isoreach.registry import REGISTRY
from isoreach.session import materialise

CUTS = metrics.CUTS
CUMULATIVE = {
    "employment_all": "employment_all",
    "employment_promo_1": "employment_promo_1",
    "employment_standard_2": "employment_standard_2",
    "employment_economy_3": "employment_economy_3",
    "hospitals": "hospitals",
    "gp_practices": "gp_practices",
    "main_bua": "main_bua",
    "parks": "park_ha",
}
NEAREST = {
    "hospitals": "hospitals",
    "gp_practices": "gp_practices",
    "main_bua": "main_bua",
    "parks": "park_accesspoints",
}

# --- texts for the other engine: every sum and minimum spelled out on the joined pairs ---


def _type(service: str) -> str:
    return "DOUBLE" if service == "parks" else "BIGINT"


def sql_cumulative(services=CUMULATIVE) -> str:
    return ",\n".join(
        f"CAST(SUM(CASE WHEN t.travel_time <= {c} THEN w.{col} ELSE 0 END) AS {_type(s)}) AS {naming.access_name(s, c)}"
        for s, col in services.items()
        for c in CUTS
    )


def sql_nearest(services=NEAREST) -> str:
    return ",\n".join(
        f"MIN(CASE WHEN w.{col} > 0 THEN t.travel_time END) AS {naming.nearest_name(s)}"
        for s, col in services.items()
    )


def sql_pct(services=CUMULATIVE) -> str:
    return ",\n".join(
        f"round_even(CAST(a.{naming.access_name(s, c)} AS DOUBLE) / NULLIF(k.{s}, 0) * 100, 4) AS {naming.pct_name(s, c)}"
        for s in services
        for c in CUTS
    )


def sql_totals(services=CUMULATIVE) -> str:
    return ", ".join(f"CAST(SUM({col}) AS DOUBLE) AS {s}" for s, col in services.items())


PAIRS = "FROM f_ttm t LEFT JOIN f_landuse w ON w.id = t.to_id GROUP BY t.mode, t.time_of_day, t.from_id"
EXTRA = {
    "q_access": f"SELECT t.mode, t.time_of_day, t.from_id, {sql_cumulative()} {PAIRS}",
    "q_nearest": f"SELECT t.mode, t.time_of_day, t.from_id, {sql_nearest()} {PAIRS}",
    "q_totals": f"SELECT {sql_totals()} FROM f_landuse",
    "q_relative": f"SELECT a.mode, a.time_of_day, a.from_id, {sql_pct()} FROM q_access a, q_totals k",
    "q_relative_long": "\nUNION ALL ".join(
        f"SELECT from_id, mode, time_of_day, '{s}' AS service, {c} AS time_cut, {naming.pct_name(s, c)} AS accessibility"
        " FROM q_relative"
        for s in CUMULATIVE
        for c in CUTS
    ),
    "q_nearest_long": "\nUNION ALL ".join(
        f"SELECT from_id, mode, time_of_day, '{s}' AS service, {naming.nearest_name(s)} AS tt_minutes FROM q_nearest"
        for s in NEAREST
    ),
}


def duck(query: str) -> str:
    return fx.duck_sql(query, EXTRA)


def inputs(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_ttm"), fx.view(spark, sf_dir, "f_landuse")


def wide_access(spark, sf_dir, cumulative=None, nearest=None):
    ttm, land_use = inputs(spark, sf_dir)
    cumulative = CUMULATIVE if cumulative is None else cumulative
    nearest = NEAREST if nearest is None else nearest
    return metrics.measures(ttm, land_use, cumulative, nearest), land_use


@REGISTRY.add(
    "L01_incremental",
    duck("SELECT a.*, n.* EXCLUDE (mode, time_of_day, from_id) FROM q_access a JOIN q_nearest n ON n.mode = a.mode AND n.time_of_day IS NOT DISTINCT FROM a.time_of_day AND n.from_id = a.from_id"),
)
def l01_incremental(spark, sf_dir):
    """From an earlier matrix (pairs missing, others slower, some since closed) and earlier weights to today's."""
    matrix, land_use = inputs(spark, sf_dir)
    columns = matrix.columns
    marked = materialise(matrix.withColumn("place", F.abs(F.xxhash64("from_id", "to_id") % 20)), "today")
    matrix, land_use = marked.select(columns), materialise(land_use, "today")
    missing, slower, closed = (F.col("place") == k for k in (0, 1, 2))
    later = F.col("travel_time") + 7
    late = marked.filter(slower).withColumn("travel_time", later).select(columns)
    gone = marked.filter(closed).withColumns({"to_id": -F.col("to_id") - 1, "travel_time": F.lit(1)}).select(columns)
    then = marked.filter(~missing).withColumn("travel_time", F.when(slower, later).otherwise(F.col("travel_time")))
    earlier = then.select(columns).unionByName(gone)
    some = F.col("id") % 10 == 3
    older = land_use.withColumns({"hospitals": F.when(some, F.lit(0)).otherwise(F.col("hospitals")).cast("bigint"), "employment_all": F.when(some, F.col("employment_all") * 2).otherwise(F.col("employment_all"))})
    older = older.withColumn("gp_practices", F.when(F.col("id") % 10 == 4, F.lit(1)).otherwise(F.col("gp_practices")).cast("bigint"))
    closed_zones = gone.select(F.col("to_id").alias("id"), *[F.lit(1).cast(land_use.schema[c].dataType).alias(c) for c in land_use.columns if c != "id"]).distinct()
    older = materialise(older.unionByName(closed_zones.select(older.columns)), "older")
    state = increments.start(earlier, older, CUMULATIVE, NEAREST)
    added = marked.filter(missing | slower).select(columns)
    state = increments.change_pairs(state, late.unionByName(gone), added, matrix, older)
    return increments.measures(increments.change_weights(state, older, land_use, matrix))


@REGISTRY.add("L01_cumulative", duck("SELECT * FROM q_access"))
def l01(spark, sf_dir):
    return wide_access(spark, sf_dir, nearest={})[0]


@REGISTRY.add("L02_nearest", duck("SELECT * FROM q_nearest"))
def l02(spark, sf_dir):
    return wide_access(spark, sf_dir, cumulative={})[0]


_SLICES = "\nUNION ALL ".join(
    f"SELECT '{mode}' AS mode, {tod} AS time_of_day, t.from_id, {sql_cumulative()},"
    f" {sql_nearest()} FROM f_ttm t LEFT JOIN f_landuse w ON w.id = t.to_id"
    f" WHERE t.mode = '{mode}' GROUP BY {group}"
    for mode, tod, group in (
        ("pt", "t.time_of_day", "t.time_of_day, t.from_id"),
        ("walk", "CAST(NULL AS VARCHAR)", "t.from_id"),
        ("bicycle", "CAST(NULL AS VARCHAR)", "t.from_id"),
    )
)


@REGISTRY.add("L03_multi_mode", duck(_SLICES))
def l03(spark, sf_dir):
    """Three tables with their own cost columns, as one matrix and one job."""
    ttm, land_use = inputs(spark, sf_dir)

    def slice_of(mode, cost):
        return ttm.filter(F.col("mode") == mode).withColumnRenamed("travel_time", cost)

    matrix = metrics.normalise_matrix(
        {
            "pt": (slice_of("pt", "travel_time_p50").drop("mode"), "travel_time_p50"),
            "walk": (slice_of("walk", "travel_time_p50").drop("mode", "time_of_day"), "travel_time_p50"),
            "bicycle": (slice_of("bicycle", "travel_time_adj").drop("mode", "time_of_day"), "travel_time_adj"),
        }
    )
    return metrics.measures(matrix, land_use, CUMULATIVE, NEAREST)


@REGISTRY.add("L04_relative", duck("SELECT * FROM q_relative"))
def l04(spark, sf_dir):
    access, land_use = wide_access(spark, sf_dir, nearest={})
    relative = metrics.with_relative(access, land_use, CUMULATIVE)
    return relative.select(*metrics.KEYS, *naming.matching(relative, "_pct$"))


@REGISTRY.add("L04_relative_long", duck("SELECT * FROM q_relative_long"))
def l04_long(spark, sf_dir):
    access, land_use = wide_access(spark, sf_dir, nearest={})
    return metrics.relative_long(access, land_use, CUMULATIVE)


@REGISTRY.add(
    "L05_weight_sets",
    duck(
        "SELECT CAST(SUM(CASE WHEN park_ha > 0 THEN 1 ELSE 0 END) AS BIGINT) AS cumulative_parks, "
        "CAST(SUM(CASE WHEN park_accesspoints > 0 THEN 1 ELSE 0 END) AS BIGINT) AS nearest_parks, "
        "8 AS n_cumulative, 4 AS n_nearest FROM f_landuse"
    ),
)
def l05(spark, sf_dir):
    land_use = fx.view(spark, sf_dir, "f_landuse")
    cumulative, nearest = metrics.cumulative_services(land_use), metrics.nearest_services(land_use)
    return land_use.agg(
        F.count_if(F.col(cumulative["parks"]) > 0).alias("cumulative_parks"),
        F.count_if(F.col(nearest["parks"]) > 0).alias("nearest_parks"),
        F.lit(len(cumulative)).alias("n_cumulative"),
        F.lit(len(nearest)).alias("n_nearest"),
    )


_WIDE = (
    "SELECT a.from_id AS geo_code, a.* EXCLUDE (from_id), r.* EXCLUDE (mode, time_of_day, from_id),"
    " n.* EXCLUDE (mode, time_of_day, from_id)"
    " FROM q_access a"
    " JOIN q_relative r ON r.mode = a.mode AND r.time_of_day IS NOT DISTINCT FROM a.time_of_day AND r.from_id = a.from_id"
    " JOIN q_nearest n ON n.mode = a.mode AND n.time_of_day IS NOT DISTINCT FROM a.time_of_day AND n.from_id = a.from_id"
)


@REGISTRY.add("L06_access_wide", duck(_WIDE))
def l06(spark, sf_dir):
    ttm, land_use = inputs(spark, sf_dir)
    return metrics.access_table(ttm, land_use)


@REGISTRY.add(
    "J06_null_safe_merge",
    duck(
        "SELECT a.*, n.* EXCLUDE (mode, time_of_day, from_id) FROM q_access a"
        " LEFT JOIN q_nearest n ON n.mode = a.mode AND n.from_id = a.from_id"
        " AND n.time_of_day IS NOT DISTINCT FROM a.time_of_day"
    ),
)
def j06(spark, sf_dir):
    """Two results merged on a key part that is NULL for two of three modes."""
    access = wide_access(spark, sf_dir, nearest={})[0]
    nearest = wide_access(spark, sf_dir, cumulative={})[0]
    return joins.null_safe_join(access, nearest, list(metrics.KEYS))


@REGISTRY.add(
    "J10_fact_dimension",
    duck(
        "SELECT t.mode, t.time_of_day, COUNT(*) AS pairs, CAST(SUM(w.employment_all) AS BIGINT) AS jobs"
        " FROM f_ttm t JOIN f_landuse w ON w.id = t.to_id GROUP BY 1, 2"
    ),
)
def j10(spark, sf_dir):
    ttm, land_use = inputs(spark, sf_dir)
    weights = land_use.select(F.col("id").alias("to_id"), "employment_all")
    joined = joins.lookup_join(ttm, weights, "to_id", "inner")
    return joined.groupBy("mode", "time_of_day").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("employment_all").alias("jobs")
    )


@REGISTRY.add(
    "P13_prune_null_columns",
    duck("SELECT mode, from_id, access_hospitals_15, nearest_hospitals FROM (SELECT a.mode, a.from_id,"
         " a.access_hospitals_15, n.nearest_hospitals FROM q_access a JOIN q_nearest n ON n.mode = a.mode"
         " AND n.from_id = a.from_id WHERE a.mode = 'walk' AND n.mode = 'walk') t"),
)
def p13(spark, sf_dir):
    only = {"hospitals": "hospitals"}
    walk = wide_access(spark, sf_dir, only, only)[0].filter(F.col("mode") == "walk")
    return reshape.drop_empty_columns(walk.select(*metrics.KEYS, "access_hospitals_15", "nearest_hospitals"))


def _service_rows(service: str) -> str:
    """Columns of one service under general names, from the wide table."""
    values = [f"CAST({naming.access_name(service, c)} AS DOUBLE) AS access_{c}" for c in CUTS]
    values += [f"{naming.pct_name(service, c)} AS pct_{c}" for c in CUTS]
    nearest = naming.nearest_name(service) if service in NEAREST else "NULL"
    return f"SELECT '{service}' AS service, geo_code, mode, time_of_day, {', '.join(values)}, CAST({nearest} AS INT) AS nearest FROM w"


SERVICE_ROWS = f"WITH w AS ({_WIDE}) " + "\nUNION ALL ".join(_service_rows(s) for s in CUMULATIVE)


def general_names(one, service):
    """A service's own table with the service left out of the column names."""
    values = [F.col(naming.access_name(service, c)).cast("double").alias(f"access_{c}") for c in CUTS]
    values += [F.col(naming.pct_name(service, c)).alias(f"pct_{c}") for c in CUTS]
    nearest = F.col(naming.nearest_name(service)) if naming.nearest_name(service) in one.columns else F.lit(None)
    return one.select("geo_code", "mode", "time_of_day", *values, nearest.cast("int").alias("nearest"))


def stored_access(spark, sf_dir):
    ttm, land_use = inputs(spark, sf_dir)
    return materialise(metrics.access_table(ttm, land_use, CUMULATIVE, NEAREST), "access")


@REGISTRY.add("R05_service_split", duck(f"SELECT * FROM ({SERVICE_ROWS}) s"))
def r05(spark, sf_dir):
    """The table of every service and mode, stacked."""
    access = stored_access(spark, sf_dir)
    tables = {
        (service, mode): general_names(metrics.service_slice(access.filter(F.col("mode") == mode), service), service)
        for service in CUMULATIVE
        for mode in ("bicycle", "pt", "walk")
    }
    return reshape.stack(*[t.withColumn("service", F.lit(service)) for (service, _), t in tables.items()])


OTHER_CUTS = (7, 20, 45, 150)


@REGISTRY.add(
    "L04_other_cuts",
    duck(
        "\nUNION ALL ".join(
            f"SELECT t.mode, t.time_of_day, t.from_id, '{s}' AS service, {c} AS time_cut, round_even(CAST(SUM(CASE WHEN t.travel_time <= {c}"
            f" THEN w.{col} ELSE 0 END) AS DOUBLE) / NULLIF((SELECT {s} FROM q_totals), 0) * 100, 4) AS accessibility {PAIRS}"
            for s, col in CUMULATIVE.items()
            for c in OTHER_CUTS
        )
    ),
)
def l04_other(spark, sf_dir):
    """Time limits other than the published ones."""
    ttm, land_use = inputs(spark, sf_dir)
    access = metrics.measures(ttm, land_use, CUMULATIVE, {}, OTHER_CUTS)
    return metrics.relative_long(access, land_use, CUMULATIVE)


@REGISTRY.add(
    "A15_threshold_sum_min",
    duck(
        "SELECT t.mode, CAST(SUM(CASE WHEN t.travel_time <= 30 THEN w.employment_all ELSE 0 END) AS BIGINT) AS jobs_30,"
        " MIN(CASE WHEN w.main_bua > 0 THEN t.travel_time END) AS nearest_main_bua"
        " FROM f_ttm t LEFT JOIN f_landuse w ON w.id = t.to_id GROUP BY t.mode"
    ),
)
def a15(spark, sf_dir):
    ttm, land_use = inputs(spark, sf_dir)
    weights = land_use.select(F.col("id").alias("to_id"), "employment_all", "main_bua")
    return joins.lookup_join(ttm, weights, "to_id").groupBy("mode").agg(
        F.coalesce(F.sum(F.when(F.col("travel_time") <= 30, F.col("employment_all"))), F.lit(0)).alias("jobs_30"),
        F.min(F.when(F.col("main_bua") > 0, F.col("travel_time"))).alias("nearest_main_bua"),
    )
