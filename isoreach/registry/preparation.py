"""Filters, lookups, naming, scalar functions and the preparation of service lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import geodesy, naming, nulls, text
from isoreach.operators import geometry as g
from isoreach.operators import joins, lookup, reshape, stats
from isoreach.plans import analysis, services, weights
from isoreach.registry import REGISTRY
from isoreach.registry.core import duck, wide_access
from isoreach.sources import readers

sql = fx.duck_sql


# --- projection and naming ---


@REGISTRY.add("P01_select", sql("SELECT c_custkey, c_name FROM customer"))
def p01(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")


@REGISTRY.add("P02_by_position", sql("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders"))
def p02(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select(*naming.by_position(orders, [1, 2, 6]))


@REGISTRY.add("P03_column_range", sql("SELECT p_name, p_brand, p_type FROM part"))
def p03(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return part.select(*naming.column_range(part, "p_name", "p_type"))


@REGISTRY.add("P04_drop", sql("SELECT p_partkey, p_type, p_size, p_retailprice FROM part"))
def p04(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return part.drop(*naming.column_range(part, "p_name", "p_brand"))


@REGISTRY.add("P05_by_pattern", sql("SELECT id, employment_promo_1, employment_standard_2, employment_economy_3, park_ha FROM f_landuse"))
def p05(spark, sf_dir):
    land = fx.view(spark, sf_dir, "f_landuse")
    numbered = naming.matching(land, "[0-9]$")
    parks = [c for c in naming.starts_with(land, "PARK") if c not in naming.containing(land, "accesspoint")]
    return land.select("id", *numbered, *parks)


@REGISTRY.add("P06_rename", sql("SELECT s_suppkey AS source_id, s_name AS name, s_nationkey, s_acctbal FROM supplier"))
def p06(spark, sf_dir):
    return fx.table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "source_id", "s_name": "name"})


@REGISTRY.add("P07_rename_by_function", sql("SELECT n_nationkey, n_name AS n_name_pct, n_regionkey FROM nation"))
def p07(spark, sf_dir):
    return naming.rename_where(fx.table(spark, sf_dir, "nation"), lambda c: c.endswith("name"), lambda c: c + "_pct")


@REGISTRY.add("P08_clean_names", sql('SELECT c_custkey AS customer_key, c_name AS customer_name, c_acctbal AS x2023_balance_percent, c_mktsegment AS customer_name_2 FROM customer'))
def p08(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return naming.clean_names(raw.toDF("Customer key", "CustomerName", "2023 Balance (%)", "customer.name"))


@REGISTRY.add("P09_sector_names", sql("SELECT id, employment_promo_1 AS employment_mining_1, employment_standard_2 AS employment_construction_2 FROM f_landuse"))
def p09(spark, sf_dir):
    raw = fx.view(spark, sf_dir, "f_landuse").select("id", "employment_promo_1", "employment_standard_2")
    raw = naming.clean_names(raw.toDF("id", "2 : Mining, quarrying & utilities (B,D and E)", "4 : Construction (F)"))
    headers = raw.columns[1:]
    return raw.toDF("id", *naming.sector_names(headers))


@REGISTRY.add("P11_computed", sql("SELECT p_partkey, p_size * 2 AS double_size, p_retailprice / 10000 AS price_ha FROM part"))
def p11(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return part.withColumns({"double_size": F.col("p_size") * 2, "price_ha": F.col("p_retailprice") / 10_000}).drop("p_size", "p_retailprice")


@REGISTRY.add("P12_across_columns", sql("SELECT urn, NULLIF(phase, '---') AS phase, low_age, high_age, street, town FROM f_school"))
def p12(spark, sf_dir):
    return services.without_sentinel(fx.view(spark, sf_dir, "f_school"))


@REGISTRY.add("P14_drop_geometry", sql("SELECT pcds, lsoa11, doterm FROM f_postcode"))
def p14(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_postcode").drop("lat", "long")


@REGISTRY.add("P10_P16_keyed_codes", sql(
    "SELECT p_partkey, p_type, CASE p_type WHEN 'PROMO' THEN 'Offer' WHEN 'STANDARD' THEN 'Usual' ELSE 'Other ' || LOWER(p_type) END AS label FROM part WHERE p_partkey IN (SELECT zone_id FROM f_poi)"
))
def p16(spark, sf_dir):
    """A mapping is joined by key, and membership in another table is a semi join."""
    part = fx.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    label = F.when(F.col("p_type") == "PROMO", "Offer").when(F.col("p_type") == "STANDARD", "Usual")
    labels = part.select("p_type").distinct().withColumn("label", F.coalesce(label, F.concat(F.lit("Other "), F.lower("p_type"))))
    served = fx.view(spark, sf_dir, "f_poi").select(F.col("zone_id").alias("p_partkey")).distinct()
    return part.join(labels, "p_type").join(served, "p_partkey", "left_semi")


# --- filters ---


@REGISTRY.add("F01_conjunction", sql("SELECT practice_code, name FROM f_practice WHERE status = 'F' AND name = '1-URGENT' OR status = 'P' AND name = '5-LOW'"))
def f01(spark, sf_dir):
    s, n = F.col("status"), F.col("name")
    return fx.view(spark, sf_dir, "f_practice").filter((s == "F") & (n == "1-URGENT") | (s == "P") & (n == "5-LOW")).select("practice_code", "name")


@REGISTRY.add("F02_null_tests", sql("SELECT practice_code, status FROM f_practice WHERE name IS NULL AND postcode IS NOT NULL"))
def f02(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_practice").filter(F.col("name").isNull() & F.col("postcode").isNotNull()).select("practice_code", "status")


@REGISTRY.add("F03_not_equal", sql("SELECT practice_code, name FROM f_practice WHERE name <> '5-LOW'"))
def f03(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_practice").filter(F.col("name") != "5-LOW").select("practice_code", "name")


@REGISTRY.add("F04_anchored", sql("SELECT pcds, lsoa11 FROM f_postcode WHERE regexp_matches(lsoa11, '^(E|S)') AND regexp_matches(pcds, '[0-3]$')"))
def f04(spark, sf_dir):
    codes = fx.view(spark, sf_dir, "f_postcode")
    return codes.filter(F.col("lsoa11").rlike("^(E|S)") & F.col("pcds").rlike("[0-3]$")).select("pcds", "lsoa11")


@REGISTRY.add("F05_allow", sql("SELECT id, name, brand FROM f_named WHERE COALESCE(regexp_matches(name, '(widget|BOLT)', 'i'), FALSE) OR COALESCE(regexp_matches(brand, '(widget|brand#1)', 'i'), FALSE)"))
def f05(spark, sf_dir):
    named = fx.view(spark, sf_dir, "f_named")
    return named.filter(
        nulls.matches("name", nulls.any_of(["widget", "BOLT"])) | nulls.matches("brand", nulls.any_of(["widget", "brand#1"]))
    ).select("id", "name", "brand")


@REGISTRY.add("F06_deny", sql("SELECT id, name FROM f_named WHERE NOT COALESCE(regexp_matches(name, '(red|gear|small r(ing|od))', 'i'), FALSE)"))
def f06(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_named").filter(nulls.lacks("name", nulls.any_of(["RED", "gear", "small r(ing|od)"]))).select("id", "name")


@REGISTRY.add("F07_in", sql("SELECT urn, COALESCE(phase IN ('Primary', 'Middle deemed primary', 'All-through'), FALSE) AS type_primary FROM f_school"))
def f07(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_school").select("urn", nulls.is_in("phase", services.PRIMARY_PHASES).alias("type_primary"))


@REGISTRY.add("F08_range", sql("SELECT pcds, lat FROM f_postcode WHERE lat > 55.6 AND lat < 56"))
def f08(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_postcode").filter((F.col("lat") > 55.6) & (F.col("lat") < 56)).select("pcds", "lat")


@REGISTRY.add("F09_flags", sql("SELECT urn, phase FROM f_school WHERE phase = 'Primary' OR high_age >= 16"))
def f09(spark, sf_dir):
    flagged = fx.view(spark, sf_dir, "f_school").withColumns({"a": F.col("phase") == "Primary", "b": F.col("high_age") >= 16})
    return flagged.filter(F.col("a") | F.col("b")).select("urn", "phase")


@REGISTRY.add("F10_blank", sql("SELECT id, COALESCE(TRIM(name), '') = '' AS blank FROM f_named"))
def f10(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_named").select("id", nulls.is_blank("name").alias("blank"))


@REGISTRY.add("F11_has_letter", sql("SELECT practice_code, CASE WHEN COALESCE(regexp_matches(name, '[A-Za-z]'), FALSE) THEN 'valid' ELSE 'repair' END AS part FROM f_practice"))
def f11(spark, sf_dir):
    """The two halves of a validity test hold every row exactly once."""
    practice = fx.view(spark, sf_dir, "f_practice")
    good, bad = practice.filter(nulls.has_letter("name")), practice.filter(~nulls.has_letter("name"))
    return reshape.stack_labelled({"valid": good.select("practice_code"), "repair": bad.select("practice_code")}, "part")


@REGISTRY.add("F12_tod", sql("SELECT * FROM f_ttm WHERE time_of_day IS NULL OR time_of_day = 'am'"))
def f12(spark, sf_dir):
    return analysis.morning_only(fx.view(spark, sf_dir, "f_ttm"))


_FEATURES = {
    "f_feature": """SELECT p_partkey AS id, o_orderdate AS ts, o_orderkey AS version,
                           CASE WHEN o_orderkey % 7 = 0 THEN 'supermarket' WHEN o_orderkey % 7 < 4 THEN 'bakery' END AS shop, p_brand AS brand
                    FROM {part} JOIN {orders} ON o_custkey = p_partkey"""
}


@REGISTRY.add(
    "S12_tags_asof",
    sql(
        """SELECT id, version FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS rn FROM f_feature
           WHERE ts <= TIMESTAMP '1997-06-01 00:00:00') t WHERE rn = 1 AND shop IN ('supermarket', 'bakery')""",
        _FEATURES,
    ),
)
def s12(spark, sf_dir):
    """The state of tagged features at an instant, by key and values."""
    raw = fx.spark_sql(spark, sf_dir, "SELECT * FROM f_feature", _FEATURES)
    tags = F.map_from_arrays(F.array(F.lit("shop"), F.lit("brand")), F.array("shop", "brand"))
    tagged = raw.select("id", "ts", "version", tags.alias("tags"))
    state = readers.as_of(tagged, "id", "ts", "1997-06-01 00:00:00", "version")
    return state.filter(readers.select_features(F.col("tags"), "shop", ["supermarket", "bakery"])).select("id", "version")


@REGISTRY.add(
    "S12_timeline",
    sql(
        """SELECT CAST(t AS DATE) AS day, id, version FROM (
             SELECT i.t, f.id, f.version, ROW_NUMBER() OVER (PARTITION BY i.t, f.id ORDER BY f.ts DESC, f.version DESC) AS rn
             FROM f_feature f, generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH) i(t) WHERE f.ts <= i.t) s WHERE rn = 1""",
        _FEATURES,
    ),
)
def s12_timeline(spark, sf_dir):
    """The state of the features at the start of each of 24 months, in one pass over their versions."""
    raw = fx.spark_sql(spark, sf_dir, "SELECT * FROM f_feature", _FEATURES)
    months = spark.sql("SELECT explode(sequence(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH)) AS instant")
    states = readers.as_of_many(raw.select("id", "ts", "version"), "id", "ts", months, "version")
    return states.select(F.col("instant").cast("date").alias("day"), "id", "version")


# --- joins and lookups ---


@REGISTRY.add("J01_left", sql("SELECT p.practice_code, c.lsoa11 FROM f_practice p LEFT JOIN f_postcode c ON c.pcds = p.postcode"))
def j01(spark, sf_dir):
    codes = fx.view(spark, sf_dir, "f_postcode").select(F.col("pcds").alias("postcode"), "lsoa11")
    return joins.lookup_join(fx.view(spark, sf_dir, "f_practice"), codes, "postcode").select("practice_code", "lsoa11")


_FALLBACK = """SELECT p.practice_code, p.postcode, COALESCE(l.lsoa11, r.lsoa11) AS lsoa11, COALESCE(l.lat, r.lat) AS lat, COALESCE(l.long, r.long) AS long
               FROM f_practice p LEFT JOIN (SELECT * FROM f_postcode WHERE doterm IS NULL AND regexp_matches(lsoa11, '^(E|S|W)')) l ON l.pcds = p.postcode
               LEFT JOIN f_postcode r ON r.pcds = p.postcode"""


@REGISTRY.add("J02_fallback", sql(_FALLBACK))
def j02(spark, sf_dir):
    practice = fx.view(spark, sf_dir, "f_practice").select("practice_code", "postcode")
    return services.locate(practice, fx.view(spark, sf_dir, "f_postcode")).select("practice_code", "postcode", "lsoa11", "lat", "long")


@REGISTRY.add(
    "J03_override",
    sql(
        f"""SELECT t.practice_code, COALESCE(t.lsoa11, CASE WHEN t.lat IS NULL THEN o.s_name END) AS lsoa11, COALESCE(t.lat, o.s_acctbal) AS lat
            FROM ({_FALLBACK}) t LEFT JOIN supplier o ON o.s_suppkey * 50 = t.practice_code"""
    ),
)
def j03(spark, sf_dir):
    """Rows no directory knows get hand-kept values by their own key."""
    located = j02(spark, sf_dir).select("practice_code", "lsoa11", "lat")
    overrides = fx.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 50).alias("practice_code"), F.col("s_name").alias("lsoa11"), F.col("s_acctbal").alias("lat")
    )
    return lookup.override_missing(located, overrides, "practice_code", "lat")


@REGISTRY.add("U04_repair", sql(f"SELECT COUNT(*) AS n, COUNT(lat) AS located, COUNT(DISTINCT practice_code) AS codes FROM ({_FALLBACK}) t"))
def u04(spark, sf_dir):
    """Repair keeps every row once."""
    fixed = j02(spark, sf_dir)
    return fixed.agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("located"), F.countDistinct("practice_code").alias("codes"))


@REGISTRY.add("J05_full_outer", sql(
    "SELECT COALESCE(a.k, b.k) AS k, a.n AS n_practice, b.n AS n_named FROM (SELECT name AS k, COUNT(*) AS n FROM f_practice GROUP BY 1) a"
    " FULL JOIN (SELECT CASE WHEN brand = 'Brand#1' THEN '5-LOW' ELSE brand END AS k, COUNT(*) AS n FROM f_named GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k"
))
def j05(spark, sf_dir):
    a = stats.count_by(fx.view(spark, sf_dir, "f_practice").select(F.col("name").alias("k")), "k", "n_practice")
    brand = F.when(F.col("brand") == "Brand#1", "5-LOW").otherwise(F.col("brand"))
    b = stats.count_by(fx.view(spark, sf_dir, "f_named").select(brand.alias("k")), "k", "n_named")
    return joins.null_safe_join(a, b, ["k"], "full")


@REGISTRY.add("J07_semi", sql("SELECT * FROM f_access WHERE ref_to_greenspace_site IN (SELECT id FROM f_site WHERE function_ = 'Public Park Or Garden')"))
def j07(spark, sf_dir):
    parks = fx.view(spark, sf_dir, "f_site").filter(F.col("function_") == "Public Park Or Garden")
    return joins.lookup_join(fx.view(spark, sf_dir, "f_access"), parks.select(F.col("id").alias("ref_to_greenspace_site")), "ref_to_greenspace_site", "left_semi")


@REGISTRY.add("J08_anti", sql("SELECT id, function_ FROM f_site WHERE id NOT IN (SELECT ref_to_greenspace_site FROM f_access)"))
def j08(spark, sf_dir):
    entered = fx.view(spark, sf_dir, "f_access").select(F.col("ref_to_greenspace_site").alias("id"))
    return joins.lookup_join(fx.view(spark, sf_dir, "f_site").select("id", "function_"), entered, "id", "left_anti")


@REGISTRY.add("J09_bind_columns", duck(
    "SELECT mode, time_of_day, from_id, access_hospitals_30, ROUND(access_hospitals_30 * CAST(100 AS DOUBLE) / 7, 6) AS access_hospitals_30_pct FROM q_access"
))
def j09(spark, sf_dir):
    access = wide_access(spark, sf_dir, {"hospitals": "hospitals"}, {})[0].select("mode", "time_of_day", "from_id", "access_hospitals_30")
    return access.withColumn("access_hospitals_30_pct", F.round(F.col("access_hospitals_30") * F.lit(100.0) / 7, 6))


# --- scalar functions ---


@REGISTRY.add("X_text_functions", sql(
    """SELECT id, LOWER(REPLACE(name, ' ', '_')) AS lowered, regexp_matches(name, 'RING', 'i') AS has_ring,
              regexp_extract(name, '^([a-z]+) ', 1) AS first_word, regexp_replace(name, '[aeiou]', '', 'g') AS vowelless,
              SUBSTRING(brand, 1, 1) AS initial, CONCAT(COALESCE(name, 'NA'), ' | ', COALESCE(brand, 'NA')) AS pasted,
              UPPER(SUBSTRING(name, 1, 1)) || LOWER(SUBSTRING(name, 2)) AS sentence, COALESCE(name, brand, 'none') AS first_known,
              NULLIF(brand, 'Brand#3') AS without_three FROM f_named"""
))
def x_text(spark, sf_dir):
    named = fx.view(spark, sf_dir, "f_named")
    return named.select(
        "id",
        F.lower(F.replace("name", F.lit(" "), F.lit("_"))).alias("lowered"),
        F.col("name").rlike("(?i)RING").alias("has_ring"),
        F.regexp_extract("name", "^([a-z]+) ", 1).alias("first_word"),
        F.regexp_replace("name", "[aeiou]", "").alias("vowelless"),
        text.first_letter("brand").alias("initial"),
        nulls.paste(" | ", "name", "brand").alias("pasted"),
        text.sentence_case("name").alias("sentence"),
        F.coalesce("name", "brand", F.lit("none")).alias("first_known"),
        nulls.blank_to_null("brand", "Brand#3").alias("without_three"),
    )


@REGISTRY.add("X_number_functions", sql(
    """SELECT p_partkey, round_even(p_retailprice / 7, 4) AS half_even, p_retailprice / NULLIF(p_size % 3, 0) AS ratio,
              TRY_CAST(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS INTEGER) AS number,
              COALESCE(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END, 0) AS filled,
              REPLACE(format('{{:,}}', p_partkey * 1000), ',', ' ') AS spaced,
              CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'ECONOMY' THEN 'Economy' END AS label FROM part"""
))
def x_number(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return part.select(
        "p_partkey",
        F.bround(F.col("p_retailprice") / 7, 4).alias("half_even"),
        nulls.ratio("p_retailprice", F.col("p_size") % 3).alias("ratio"),
        nulls.to_int(mixed).alias("number"),
        F.coalesce(F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")), F.lit(0)).alias("filled"),
        text.spaced_thousands(F.col("p_partkey") * 1000).alias("spaced"),
        text.with_labels("p_type", {"PROMO": "Promotion", "ECONOMY": "Economy"}).alias("label"),
    )


@REGISTRY.add("X21_elapsed", sql(
    "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(60000000 AS DOUBLE) AS minutes,"
    " strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events"
))
def x21(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf_dir, "events").select(
        "event_id", text.elapsed_minutes(start, ts).alias("minutes"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown")
    )


# --- preparations ---

_COUNTED = ("hospitals", "gp_practices", "pharmacies", "primary_schools", "supermarkets")


@REGISTRY.add(
    "L13_zone_weights",
    sql(
        "SELECT z.id, z.employment_all, COALESCE(z.park_ha, 0) AS park_ha, COALESCE(z.main_bua, 0) AS main_bua, "
        + ", ".join(f"COALESCE({s}.n, 0) AS {s}" for s in _COUNTED)
        + " FROM f_zone z "
        + " ".join(f"LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM f_poi WHERE service = '{s}' GROUP BY 1) {s} ON {s}.zone_id = z.id" for s in _COUNTED)
    ),
)
def l13(spark, sf_dir):
    counts = weights.service_counts(fx.view(spark, sf_dir, "f_poi"), "zone_id", "service", list(_COUNTED))
    spine = fx.view(spark, sf_dir, "f_zone").select("id", "employment_all", "park_ha", "main_bua")
    return weights.zone_weights(spine, counts, "zone_id")


_LISTS = {
    "gp_practices": "service = 'gp_practices'",
    "supermarkets": "service = 'supermarkets'",
    "primary_schools": "service = 'primary_schools' AND source_id % 3 <> 0",
    "secondary_schools": "service = 'primary_schools' AND source_id % 2 = 0",
    "hospitals": "service = 'hospitals'",
    "pharmacies": "service = 'pharmacies'",
    "main_bua": "source_id % 50 = 0",
    "sub_bua": "source_id % 20 = 0",
}


@REGISTRY.add(
    "J04_star_land_use",
    sql(
        "SELECT CAST(z.id AS VARCHAR) AS id, z.employment_all, z.employment_promo_1, "
        + ", ".join(f"COALESCE({s}.n, 0) AS {s}" for s in _LISTS)
        + ", COALESCE(z.park_ha, 0) AS park_ha, COALESCE(z.park_accesspoints, 0) AS park_accesspoints FROM f_zone z "
        + " ".join(f"LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM f_poi WHERE {where} GROUP BY 1) {s} ON {s}.zone_id = z.id" for s, where in _LISTS.items())
    ),
)
def j04(spark, sf_dir):
    """All zone weights from the prepared lists: one aggregate over their points, one join to the zones."""
    poi, zone = fx.view(spark, sf_dir, "f_poi"), fx.view(spark, sf_dir, "f_zone")

    def listed(service, zone_name):
        return poi.filter(_LISTS[service]).select("source_id", F.col("zone_id").alias(zone_name))

    code = F.col("id").cast("string")
    schools = poi.filter("service = 'primary_schools'").select(
        F.col("zone_id").alias("lsoa11"), (F.col("source_id") % 3 != 0).alias("type_primary"), (F.col("source_id") % 2 == 0).alias("type_secondary")
    )
    return weights.land_use(
        employment=zone.select(code.alias("lsoa11cd"), "employment_all", "employment_promo_1"),
        practices=listed("gp_practices", "lsoa11"),
        supermarkets=listed("supermarkets", "lsoa11cd"),
        schools=schools,
        hospitals=listed("hospitals", "lsoa"),
        pharmacies=listed("pharmacies", "lsoa11"),
        main_centres=listed("main_bua", "geo_code"),
        sub_centres=listed("sub_bua", "geo_code"),
        green=zone.filter("park_ha IS NOT NULL").select(code.alias("geo_code"), "park_ha", "park_accesspoints"),
    )


@REGISTRY.add(
    "L14_points_lookup",
    sql(
        _FALLBACK.replace("p.practice_code, p.postcode,", "CAST(p.practice_code AS VARCHAR) AS practice_code, p.practice_name, p.postcode,").replace(
            "f_practice p",
            "(SELECT practice_code, name AS practice_name, postcode FROM f_practice WHERE status = 'F' AND practice_code % 4 = 0"
            " UNION ALL SELECT practice_code, name, postcode FROM f_practice WHERE status = 'P') p",
        )
    ),
)
def l14(spark, sf_dir):
    source = fx.view(spark, sf_dir, "f_practice")
    blank = {f"X{i}": F.lit(None).cast("string") for i in range(1, 27)}
    filled = {
        **blank,
        "X1": F.col("practice_code").cast("string"),
        "X2": F.col("name"),
        "X10": F.col("postcode"),
        "X13": F.when(F.col("status") == "F", "A").otherwise("C"),
        "X26": F.when(F.col("practice_code") % 4 == 0, "4").otherwise("0"),
    }
    england_wales = source.select([c.alias(n) for n, c in filled.items()])
    scotland = source.filter(F.col("status") == "P").select("practice_code", "name", "postcode").toDF("PracticeCode", "GPPracticeName", "Postcode")
    return services.practices(england_wales, scotland, fx.view(spark, sf_dir, "f_postcode"))


_SHOPS = {
    "f_shop": """SELECT id, name, brand, CASE WHEN id % 19 = 0 THEN 'atm' END AS amenity,
                        CASE WHEN id % 2 = 0 THEN CAST(id * 7919 % 520 AS DOUBLE) * 1000 + 250 END AS x,
                        CASE WHEN id % 2 = 0 THEN CAST(id * 104729 % 520 AS DOUBLE) * 1000 + 250 END AS y FROM f_named""",
    "f_brand_shop": """SELECT id, CASE WHEN name LIKE '%ring' THEN 'Tesco extra' ELSE name END AS name,
                              CASE WHEN brand = 'Brand#7' THEN 'LIDL' ELSE brand END AS brand, amenity, x, y FROM f_shop""",
    "f_oa": "SELECT zone_id AS oa11cd, CASE zone_id % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'S' WHEN 2 THEN 'W' ELSE 'N' END || LPAD(CAST(zone_id AS VARCHAR), 3, '0') AS lsoa11cd FROM f_zonepoly",
}


@REGISTRY.add(
    "L15_supermarkets",
    sql(
        f"""SELECT p.id, p.name, p.brand, p.area_sqm, p.x, p.y, z.zone_id AS oa11cd, o.lsoa11cd FROM (
             SELECT id, name, brand, CAST(NULL AS DOUBLE) AS area_sqm, x, y FROM f_brand_shop WHERE name IS NOT NULL AND x IS NOT NULL AND amenity IS NULL
             UNION ALL SELECT b.id, b.name, b.brand, (s.xb - s.xa) * (s.yb - s.ya), (s.xa + s.xb) / 2, (s.ya + s.yb) / 2
               FROM f_brand_shop b JOIN f_site s ON s.id = b.id WHERE b.x IS NULL AND b.amenity IS NULL AND (s.xb - s.xa) * (s.yb - s.ya) > 280) p
           JOIN f_zonepoly z ON p.x BETWEEN z.xa AND z.xb AND p.y BETWEEN z.ya AND z.yb
           JOIN f_oa o ON o.oa11cd = z.zone_id
           WHERE (COALESCE(regexp_matches(p.name, '({"|".join(services.BRANDS)})', 'i'), FALSE)
                  OR COALESCE(regexp_matches(p.brand, '({"|".join(services.BRANDS)})', 'i'), FALSE))
             AND EXISTS (SELECT 1 FROM f_zonepoly m WHERE m.zone_id < 20 AND p.x BETWEEN m.xa AND m.xb AND p.y BETWEEN m.ya AND m.yb)
             AND regexp_matches(o.lsoa11cd, '^(E|S|W)')""",
        _SHOPS,
    ),
)
def l15(spark, sf_dir):
    shops = fx.spark_sql(spark, sf_dir, "SELECT * FROM f_brand_shop", {k: v.replace("VARCHAR", "STRING") for k, v in _SHOPS.items()})
    lookup_table = fx.spark_sql(spark, sf_dir, "SELECT oa11cd AS OA11CD, lsoa11cd AS LSOA11CD FROM f_oa", {k: v.replace("VARCHAR", "STRING") for k, v in _SHOPS.items()})
    edges = g.rectangle_edges(fx.view(spark, sf_dir, "f_site"), "id")
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    points = services.supermarket_points(shops, edges.join(shops.filter(F.col("x").isNull()).select(F.col("id").alias("poly_id")), "poly_id", "left_semi"))
    return services.supermarkets(points, zones.filter(F.col("poly_id") < 20), zones, lookup_table)


@REGISTRY.add(
    "L16_employment_share",
    sql("SELECT CAST(id % 3 AS VARCHAR) AS region, CAST(SUM(employment_all) AS BIGINT) AS emp, ROUND(SUM(employment_all) / CAST((SELECT SUM(employment_all) FROM f_landuse) AS DOUBLE), 6) AS percent FROM f_landuse GROUP BY 1"),
)
def l16_share(spark, sf_dir):
    land = fx.view(spark, sf_dir, "f_landuse")
    shares = stats.share_of_total(land, text.first_letter((F.col("id") % 3).cast("string")), "region", "employment_all", "emp", "percent")
    return shares.withColumn("percent", F.round("percent", 6))


@REGISTRY.add(
    "L16_employment",
    sql(
        "SELECT 'Z' || CAST(z.id AS VARCHAR) AS lsoa11cd, CAST(z.employment_all AS DOUBLE) AS employment_all, s.employment_promo_1 AS employment_manufacturing_1,"
        " s.employment_economy_3 AS employment_education_2 FROM f_zone z LEFT JOIN f_zone s ON s.id = z.id AND s.id % 11 <> 0 WHERE z.id % 13 <> 0"
    ),
)
def l16(spark, sf_dir):
    zone = fx.view(spark, sf_dir, "f_zone")
    code = F.concat(F.lit("Z"), "id")
    every = zone.select(code.alias("Mnemonic"), F.when(F.col("id") % 13 != 0, F.col("employment_all").cast("double")).alias("Total"))
    sector = zone.filter(F.col("id") % 11 != 0).select(F.lit("x").alias("area"), code, "employment_promo_1", "employment_economy_3", F.lit(1))
    sector = sector.toDF("Area", "mnemonic", "3 : Manufacturing (C)", "16 : Education (P)", "..5")
    return services.employment(every, sector)


@REGISTRY.add(
    "L17_school_rules",
    sql(
        """SELECT urn, type_primary, type_secondary, CONCAT(COALESCE(street, 'NA'), ' | ', COALESCE(town, 'NA')) AS address,
                  TRIM(regexp_replace(street, '\\s+', ' ', 'g')) AS street_clean, NULLIF(phase, '---') AS phase
           FROM (SELECT *, COALESCE(phase IN ('Primary', 'Middle deemed primary', 'All-through'), FALSE) AS type_primary,
                   COALESCE(phase IN ('Secondary', 'Middle deemed secondary', 'All-through'), FALSE) AND low_age < 16 AND high_age >= 16 AS type_secondary
                 FROM f_school) t WHERE type_primary OR type_secondary"""
    ),
)
def l17_rules(spark, sf_dir):
    primary, secondary = services.england_flags("phase", "low_age", "high_age")
    school = fx.view(spark, sf_dir, "f_school").withColumns({"type_primary": primary, "type_secondary": secondary})
    return school.filter(F.col("type_primary") | F.col("type_secondary")).select(
        "urn", "type_primary", "type_secondary", nulls.paste(" | ", "street", "town").alias("address"),
        text.squish("street").alias("street_clean"), nulls.blank_to_null("phase", "---").alias("phase"),
    )


_SCHOOLS = {
    "f_eng": """SELECT s.urn, 'School ' || CAST(s.urn AS VARCHAR) AS name, s.phase, s.low_age, s.high_age, s.street, s.town,
                       CASE WHEN s.urn % 9 = 0 THEN NULL WHEN s.urn % 10 = 0 THEN '999' ELSE 'E' || CAST(s.urn % 100 AS VARCHAR) END AS lsoa_code,
                       CAST(s.urn * 7919 % 500 AS DOUBLE) * 1000 + 250 AS easting, CAST(s.urn * 104729 % 500 AS DOUBLE) * 1000 + 250 AS northing,
                       'PC' || CAST(s.urn AS VARCHAR) AS postcode FROM f_school s WHERE s.urn % 3 = 0""",
    "f_wal": """SELECT urn, 'Ysgol ' || CAST(urn AS VARCHAR) AS name, CASE WHEN phase = 'Middle deemed secondary' THEN 'Middle' ELSE phase END AS sector,
                       street, town, '  PC' || CAST(urn AS VARCHAR) || ' ' AS postcode FROM f_school WHERE urn % 3 = 1""",
    "f_sco": """SELECT urn, 'Sgoil ' || CAST(urn AS VARCHAR) AS name, CASE WHEN phase = 'Primary' THEN 'Yes' WHEN phase = 'Secondary' THEN 'No' END AS p,
                       CASE WHEN high_age >= 16 THEN 'Yes' ELSE 'No' END AS s, street, town, 'PC' || CAST(urn AS VARCHAR) AS postcode
                FROM f_school WHERE urn % 3 = 2""",
}


@REGISTRY.add(
    "L17_schools_gb",
    sql(
        """SELECT CAST(e.urn AS VARCHAR) AS source_id, e.name, CONCAT(COALESCE(e.street, 'NA'), ' | NA | NA | ', e.postcode, ' | ', COALESCE(e.town, 'NA')) AS address,
                  e.type_primary, e.type_secondary, COALESCE(e.code, CAST(z.zone_id AS VARCHAR)) AS lsoa11, e.postcode, CAST(NULL AS DOUBLE) AS lat
           FROM (SELECT *, CASE WHEN regexp_matches(lsoa_code, '[A-Za-z]') THEN lsoa_code END AS code,
                        COALESCE(phase IN ('Primary', 'Middle deemed primary', 'All-through'), FALSE) AS type_primary,
                        COALESCE(phase IN ('Secondary', 'Middle deemed secondary', 'All-through'), FALSE) AND low_age < 16 AND high_age >= 16 AS type_secondary
                 FROM f_eng) e
           LEFT JOIN f_zonepoly z ON e.code IS NULL AND e.easting BETWEEN z.xa AND z.xb AND e.northing BETWEEN z.ya AND z.yb
           WHERE (e.type_primary OR e.type_secondary) AND e.urn % 13 <> 0 AND e.urn % 17 <> 0 AND e.urn % 19 <> 0
           UNION ALL
           SELECT CAST(w.urn AS VARCHAR), w.name, CONCAT(COALESCE(w.street, 'NA'), ' | ', COALESCE(w.town, 'NA'), ' | NA | NA | ', w.postcode),
                  w.a, w.b, c.lsoa11, TRIM(w.postcode), c.lat
           FROM (SELECT *, sector = 'Primary' OR sector = 'Middle' AS a, sector = 'Secondary' OR sector = 'Middle' AS b FROM (
                   SELECT urn, name, NULLIF(sector, '---') AS sector, street, town, postcode FROM f_wal) n) w
           LEFT JOIN f_postcode c ON c.pcds = TRIM(w.postcode) WHERE w.a OR w.b
           UNION ALL
           SELECT CAST(s.urn AS VARCHAR), s.name, CONCAT(COALESCE(s.street, 'NA'), ' | ', COALESCE(s.town, 'NA'), ' | NA'), s.p = 'Yes', s.s = 'Yes',
                  CASE WHEN c.lat IS NULL THEN COALESCE(o.s_name, c.lsoa11) ELSE c.lsoa11 END, s.postcode, COALESCE(c.lat, o.s_acctbal)
           FROM f_sco s LEFT JOIN f_postcode c ON c.pcds = s.postcode LEFT JOIN supplier o ON o.s_suppkey * 17 = s.urn
           WHERE s.p = 'Yes' OR s.s = 'Yes'""",
        _SCHOOLS,
    ),
)
def l17(spark, sf_dir):
    """Three national lists with their own rules. England's latitude comes from the grid and is left out here."""
    extra = {k: v.replace("VARCHAR", "STRING") for k, v in _SCHOOLS.items()}
    eng, wal, sco = (fx.spark_sql(spark, sf_dir, f"SELECT * FROM {n}", extra) for n in ("f_eng", "f_wal", "f_sco"))
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    england = eng.select(
        F.col("urn").alias("URN"), F.col("name").alias("EstablishmentName"), F.when(F.col("urn") % 13 == 0, "Closed").otherwise("Open").alias("EstablishmentStatus (name)"),
        F.when(F.col("urn") % 17 == 0, "Selective").otherwise("Not applicable").alias("AdmissionsPolicy (name)"),
        F.when(F.col("urn") % 19 == 0, "Other independent school").otherwise("Community school").alias("TypeOfEstablishment (name)"),
        F.col("phase").alias("PhaseOfEducation (name)"), F.col("low_age").alias("StatutoryLowAge"), F.col("high_age").alias("StatutoryHighAge"),
        F.col("lsoa_code").alias("LSOA (code)"), F.col("easting").alias("Easting"), F.col("northing").alias("Northing"),
        F.col("street").alias("Street"), nulls.typed_null("string").alias("Locality"), nulls.typed_null("string").alias("Address3"),
        F.col("postcode").alias("Postcode"), F.col("town").alias("Town"),
    )
    none = nulls.typed_null("string")
    wales = wal.select(
        F.col("urn").alias("School Number"), F.col("name").alias("School Name"), F.col("sector").alias("Sector"), F.col("street").alias("Address 1"),
        F.col("town").alias("Address 2"), none.alias("Address 3"), none.alias("Address 4"), F.col("postcode").alias("Postcode"),
    )
    scotland = sco.select(
        F.col("urn").alias("Seed Code"), F.col("name").alias("School Name"), F.col("p").alias("Primary Department"), F.col("s").alias("Secondary Department"),
        F.col("street").alias("Address Line1"), F.col("town").alias("Address Line2"), none.alias("Address Line3"), F.col("postcode").alias("Post Code"),
    )
    overrides = fx.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 17).cast("string").alias("source_id"), F.col("s_name").alias("lsoa11"), F.col("s_acctbal").alias("lat"),
        F.lit(0.0).alias("long"),
    )
    codes = fx.view(spark, sf_dir, "f_postcode")
    north = services.schools_england(england, zones).withColumn("lat", nulls.typed_null("double"))
    both = services.schools(north, services.schools_wales(wales, codes), services.schools_scotland(scotland, codes, overrides))
    return both.drop("long")


_CENTRES = {
    "f_centre": "SELECT id, 'Town ' || CAST(id % 200 AS VARCHAR) AS name, CAST(id % 977 AS DOUBLE) AS pop11, x, y FROM f_point",
    "f_zone_centre": """SELECT o_orderkey AS zone, CASE o_orderstatus WHEN 'F' THEN 'lsoa11' WHEN 'O' THEN 'dz11' ELSE 'lsoa01' END AS zone_type,
                               'Town ' || CAST(o_custkey % 61 AS VARCHAR) AS main_bua, 'Town ' || CAST(o_custkey % 150 AS VARCHAR) AS nearest_bua FROM {orders}""",
}
_DISTANCE = "GREATEST(z.xa - p.x, 0, p.x - z.xb) * GREATEST(z.xa - p.x, 0, p.x - z.xb) + GREATEST(z.ya - p.y, 0, p.y - z.yb) * GREATEST(z.ya - p.y, 0, p.y - z.yb)"


@REGISTRY.add(
    "L18_urban_centres",
    sql(
        f"""SELECT c.kind, p.name, p.pop11, p.zone_id AS geo_code FROM (
              SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, zone_id) AS rn, MIN(d) OVER (PARTITION BY id) AS best FROM (
                SELECT p.*, z.zone_id, {_DISTANCE} AS d FROM f_centre p, f_zonepoly z) a) p
            JOIN (SELECT DISTINCT 'main_bua' AS kind, main_bua AS name FROM f_zone_centre WHERE zone_type IN ('lsoa11', 'dz11')
                  UNION SELECT DISTINCT 'sub_bua', nearest_bua FROM f_zone_centre WHERE zone_type IN ('lsoa11', 'dz11')) c ON c.name = p.name
            WHERE (p.best = 0 AND p.d = 0) OR (p.best > 0 AND p.rn = 1)""",
        _CENTRES,
    ),
)
def l18(spark, sf_dir):
    extra = {k: v.replace("VARCHAR", "STRING") for k, v in _CENTRES.items()}
    centres, zone_centres = (fx.spark_sql(spark, sf_dir, f"SELECT * FROM {n}", extra) for n in ("f_centre", "f_zone_centre"))
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    main, sub = services.urban_centres(centres, zone_centres, zones)
    return reshape.stack_labelled({"main_bua": main, "sub_bua": sub}, "kind")


_HOSPITALS = {
    "f_hosp_eng": """SELECT id, CASE WHEN name LIKE '%ring' THEN name || ' Day Hospital' WHEN name LIKE 'red%' THEN name || ' Elder unit' ELSE name END AS name,
                            CASE sub_type WHEN 'PROMO' THEN 'Mental Health Hospital' ELSE sub_type END AS sub_type,
                            CASE WHEN id % 6 = 0 THEN 'none' ELSE 'PC' || CAST(id % 150 AS VARCHAR) END AS postcode,
                            CAST(id * 7919 % 500 AS DOUBLE) * 1000 + 250 AS x, CAST(id * 104729 % 500 AS DOUBLE) * 1000 + 250 AS y FROM f_named WHERE id % 2 = 0""",
    "f_hosp_sco": """SELECT id, name || ' ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' dental' ELSE '' END AS name, CASE WHEN id % 4 = 1 THEN '' WHEN id % 4 = 3 THEN 'S' || CAST(id AS VARCHAR) END AS zone,
                            CAST(id * 7919 % 500 AS DOUBLE) * 1000 + 250 AS x, CAST(id * 104729 % 500 AS DOUBLE) * 1000 + 250 AS y FROM f_named WHERE id % 2 = 1""",
    "f_hosp_wal": "SELECT c_name AS name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'CHC Local Committee' ELSE c_mktsegment END AS type, 'W' || CAST(c_nationkey AS VARCHAR) AS lsoa11 FROM {customer}",
}
_DENY = f"'({'|'.join((*services.PSYCHIATRIC, *services.SPECIALIST, 'committee', *services.DAY_CARE))})', 'i'"


@REGISTRY.add(
    "L19_hospitals",
    sql(
        f"""SELECT CAST(h.id AS VARCHAR) AS source_id, h.name, COALESCE(c.lsoa11, CAST(z.zone_id AS VARCHAR)) AS lsoa FROM f_hosp_eng h
              LEFT JOIN (SELECT * FROM f_postcode WHERE doterm IS NULL) c ON c.pcds = h.postcode
              LEFT JOIN f_zonepoly z ON c.lsoa11 IS NULL AND h.x BETWEEN z.xa AND z.xb AND h.y BETWEEN z.ya AND z.yb
              WHERE h.sub_type <> 'Mental Health Hospital' AND NOT COALESCE(regexp_matches(h.name, {_DENY}), FALSE) AND h.name <> 'Jersey General Hospital'
            UNION ALL SELECT NULL, s.name, CASE WHEN COALESCE(s.zone, '') = '' THEN CAST(z.zone_id AS VARCHAR) ELSE s.zone END FROM f_hosp_sco s
              LEFT JOIN f_zonepoly z ON COALESCE(s.zone, '') = '' AND s.x BETWEEN z.xa AND z.xb AND s.y BETWEEN z.ya AND z.yb
              WHERE NOT COALESCE(regexp_matches(s.name, {_DENY}), FALSE)
            UNION ALL SELECT NULL, name, lsoa11 FROM f_hosp_wal WHERE type <> 'CHC Local Committee'""",
        _HOSPITALS,
    ),
)
def l19(spark, sf_dir):
    extra = {k: v.replace("VARCHAR", "STRING") for k, v in _HOSPITALS.items()}
    eng, sco, wal = (fx.spark_sql(spark, sf_dir, f"SELECT * FROM {n}", extra) for n in ("f_hosp_eng", "f_hosp_sco", "f_hosp_wal"))
    # Places well inside the grid's kilometre squares, so that the conversion's error cannot move them to another zone.
    england = geodesy.grid_to_wgs84(eng, "x", "y", "lat", "long").select(
        F.col("id").alias("OrganisationID"), F.col("name").alias("OrganisationName"), F.col("sub_type").alias("SubType"), F.col("postcode").alias("Postcode"),
        F.col("lat").alias("Latitude"), F.col("long").alias("Longitude"),
    )
    scotland = sco.select(F.col("name").alias("LocationName"), F.col("zone").alias("DataZone"), F.col("x").alias("XCoordinate"), F.col("y").alias("YCoordinate"))
    live = services.live_codes(fx.view(spark, sf_dir, "f_postcode"))
    zones = g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")
    return services.hospitals(england, scotland, wal, live, zones)


@REGISTRY.add(
    "L20_no_fallback",
    sql(
        """SELECT CAST(p.practice_code AS VARCHAR) AS source_id, p.name, p.postcode AS post_code, c.lsoa11 FROM f_practice p
             LEFT JOIN (SELECT * FROM f_postcode WHERE doterm IS NULL) c ON c.pcds = p.postcode WHERE p.status IN ('F', 'O')
           UNION ALL SELECT CAST(practice_code AS VARCHAR), name, postcode, 'S' || CAST(practice_code % 7 AS VARCHAR) FROM f_practice WHERE status = 'P'"""
    ),
)
def l20(spark, sf_dir):
    source = fx.view(spark, sf_dir, "f_practice")
    england = source.filter(F.col("status") == "F").select("practice_code", "name", "postcode")
    wales = source.filter(F.col("status") == "O").select("practice_code", "name", "postcode")
    scotland = source.filter(F.col("status") == "P").select("practice_code", "name", "postcode", F.concat(F.lit("S"), F.col("practice_code") % 7))
    return services.pharmacies(
        england.toDF("Pharmacy ODS Code (F-Code)", "Pharmacy Trading Name", "Post Code"),
        wales.toDF("Account", "Trading Name", "Post Code"),
        scotland.toDF("DispCode", "DispLocationName", "DispLocationPostcode", "Datazone2011"),
        services.live_codes(fx.view(spark, sf_dir, "f_postcode")),
    )
