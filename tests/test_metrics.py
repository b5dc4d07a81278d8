"""Hand-computed measures, their invariants and the shape of their plan."""

import pytest
from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import naming
from isoreach.plans import metrics
from isoreach.sources import sinks

PAIRS = [
    # mode, time, from, to, minutes
    ("pt", "am", "a", "a", 0),
    ("pt", "am", "a", "b", 15),
    ("pt", "am", "a", "c", 16),
    ("pt", "am", "b", "c", 121),
    ("pt", "am", "b", "b", None),
    ("walk", None, "a", "b", 30),
    ("walk", None, "c", "x", 5),
]
LAND = [("a", 10, 1, 0.5, 0), ("b", 20, 0, 1.5, 2), ("c", 30, 0, 0.0, 0)]


@pytest.fixture(scope="module")
def small(spark):
    matrix = spark.createDataFrame(PAIRS, "mode string, time_of_day string, from_id string, to_id string, travel_time int")
    land = spark.createDataFrame(LAND, "id string, employment_all long, hospitals long, park_ha double, park_accesspoints long")
    return matrix, land


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hand_computed(small):
    table = metrics.access_table(*small)
    got = {(r["geo_code"], r["mode"], r["time_of_day"]): r for r in table.collect()}
    assert set(got) == {("a", "pt", "am"), ("b", "pt", "am"), ("a", "walk", None), ("c", "walk", None)}
    a = got["a", "pt", "am"]
    assert (a["access_employment_all_15"], a["access_employment_all_30"]) == (30, 60)
    assert (a["access_employment_all_15_pct"], a["access_parks_15"]) == (50.0, 2.0)
    assert (a["nearest_hospitals"], a["nearest_parks"]) == (0, 15)
    b = got["b", "pt", "am"]
    assert (b["access_employment_all_120"], b["nearest_hospitals"]) == (0, None)
    walk = got["a", "walk", None]
    assert (walk["access_employment_all_15"], walk["access_employment_all_30"], walk["nearest_parks"]) == (0, 20, 30)
    assert got["c", "walk", None]["access_employment_all_120"] == 0


def test_share_of_an_empty_service_is_null(spark, small):
    matrix, land = small
    table = metrics.access_table(matrix, land.withColumn("hospitals", F.lit(0).cast("bigint")))
    assert table.select("access_hospitals_120_pct").distinct().collect()[0][0] is None


def test_service_lists(small):
    assert metrics.cumulative_services(small[1]) == {"employment_all": "employment_all", "hospitals": "hospitals", "parks": "park_ha"}
    assert metrics.nearest_services(small[1]) == {"hospitals": "hospitals", "parks": "park_accesspoints"}


def test_full_column_set(spark):
    names = ["employment_all"] + [f"employment_s_{i}" for i in range(1, 19)]
    names += ["gp_practices", "supermarkets", "primary_schools", "secondary_schools", "hospitals", "pharmacies", "main_bua", "sub_bua"]
    names += ["park_ha", "park_accesspoints", "park_accesspoints_original"]
    land = spark.createDataFrame([("a", *[1] * len(names))], ", ".join(["id string"] + [f"{n} long" for n in names]))
    assert len(metrics.cumulative_services(land)) == 28
    assert len(metrics.nearest_services(land)) == 9
    matrix = spark.createDataFrame([PAIRS[0]], "mode string, time_of_day string, from_id string, to_id string, travel_time int")
    table = metrics.access_table(matrix, land)
    assert len(table.columns) == 3 + 224 + 224 + 9
    assert table.first()["access_employment_s_18_15"] == 1


def test_invariants(spark, sf_dir):
    ttm, land = fx.view(spark, sf_dir, "f_ttm"), fx.view(spark, sf_dir, "f_landuse")
    table = metrics.access_table(ttm, land).cache()
    services = metrics.cumulative_services(land)
    falling = F.lit(False)
    beyond = F.lit(False)
    for s in services:
        for low, high in zip(metrics.CUTS, metrics.CUTS[1:]):
            falling = falling | (F.col(naming.access_name(s, low)) > F.col(naming.access_name(s, high)))
        beyond = beyond | ~F.col(naming.pct_name(s, 120)).between(0, 100)
    assert table.filter(falling).count() == 0
    assert table.filter(beyond).count() == 0
    odd = F.lit(False)
    for s in ("hospitals", "gp_practices", "main_bua"):
        for cut in metrics.CUTS:
            reached = F.col(naming.access_name(s, cut)) > 0
            odd = odd | (reached != F.coalesce(F.col(naming.nearest_name(s)) <= cut, F.lit(False)))
    assert table.filter(odd).count() == 0


def test_plan_reads_the_matrix_once_and_never_loops(spark, sf_dir, tmp_path):
    path = str(tmp_path / "ttm")
    sinks.write_matrix(fx.view(spark, sf_dir, "f_ttm"), path, 4)
    matrix = spark.read.schema("from_id long, to_id long, travel_time int, mode string, time_of_day string").parquet(path)
    land = fx.view(spark, sf_dir, "f_landuse")
    plan = plan_of(metrics.measures(matrix, land))
    assert plan.count("ReadSchema: struct<from_id:bigint,to_id:bigint,travel_time:int>") == 1
    assert "BroadcastHashJoin [to_id" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shuffled_weights_give_the_same_measures(spark, sf_dir):
    ttm, land = fx.view(spark, sf_dir, "f_ttm"), fx.view(spark, sf_dir, "f_landuse")
    only = {"hospitals": "hospitals", "parks": "park_ha"}
    a = metrics.measures(ttm, land, only, {"hospitals": "hospitals"})
    b = metrics.measures(ttm, land, only, {"hospitals": "hospitals"}, limit=0)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_public_tables(spark, small, tmp_path):
    table = metrics.access_table(*small)
    sinks.write_service_tables(table, ["employment_all", "hospitals"], metrics.CUTS, str(tmp_path))
    walk = spark.read.csv(str(tmp_path / "hospitals" / "access_hospitals_walk.csv"), header=True)
    assert "time_of_day" not in walk.columns and "nearest_hospitals" not in walk.columns
    pt = spark.read.csv(str(tmp_path / "employment_all" / "access_employment_all_pt.csv"), header=True)
    assert pt.filter("geo_code = 'a'").select("access_employment_all_15_pct", "time_of_day").first() == ("50", "am")
    listing = sinks.inventory(spark, str(tmp_path)).filter("type = 'directory'")
    assert listing.count() == 2 + 4


def test_matrix_layout_splits_one_hot_origin(spark, tmp_path):
    hot = spark.range(20_000).selectExpr("'walk' AS mode", "CAST(NULL AS STRING) AS time_of_day", "1L AS from_id", "id AS to_id", "CAST(id % 90 AS INT) AS travel_time")
    path = str(tmp_path / "hot")
    sinks.write_matrix(hot, path, 5)
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(per_file) == 5 and max(r["count"] for r in per_file) < 10_000


def test_fanout_splits_one_hot_folder(spark, tmp_path):
    zone = F.col("id").cast("string").alias("geo_code")
    service = F.when(F.col("id") % 3 == 0, "parks").otherwise("hospitals").alias("service")
    long = spark.range(9000).select(zone, service, F.lit("walk").alias("mode"), F.lit(1.5).alias("accessibility"))
    path = str(tmp_path / "fan")
    sinks.write_long_measures(long, path, rows_per_file=1000)
    back = spark.read.parquet(path)
    files = back.groupBy("service", F.col("_metadata.file_name")).count().collect()
    assert back.count() == 9000 and max(r["count"] for r in files) < 2500
    assert sum(r["service"] == "hospitals" for r in files) >= 5 and len(files) <= 11


def test_complete_weights_give_the_same_measures(small):
    matrix, land = small
    known = matrix.filter("to_id != 'x'")
    a, b = metrics.measures(known, land), metrics.measures(known, land, complete=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
