"""Inputs beyond the test tables on which rows or values were once lost."""

import pytest
from pyspark.sql import functions as F

from isoreach.operators import geometry as g
from isoreach.operators import spatial as sp
from isoreach.operators import stats
from isoreach.plans import analysis, metrics, services
from isoreach.schemas import schema
from isoreach.session import scratch_path
from isoreach.sources import readers, sinks


def squares(spark, *boxes):
    rows = [(i, float(xa), float(ya), float(xb), float(yb)) for i, (xa, ya, xb, yb) in enumerate(boxes)]
    return g.rectangle_edges(spark.createDataFrame(rows, "zone_id long, xa double, ya double, xb double, yb double"), "zone_id")


def edges(spark, polygons):
    rows = []
    for k, ring in enumerate(polygons):
        for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True)):
            rows.append((k, 0, i, *map(float, a), *map(float, b)))
    return spark.createDataFrame(rows, "poly_id long, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")


def test_point_at_any_distance_has_a_nearest_polygon(spark):
    zones = squares(spark, (0, 0, 10, 10), (20, 0, 30, 10))
    points = spark.createDataFrame([(1, 2e8, 5.0), (2, -3e12, 0.0), (3, 15.0, 5.0)], "id long, x double, y double")
    got = {r["id"]: (r["poly_id"], r["distance"]) for r in sp.nearest_polygon(points, zones).collect()}
    assert got == {1: (1, 2e8 - 30), 2: (0, 3e12), 3: (0, 5.0)}
    assert sp.nearest_polygon(points.limit(0), zones).count() == 0
    placed = sp.zone_or_nearest(points, zones, "zone").filter("zone IS NULL")
    assert placed.count() == 0


@pytest.mark.parametrize("shift", [0.01, 0.001, 1.0])
def test_sliver_of_two_large_triangles(spark, shift):
    left = edges(spark, [[(0, 0), (100_000, 0), (0, 100_000)]])
    right = edges(spark, [[(100_000, 100_000), (-shift, 100_000), (100_000, -shift)]])
    got = sp.overlay_areas(left, right).collect()
    strip = shift * 100_000  # along the shared long side
    assert len(got) == 1 and got[0]["area"] == pytest.approx(strip, rel=1e-3)


def test_touching_squares_share_nothing(spark):
    a, b = squares(spark, (0, 0, 100_000, 100_000)), squares(spark, (100_000, 0, 200_000, 100_000))
    c = edges(spark, [[(0, 0), (100_000, 0), (0, 100_000)]])
    d = edges(spark, [[(100_000, 100_000), (0, 100_000), (100_000, 0)]])
    assert sp.overlay_areas(a, b).count() == 0
    assert sp.overlay_areas(c, d).count() == 0


def measured(spark):
    matrix = spark.createDataFrame([("walk", None, 1, 1, 8), ("walk", None, 1, 2, 25)], "mode string, time_of_day string, from_id long, to_id long, travel_time int")
    land = spark.createDataFrame([(1, 3), (2, 1)], "id long, shops long")
    return matrix, land


def test_any_cuts(spark):
    matrix, land = measured(spark)
    access = metrics.measures(matrix, land, {"shops": "shops"}, {}, cuts=(10, 20, 30))
    long = metrics.relative_long(access, land, {"shops": "shops"})
    assert {r["time_cut"]: r["accessibility"] for r in long.collect()} == {10: 75.0, 20: 75.0, 30: 100.0}
    with pytest.raises(ValueError, match="access_shops_15"):
        metrics.relative_long(access, land, {"shops": "shops"}, cuts=(15,))
    with pytest.raises(ValueError, match="pubs"):
        metrics.relative_long(access, land, {"shops": "shops", "pubs": "pubs"})


def test_unknown_mode_is_an_error_and_own_modes_are_columns(spark):
    rows = [("pt", None, 1, "shops", 15, 50.0), ("bicycle", None, 1, "shops", 15, 25.0), ("car", None, 1, "shops", 15, 90.0)]
    long = spark.createDataFrame(rows, "mode string, time_of_day string, geo_code long, service string, time_cut int, accessibility double")
    got = analysis.mode_ratio(long, modes=("bicycle", "pt", "car")).first()
    assert (got["car"], got["pt_bike_diff"], got["bike"]) == (90.0, 0.5, "pt")
    with pytest.raises(Exception, match="unknown mode: car"):
        analysis.mode_ratio(long).collect()
    lost = long.select("mode", "time_of_day", "service", F.lit(None).cast("int").alias("tt_minutes"))
    assert analysis.unreachable(lost, ("bicycle", "pt", "car")).first()["car"] == 1
    with pytest.raises(Exception, match="unknown mode: car"):
        analysis.unreachable(lost).collect()


def write(spark, name, text):
    path = scratch_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_columns_by_name(spark):
    path = write(spark, "shuffled", "doterm,lat,pcds\n,51.5,AB1\nNA,x,\n")
    wanted = schema("pcds string, lat double, doterm string")
    assert [tuple(r) for r in readers.read_csv(spark, path, wanted).collect()] == [("AB1", 51.5, None), (None, None, None)]
    kept = [tuple(r) for r in readers.read_keeping_blanks(spark, path, wanted).collect()]
    assert kept[0] == ("AB1", 51.5, "")
    with pytest.raises(ValueError, match="oa11"):
        readers.read_csv(spark, path, schema("pcds string, oa11 string"))


def test_tree_of_files_with_different_headers(spark):
    root = scratch_path(spark, "tree")
    a = spark.createDataFrame([(1, "am", 5)], "geo_code long, time_of_day string, minutes int")
    sinks.write_csv(a, f"{root}/a")
    sinks.write_csv(a.select(F.lit(9).alias("minutes"), F.lit("x").alias("more"), F.lit(2).alias("geo_code")), f"{root}/b")
    wanted = schema("geo_code long, time_of_day string, minutes int")
    got = readers.read_tree(spark, root, "*.csv", wanted, absent=True).drop("file_path")
    assert sorted(map(tuple, got.collect())) == [(1, "am", 5), (2, None, 9)]
    with pytest.raises(ValueError, match="time_of_day"):
        readers.read_tree(spark, root, "*.csv", wanted)


def test_places_are_told_apart(spark):
    zones = squares(spark, (0, 0, 10, 10), (20, 0, 30, 10))
    rows = [("k", 5.0, 5.0, None), ("k", 25.0, 5.0, ""), (None, 25.0, 5.0, None), ("z", 25.0, 5.0, "own"), ("far", 99.0, 99.0, None)]
    df = spark.createDataFrame(rows, "key string, x double, y double, zone string")
    got = services.zone_by_point(df, zones, "zone", "x", "y", "key")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(str, [("k", 5.0, 5.0, "0"), ("k", 25.0, 5.0, "1"), (None, 25.0, 5.0, "1"), ("z", 25.0, 5.0, "own"), ("far", 99.0, 99.0, None)])
    )


def test_matrix_writer_keeps_pairs_without_a_time(spark):
    matrix, _ = measured(spark)
    path = scratch_path(spark, "matrix")
    sinks.write_matrix(matrix.withColumn("travel_time", F.when(F.col("to_id") == 1, F.col("travel_time"))), path, 2)
    assert sorted(r["travel_time"] or 0 for r in spark.read.parquet(path).collect()) == [0, 8]


def test_share_of_total_keeps_groups_spread(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 7 AS double) AS v")
    got = stats.share_of_total(df, F.col("id"), "id", "v", "total", "share")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["id", "total", "share"] and got.count() == 1000
    total = sum(i % 7 for i in range(1000))
    assert all(abs(r["share"] - (r["id"] % 7) / total) < 1e-12 for r in got.collect())
    assert stats.share_of_total(df.limit(0), F.col("id"), "id", "v", "total", "share").count() == 0
