"""Versioned slices, states at many instants, and the removal of intermediate tables."""

import datetime
import random

import pytest

from isoreach.session import folder_names, materialise, remove_scratch
from isoreach.sources import readers, versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    a, b, new = (spark.createDataFrame([(k, n)], "k long, name string") for k, n in ((1, "a"), (2, "b"), (3, "new")))
    assert versions.write({"a": a, "b": b}, root) == 1
    old = versions.read(spark, root)
    assert versions.write({"b": new}, root) == 2
    assert rows(versions.read(spark, root)) == [(1, "a", "a"), (3, "new", "b")]
    assert rows(versions.read(spark, root, 1)) == rows(old) == [(1, "a", "a"), (2, "b", "b")]
    with pytest.raises(ValueError):
        versions.read(spark, root, 7)
    with pytest.raises(ValueError):
        versions.write({}, root)


def test_a_writer_that_stops_halfway(spark, tmp_path):
    root = str(tmp_path / "t")
    good = spark.createDataFrame([(1,)], "k long")
    versions.write({"a": good}, root)
    broken = spark.range(4).selectExpr("CASE WHEN id = 3 THEN raise_error('lost') ELSE id END AS k")
    with pytest.raises(Exception, match="lost"):
        versions.write({"a": spark.createDataFrame([(9,)], "k long"), "b": broken}, root)
    assert rows(versions.read(spark, root)) == [(1, "a")]
    left = set(folder_names(spark, f"{root}/data"))
    assert len(left) >= 2
    assert versions.write({"c": good}, root) == 2
    gone = versions.expire(spark, root)
    assert len(gone) == len(left) - 1 and rows(versions.read(spark, root)) == [(1, "a"), (1, "c")]
    assert versions.versions(spark, root) == [2]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "k long")
    versions.write({"a": one}, root)
    monkeypatch.setattr(versions, "versions", lambda *_: [])  # has not yet seen the other's version
    with pytest.raises(RuntimeError):
        versions.write({"a": one}, root)


def test_replacing_all_slices(spark, tmp_path):
    root = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "k long")
    versions.write({"a": one, "b": one}, root)
    versions.write({"c": one}, root, replace=True)
    assert rows(versions.read(spark, root)) == [(1, "c")]


def test_states_at_many_instants(spark):
    rng = random.Random(3)
    day = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=rng.randint(0, 2000))
    seen = [(rng.randint(1, 20), day(), v) for v in range(300)] + [(None, day(), 900), (3, None, 901)]
    times = [day() for _ in range(30)] + [seen[0][1], datetime.datetime(2019, 1, 1), datetime.datetime(2030, 1, 1)]
    df = spark.createDataFrame(seen, "id long, ts timestamp, version long")
    for chosen in (times, times[:1], []):
        instants = spark.createDataFrame([(t,) for t in [*chosen, *chosen[:1], None]], "instant timestamp")
        got = rows(readers.as_of_many(df, "id", "ts", instants, "version").select("instant", "id", "version"))
        want = []
        for t in set(chosen):
            for i in {r[0] for r in seen}:
                known = [(ts, v) for k, ts, v in seen if k == i and ts is not None and ts <= t]
                if known:
                    want.append((t, i, max(known)[1]))
        assert got == sorted(want, key=str)


def test_removing_intermediate_tables(spark):
    df = materialise(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert folder_names(spark, path) and remove_scratch(spark) > 0
    assert folder_names(spark, path) == [] and remove_scratch(spark) == 0
