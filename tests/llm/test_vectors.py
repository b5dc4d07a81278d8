import numpy as np
import pytest

from isoreach.llm import metric, registry
from tests.llm.helpers import rows

COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def plain(given, cosine=0.93):
    """Of (vec_id, vector, label); ids are distinct."""
    given = sorted(given, key=lambda r: r[0])
    n = len(given)
    unit = np.full((n, 16 if n else 0), np.nan)
    for i, (_, v, label) in enumerate(given):
        if label is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = unit @ unit.T >= cosine
    np.fill_diagonal(links, False)
    labels = [r[2] for r in given]
    links &= np.array([[a == b for b in labels] for a in labels])
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(links), strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return sorted(((r[0], int(links[i].sum()), given[find(i)][0], find(i) == i) for i, r in enumerate(given)), key=str)


def clustered(seed):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(30):
        center = rng.normal(size=16)
        for _ in range(60 if c == 0 else int(rng.integers(1, 12))):
            v = center + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.35])
            out.append((len(out) * 3 + 1, v.astype(np.float32).tolist(), int(c % 3)))
    v = out[0][1]
    nan = float("nan")
    return out + [
        (9001, None, 0), (9002, v, None), (9003, [0.0] * 16, 0), (9004, [nan] * 16, 0), (9005, [None] * 16, 0),
        (9006, v, 0), (9007, [2 * x for x in v], 0), (9008, [], 0), (9009, v[:8], 0), (9010, [float("inf")] * 16, 0),
    ]


@pytest.mark.parametrize("params", [{}, {"cell": 20, "block": 8}, {"cell": 40, "block": 16, "cosine": 0.8}])
def test_same_as_all_pairs(spark, params):
    given = clustered(1)
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").repartition(4)
    assert rows(metric.neighbours(df, **params), *COLUMNS) == plain(given, params.get("cosine", 0.93))


@pytest.mark.parametrize("params", [{"cell": 6, "block": 64}, {"cell": 1000, "block": 4}, {"cell": 8, "block": 3}])
def test_chains_across_cells_and_blocks(spark, params):
    rng = np.random.default_rng(7)
    given = []
    for label in range(6):  # each a chain of vectors that only link with their neighbours
        at = np.deg2rad(20.0 * np.arange(10))
        chain = np.zeros((10, 16), np.float32)
        chain[:, label], chain[:, label + 1] = np.cos(at), np.sin(at)
        given += [(v.tolist(), label % 3) for v in chain]
    given = [(int(i), *g) for i, g in zip(rng.permutation(len(given)), given, strict=True)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    assert rows(metric.neighbours(df, **params), *COLUMNS) == plain(given)


def test_repeated_and_missing_ids_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5), (2, [1.0, 0.01], 5)], schema)
    assert rows(metric.neighbours(df), *COLUMNS) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert metric.neighbours(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = rows(registry.op3_metric(spark, sf_dir), *COLUMNS)
    assert len(got) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
