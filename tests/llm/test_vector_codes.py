"""Vector codes against comparing every part with every entry."""

import hashlib

import numpy as np
import pytest

from isoreach.llm import balls, registry, vector_codes
from tests.compare import connect, difference
from tests.llm.helpers import rows

COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all()


def plain(given, scale=1024, parts=4, entries=256, rounds=4):
    """Of (vec_id, vector, label), usable vectors of one length."""
    kept = [(i, [int(np.floor(float(np.float32(c)) * scale)) for c in v], label) for i, v, label in given if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept], object)
    width = x.shape[1] // parts
    split = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [s[:entries].copy() for s in split]

    def assign():
        out = []
        for s, book in zip(split, books, strict=True):
            d = ((s[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            out.append((np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in d]), d))
        return out

    for _ in range(rounds):
        for (near, _), s, book in zip(assign(), split, books, strict=True):
            for e in set(near.tolist()):
                own = s[near == e]
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    name = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded, sums = [], {}
    for k, (i, _, label) in enumerate(kept):
        error = int(sum(d[k, near[k]] for near, d in last))
        coded.append((i, "".join(f"{near[k]:02x}" for near, _ in last), error, label))
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, c, e, sums[label], name) for i, c, e, label in coded), key=str)


def clustered(seed, n, dim=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    return [(int(i), (centers[i % 12] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), [None, 0, 1][i % 3]) for i in rng.permutation(n)]


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_same_as_all_pairs(spark, spread):
    given = clustered(2, 700, spread=spread)
    df = spark.createDataFrame(given, SCHEMA).repartition(5)
    assert rows(vector_codes.compress(df, entries=40), *COLUMNS) == plain(given, entries=40)


def test_ties_repeats_and_unusable(spark):
    nan, inf = float("nan"), float("inf")
    grid = [(k, [float(k % 3), float(k % 2), 0.5, -0.5, 1.0, 0.0, -1.0, -0.001], k % 2) for k in range(60)]
    odd = [(70, None, 0), (71, [nan] * 8, 0), (72, [inf] * 8, 0), (73, [None] * 8, 0), (74, [], 0), (5, [2.0] * 8, 7), (5, [2.0] * 8, 7), (None, [3.0] * 8, None)]
    given = grid + odd
    df = spark.createDataFrame([(*r, "x", 1) for r in given], f"{SCHEMA}, code string, error int").repartition(3)
    assert rows(vector_codes.compress(df, entries=6), *COLUMNS) == plain(given, entries=6)


def test_other_lengths_few_rows_and_empty(spark):
    given = [(1, [1.0, 2.0, 3.0, 4.0], 0), (2, [1.0, 2.0, 3.0, 5.0], None)]
    df = spark.createDataFrame([*given, (3, [1.0] * 6, 0), (4, [1.0] * 8, 0)], SCHEMA)
    assert rows(vector_codes.compress(df), *COLUMNS) == plain(given)
    assert vector_codes.compress(df.limit(0)).columns == list(COLUMNS) and vector_codes.compress(df.filter("vec_id = 3")).count() == 0
    with pytest.raises(OverflowError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 0)], SCHEMA))


def test_balls_own_and_shrink():
    rng = np.random.default_rng(5)
    for n, dim, size in ((1, 2, 4), (33, 1, 9), (2000, 2, 30), (3000, 12, 200)):
        points = np.floor(200 * rng.normal(size=(20, dim)))[rng.integers(0, 20, n)].astype(np.int64) + rng.integers(-3, 4, (n, dim))
        tree = balls.load(balls.build(points).dump())
        for ball, (left, right) in enumerate(tree.children.tolist()):
            own = tree.points[tree.first[ball] : tree.last[ball]].astype(np.int64)
            assert (own.sum(axis=0) == tree.sums[ball]).all()
            if left >= 0:
                assert (tree.first[left], tree.last[left], tree.last[right]) == (tree.first[ball], tree.first[right], tree.last[ball])
        entries = points[rng.integers(0, n, size)]
        owned = balls.nearest(tree, entries)
        d = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        code, distance = balls.codes(tree, owned, entries)
        assert (code == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        count, sums = balls.totals(tree, owned, size)
        assert (count == np.bincount(code, minlength=size)).all() and sums.sum() == points.sum()
    # Well parted points: most are counted by balls, not one by one.
    far = 5000 * np.arange(16)[:, None, None] + rng.integers(-3, 4, (16, 64, 1))
    owned = balls.nearest(balls.build(far.reshape(-1, 1)), 5000 * np.arange(16)[:, None])
    assert len(owned.places) == 0 and len(owned.balls) <= 40


def test_query(spark, sf_dir):
    got = registry.op11_vector_codes(spark, sf_dir)
    assert difference(got, connect(sf_dir), vector_codes.compress_sql()) is None
    assert got.count() == registry.table(spark, sf_dir, "embeddings").count()
