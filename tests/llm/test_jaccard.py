import numpy as np
import pytest

from isoreach.llm import jaccard, registry, shingles
from isoreach.llm.components import connected, local_roots
from tests.llm.helpers import copies, documents, jaccard_plain, rows, words_of

ODD = [
    (None, "a b c d e"), (None, None), (1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a\x0bB"), (6, "a b c"),
    (7, "A B C"), (7, "A B C"), (8, "x " * 5000), (9, "x " * 4000 + "y"), (10, "ä b c d"),
]
COLUMNS = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize("params", [{}, {"block": 20, "frequent": 3}, {"size": 5, "percent": 80}])
def test_same_as_all_pairs(spark, params):
    given = ODD + copies(7)
    got = rows(jaccard.components(documents(spark, given), **params), *COLUMNS)
    assert got == jaccard_plain(given, params.get("size", 4), params.get("percent", 85))


def test_empty_table(spark):
    assert jaccard.components(documents(spark, [])).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(registry.op4_jaccard(spark, sf_dir), *COLUMNS) == jaccard_plain(given, 4, 85)


def test_keep_one_keeps_columns_and_one_of_each(spark):
    given = ODD[2:] + copies(3)
    kept = jaccard.keep_one(documents(spark, given), size=5, percent=80)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {d for d, _, c in jaccard_plain(given, 5, 80) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_long_chain_and_hub(spark):
    chain = [(i + 1, i) for i in range(400)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(401), 0), **dict.fromkeys(range(1000, 1301), 1000)}
    assert local_roots(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_sets_across_pieces(monkeypatch):
    texts = [t.encode() for _, t in copies(1, 20)] + [b"", b" ", b"one"]
    whole = shingles.sets_of(texts)
    monkeypatch.setattr(shingles, "_PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, shingles.sets_of(texts), strict=True))
    for text, s in zip(texts, whole, strict=True):
        w = words_of(text.decode())
        assert len(s) == (len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) if len(w) > 3 else min(1, len(w)))
