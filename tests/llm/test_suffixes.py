import bisect
import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from isoreach.llm import columns, registry, suffixes
from tests.llm.helpers import documents, repeats_plain, rows

COLUMNS = ("doc_id", "kept", "n_removed", "n_spans")


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(5)]
    out = [
        (None, base[0]), (3, None), (4, ""), (5, base[0]), (5, base[0]), (5, base[1]), (9, "a" * 500),
        (10, "a" * 300 + "b" * 60), (2, "a" * 49), (11, "a" * 50), (12, "ü" * 200), (13, "x" + "ü" * 100),
    ]
    for i in range(200):
        b = rng.choice(base)
        x, y = sorted(rng.sample(range(400), 2))
        head = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 30)))
        out.append((20 + i % 150, head + b[x:y] + rng.choice(["", rng.choice(base)[:60], "a" * 55])))
    return out


def plain(df):
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_windows(spark, seed):
    given = passages(seed)
    assert plain(suffixes.remove_repeats(documents(spark, given))) == repeats_plain(given)


def test_many_buckets_and_groups(spark):
    given = passages(3)
    got = suffixes.remove_repeats(documents(spark, given), bucket_suffixes=50, group_bytes=3000)
    assert plain(got) == repeats_plain(given)


def test_empty_and_short(spark):
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0
    assert plain(suffixes.remove_repeats(documents(spark, [(1, "a"), (2, "a")]))) == [(1, b"a", 0, 0), (2, b"a", 0, 0)]


def test_query_on_whole_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(((d, len(k) + n, n, s, hashlib.sha256(k).hexdigest()) for d, k, n, s in repeats_plain(given)), key=str)
    assert rows(registry.op7_suffixes(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_clashing_names(spark):
    """Columns named as results are replaced; others and those of ``cut_texts`` stay."""
    shared = "passage é " * 12
    docs = documents(spark, [(1, "head " + shared), (2, shared + "tail")]).withColumnsRenamed({"lang": "kept", "source": "part", "n_chars": "n_bytes"})
    out = suffixes.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "part", "kept", "n_bytes", "n_removed", "n_spans"]
    assert rows(out, "doc_id", "n_removed") == [(1, 0), (2, len(shared.encode()))]
    cut = suffixes.cut_texts(docs)
    assert cut.columns == docs.columns and rows(cut, "doc_id", "kept") == [(1, "en"), (2, "en")]


def test_few_very_long_texts(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(1_500_000)) for _ in range(2)]
    given = [(1, long[0]), (2, "x" + long[0][200_000:900_000] + "y"), (3, long[1]), (4, long[1][-60:])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(documents(spark, given, parts=1)).collect()}
    assert got == {1: (0, 0), 2: (700_000, 1), 3: (0, 0), 4: (60, 1)}


def test_cut_texts(spark):
    shared = "passage é " * 12
    given = [(1, "head " + shared), (2, shared + "tail"), (3, shared), (4, None), (5, "")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffixes.cut_texts(documents(spark, given)).collect()}
    assert got == {1: (given[0][1], len(given[0][1])), 2: ("tail", 4), 4: (None, None), 5: ("", 0)}


def test_parts_of_a_long_text_have_the_same_windows(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (3000, 10, 49, 50, 51)]

    def windows():
        a = suffixes.anchors_of(texts, 50)
        return sorted((int(d), w, int(p)) for d, lo, hi, p in zip(a.doc, a.lo, a.hi, a.at, strict=True) for w in range(lo, hi + 1))

    whole = windows()
    assert [(d, w) for d, w, _ in whole] == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 49)]
    monkeypatch.setattr(suffixes, "_BUFFER", 333)
    assert windows() == whole


def test_columns_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        given = [rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**64, n, dtype=np.uint64), np.full(n, 7)]
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(given, columns.load(columns.dump(*given)), strict=True))


def test_packed_rows_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        firsts = np.flatnonzero(np.append(True, rng.random(max(n - 1, 0)) < 0.3)) if n else np.zeros(0, np.int64)
        given = [rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(-(2**62), 2**62, n), rng.integers(0, 2**31, n), rng.integers(0, 2**40, n).astype(np.uint64)]
        blobs = columns.pack(firsts, "u8 i8 i4 u5", *given)
        assert len(blobs) == len(firsts) and [len(b) for b in blobs.to_pylist()] == (25 * np.diff(np.append(firsts, n))).tolist()
        for same in (blobs, pa.chunked_array([blobs.slice(0, len(blobs) // 3), blobs.slice(len(blobs) // 3)])):
            assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(given, columns.unpack(same, "u8 i8 i4 u5"), strict=True))


def test_bucket_counts_splitters():
    rng = np.random.default_rng(2)
    lead, gram = rng.integers(0, 12, 500, dtype=np.uint64), rng.integers(0, 4, 500, dtype=np.uint64)
    for n in (0, 1, 30):
        split = sorted(zip(rng.integers(0, 12, n).tolist(), rng.integers(0, 4, n).tolist(), strict=True))
        arrays = tuple(np.array([s[k] for s in split], np.uint64) for k in (0, 1))
        assert suffixes._bucket(lead, gram, arrays).tolist() == [bisect.bisect_right(split, x) for x in zip(lead.tolist(), gram.tolist(), strict=True)]


def test_many_buckets_cost_no_more_than_few():
    """a task's work must not follow the number of buckets, which grows with the input as the number of tasks does."""
    rng = np.random.default_rng(3)
    n = 200_000
    lead, gram, span = (np.sort(rng.integers(0, 2**60, n, dtype=np.uint64)), *(rng.integers(0, 2**16, n, dtype=np.uint64) for _ in range(2)))
    doc, at = rng.integers(0, 2**20, n), rng.integers(0, 2**15, n)

    def seconds(buckets):
        split = lead[(np.arange(1, buckets) * n) // buckets], np.zeros(buckets - 1, np.uint64)
        began = time.process_time()
        sent = suffixes._by(suffixes._bucket(lead, gram, split), 0, suffixes._SUFFIX, lead, gram, span, doc, at)
        back = columns.unpack(suffixes._blobs(pa.Table.from_batches([sent]), 0), suffixes._SUFFIX)
        took = time.process_time() - began
        assert sent.num_rows == buckets and all((a == b).all() for a, b in zip((lead, gram, span, doc, at), back, strict=True))
        return took

    few = min(seconds(100) for _ in range(3))
    assert min(seconds(50_000) for _ in range(3)) < 5 * few + 0.2
