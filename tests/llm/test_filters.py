import itertools
import random
import re
import time
import zlib

import pytest

from isoreach.llm import decontamination, registry, toxicity
from tests.llm.helpers import copies, documents, rows

ITEMS = "item_id long, text string, doc_id string"


def benchmark(spark, given):
    return spark.createDataFrame([(i, t, "clash") for i, t in given], ITEMS)


def words(n, salt=""):
    return [f"w{salt}{i}" for i in range(n)]


def test_masks_find_two_substitutions_in_any_thirteen():
    for gone in itertools.combinations(range(13), 2):
        assert any(
            not {p + o for o in mask} & set(gone) for mask in decontamination.MASKS for p in range(13 - decontamination.SPAN + 1)
        )


def test_overlaps(spark):
    item = words(30)
    swapped = [*item[:4], "Q", *item[5:9], "R", *item[10:]]
    docs = [
        (1, "x y " + " ".join(item).upper() + " z"), (2, ", ".join(swapped)), (3, " ".join(item[8:21])), (4, " ".join(item[:9])),
        (5, None), (6, ""), (7, " ".join(words(40, "z"))), (None, " ".join(item)), (8, " ".join(["the"] * 3000)),
        (9, " ".join(["q"] * 20_000 + item)), (1, "again " + " ".join(item)),
    ]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, "too short"), (13, None), (None, " ".join(words(9, "k")))]
    found = rows(decontamination.overlaps(documents(spark, docs), benchmark(spark, items)), "doc_id", "item_id")
    assert found == sorted(((d, i) for d in (1, 2, 3, 9, None) for i in (10, 11)), key=str)
    kept = decontamination.clean(documents(spark, docs), benchmark(spark, items))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8]


def test_items_of_all_short_lengths(spark):
    """Every allowed set of substitutions of items of 1 to 13 tokens is found, one more is not."""
    docs, items, want = [], [], set()
    for n in range(1, 14):
        item = words(n, f"n{n}x")
        items.append((n, " ".join(item)))
        allowed = min(2, n // 6)
        for k in range(min(allowed + 2, n + 1)):
            for gone in itertools.combinations(range(n), k):
                text = " ".join("Q" if j in gone else w for j, w in enumerate(item))
                for around in (text, f"a b c d {text} e f"):
                    docs.append((len(docs), around))
                    if k <= allowed:
                        want.add((len(docs) - 1, n))
    found = decontamination.overlaps(documents(spark, docs), benchmark(spark, items))
    assert {tuple(r) for r in found.select("doc_id", "item_id").collect()} == want
    assert {r["first_token"] for r in found.filter("item_id < 8").collect()} == {0, 4}


def test_slices_of_seeds_find_the_same(spark):
    docs, items = copies(2, 60), [(i, t) for i, t in copies(2, 60)[:9]]
    whole = rows(decontamination.overlaps(documents(spark, docs), benchmark(spark, items)), "doc_id", "item_id", "n_matched")
    sliced = decontamination.overlaps(documents(spark, docs), benchmark(spark, items), broadcast_seeds=100)
    assert rows(sliced, "doc_id", "item_id", "n_matched") == whole and whole


def test_long_items_and_many_rows_of_one_id(spark):
    item = words(20_000)
    swapped = [w if k % 7 else "Q" for k, w in enumerate(item[:3000])]
    given = [(1, " ".join(["a"] * 50 + item)), (2, " ".join(swapped)), *[(None, f"x{k} " + " ".join(item[k * 40 : k * 40 + 20])) for k in range(300)]]
    start = time.time()
    got = rows(decontamination.overlaps(documents(spark, given), benchmark(spark, [(5, " ".join(item))])), "doc_id", "first_token", "n_matched")
    assert got == [(1, 50, 20_000), (2, 0, 2571), (None, 1 - 299 * 40, 20)] and time.time() - start < 60


def test_automaton_against_plain_search():
    """Every entry searched on its own, and matches inside an exception phrase left out."""
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choice("abcs") for _ in range(rng.randint(1, 5))) for _ in range(n))
    for _ in range(300):
        entries = {f" {some(1)}{rng.choice(['', ' '])}": float(rng.randint(1, 9)) for _ in range(8)}
        phrases = [f" {some(rng.randint(1, 2))} " for _ in range(4)]
        machine = toxicity.Lexicon(entries, phrases).automaton()
        text = toxicity.words_of(some(rng.randint(0, 30)).replace("s", rng.choice("s5$ѕ")))
        line = f" {' '.join(text)} "
        places = lambda e: [k for k in range(len(line)) if line.startswith(e, k)]  # noqa: E731,B023
        free = [(k, k + len(p) - 1) for p in phrases for k in places(p)]
        best = {}
        for e, weight in entries.items():
            for k in places(e) if e not in phrases else []:
                if not any(a <= k and k + len(e) - 1 <= b for a, b in free):
                    best[k] = max(weight, best.get(k, 0.0))
        total = sum(best.values())
        assert toxicity._features(machine, text) == (total, 100 * total / max(len(text), 20) if text else 0.0)


def test_empty_sides(spark):
    some = [(1, " ".join(words(20)))]
    assert decontamination.overlaps(documents(spark, []), benchmark(spark, some)).count() == 0
    assert decontamination.overlaps(documents(spark, some), benchmark(spark, [])).count() == 0


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_decontamination_query(spark, sf_dir):
    """Against every laying of every item over every document that shares a run of four tokens."""
    items = {r["item_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    starts = {}
    for i, w in items.items():
        for j in range(len(w) - 3):
            starts.setdefault(tuple(w[j : j + 4]), []).append((i, j))
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = tokens(r["text"])
        layings = {(i, p - j) for p in range(len(w) - 3) for i, j in starts.get(tuple(w[p : p + 4]), ())}
        for i, shift in layings:
            same = [0 <= j + shift < len(w) and w[j + shift] == t for j, t in enumerate(items[i])]
            if any(sum(same[k : k + 13]) >= 11 for k in range(len(same) - 12)):
                want.add((r["doc_id"], i))
    got = rows(registry.op10_decontamination(spark, sf_dir), "doc_id", "item_id")
    assert got == sorted(want, key=str) and want


def test_folding():
    assert toxicity.words_of("Іdiot 1d10t ÍDIOT, mо​ron!") == ["idiot", "idiot", "ídiot", "moron"]
    assert toxicity.words_of(None) == toxicity.words_of("") == []


@pytest.fixture(scope="module")
def learned(spark):
    clean = copies(11, 400)
    bad = [(2000 + i, f"{t} you vile{'abcdef'[i % 6]} {'fool' if i % 2 else 'f00l'} {t[::-1]}") for i, (_, t) in enumerate(copies(12, 200, 60))]
    rows_ = [*clean, *bad, *[(5000 + i, f"{t} vile weather") for i, (_, t) in enumerate(copies(13, 60))]]
    labels = spark.createDataFrame([(d, 1, int(2000 <= d < 5000)) for d, _ in rows_] + [(None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    return documents(spark, rows_), labels


def test_score(spark, learned):
    docs, labels = learned
    extra = documents(spark, [(1, None), (2, ""), (3, "nice " * 30000), (4, "you viled fооl"), (4, "you viled fооl"), (None, "text")])
    lexicon = toxicity.learn(docs, labels, support=4)
    assert " you " in lexicon.weights
    got = toxicity.judge(docs, labels, support=4).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in got) > 0.95 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    scores = {}
    for r in toxicity.score(extra, lexicon).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert scores[1] == scores[2] == scores[3] == scores[None] and len(set(scores[4])) == 1 and scores[4][0] > scores[1][0]


def test_reject_keeps_columns(spark, learned):
    docs, labels = learned
    kept = toxicity.reject(docs, labels, support=4)
    assert kept.columns == docs.columns
    judged = {r["doc_id"] for r in toxicity.judge(docs, labels, support=4).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged


def test_nothing_to_learn(spark, learned):
    docs, labels = learned
    assert {r["predicted"] for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    tenfold = sf_dir.replace("sf0.01", "sf0.1")
    labels = spark.read.parquet(f"{tenfold}/labels.parquet")
    got = registry.op6_toxicity(spark, tenfold).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.97 * len(got)
