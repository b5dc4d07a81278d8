"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton after folding disguised spellings.

Folding: compatibility forms, lower case, look-alike letters of other scripts and digits or signs that stand for letters
become plain letters, invisible characters go, everything that is no letter becomes a blank between words.

Learning, from labelled rows only and from a bounded sample of them (``sample`` of each class, by a hash of the id; the
weights are corrected for the true share of the classes):
  1. Entries are whole words and word beginnings of 3 to 8 letters of toxic texts. Support is the number of different
     words before an entry, so a text copied a thousand times supports its words once. All entries with enough support
     are counted, in Spark; only those whose rates differ enough reach the driver.
  2. Each is weighted by the log of its document rates in toxic and in other texts. A beginning gives way to a longer
     entry that explains as many texts.
  3. Exception phrases: word forms, and pairs of words, that hold an entry only in texts that are not toxic.
  4. A logistic curve over the weight per text length and the total weight turns matches into a score from 0 to 1.

Defined results: a null or empty text has no match and the lowest score; without labelled toxic rows the lexicon is
empty and every score is the same; repeated rows are scored alike; a null doc_id is not held out. Labels that contradict
each other for a doc_id count as toxic.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.batches import by_bytes, tidy
from isoreach.session import materialise

_SHORT, _LONG = 3, 8

#: Letters that look like others, and digits and signs that stand for letters.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ο": "o", "ι": "i", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "κ": "k", "ı": "i", "ł": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s",
}


class _Fold(dict):
    def __missing__(self, code: int):
        char = chr(code)
        if unicodedata.category(char) == "Cf":
            out = None
        else:
            out = LOOK_ALIKE.get(char, char if char.isalpha() or unicodedata.category(char)[0] == "M" else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def words_of(text: str | None) -> list[str]:
    return unicodedata.normalize("NFKC", text or "").lower().translate(_FOLD).split()


def entries_of(word: str) -> list[str]:
    """What a word can match: itself between blanks, and its beginnings after a blank."""
    return [f" {word} ", *[" " + word[:k] for k in range(_SHORT, min(_LONG, len(word)) + 1)]]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine


def _features(machine: ahocorasick.Automaton, words: list[str]) -> tuple[float, float]:
    """Total weight, and weight per 100 words, of the matches that no exception phrase covers."""
    if not words or not len(machine):
        return 0.0, 0.0
    found, free = [], []
    for end, (size, weight) in machine.iter(f" {' '.join(words)} "):
        (free if weight is None else found).append((end - size + 1, end, weight))
    spans = [(a, b) for a, b, _ in free]
    best: dict[int, float] = {}  # a word counts once, by its heaviest entry
    for a, b, weight in found:
        if not any(x <= a and b <= y for x, y in spans):
            best[a] = max(weight, best.get(a, 0.0))
    total = sum(best.values())
    return total, 100.0 * total / max(len(words), 20)


def _score(curve: tuple[float, float, float], total: float, density: float) -> float:
    z = curve[0] + curve[1] * np.log1p(total) + curve[2] * np.log1p(density)
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _fit_curve(rows: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps; slopes are not negative."""
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows)])
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (share * (toxic - p)) - 0.01 * b
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        b = b + np.linalg.solve(hess, grad)
    return float(b[0]), max(0.0, float(b[1])), max(0.0, float(b[2]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for rows in by_bytes(batches, "text", 1 << 20, 250):
        yield rows.to_pylist()


def _supports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (entry, word before it) of toxic texts."""
    for rows in _texts(batches):
        seen = set()
        for row in rows:
            if row["toxic"] == 1:
                words = words_of(row["text"])
                seen.update((w, v) for v, w in itertools.pairwise(["", *words]))
        pairs = {(e, v) for w, v in seen for e in entries_of(w)}
        entry, before = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(before, pa.string())], names=["entry", "before"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, support: int = 8, least_ratio: float = 3.0) -> Lexicon:
    """The lexicon from labelled rows that are not held out; at most ``sample`` rows of either class."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Lexicon()
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("toxic") == c).orderBy(order).limit(sample) for c in (0, 1)]
    # Bounded by 2 * sample rows of an id and a class.
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("text", "toxic")

    pairs = rows.mapInArrow(tidy(_supports), "entry string, before string")
    supported = pairs.groupBy("entry").agg(F.countDistinct("before").alias("support")).filter(F.col("support") >= support)

    def in_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for row in part:
                counts[row["toxic"]].update({e for w in set(words_of(row["text"])) for e in entries_of(w)})
                counts[row["toxic"]][""] += 1
            flat = [(e, c, n) for c in (0, 1) for e, n in counts[c].items()]
            yield _table(flat, ("entry", pa.string()), ("toxic", pa.int32()), ("n", pa.int64()))

    of_class = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    counted = rows.mapInArrow(tidy(in_texts), "entry string, toxic int, n long").groupBy("entry").agg(of_class(1).alias("bad"), of_class(0).alias("clean"))
    counted = materialise(counted, "entry-counts")
    all_texts = counted.filter("entry = ''").first()
    texts = [max(1, all_texts["clean"]), max(1, all_texts["bad"])] if all_texts else [1, 1]
    ratio = F.log((F.col("bad") + 0.5) / (texts[1] + 1) / ((F.col("clean") + 0.5) / (texts[0] + 1)))
    marking = counted.join(supported.select("entry"), "entry").filter(ratio >= least_ratio)
    # Entries of the bounded sample that mark toxic texts.
    seen = {r["entry"]: (r["bad"], r["clean"]) for r in marking.collect()}
    lexicon = Lexicon(_choose(seen, texts))
    machine = lexicon.automaton()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for row in part:
                words = words_of(row["text"])
                hits = [k for k, w in enumerate(words) if any(e in lexicon.weights for e in entries_of(w))]
                phrases = {f" {' '.join(words[a:b])} " for k in hits for a, b in ((k, k + 1), (max(0, k - 1), k + 1), (k, k + 2))}
                counts[row["toxic"]].update(phrases)
            flat = [(e, c, n) for c in (0, 1) for e, n in counts[c].items()]
            yield _table(flat, ("entry", pa.string()), ("toxic", pa.int32()), ("n", pa.int64()))

    if lexicon.weights:
        met = rows.mapInArrow(tidy(forms), "entry string, toxic int, n long").groupBy("entry").agg(of_class(0).alias("clean"), of_class(1).alias("bad"))
        lexicon.exceptions = sorted(r["entry"] for r in met.filter((F.col("clean") >= 3) & (F.col("bad") == 0)).collect())
        machine = lexicon.automaton()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.automaton()
        for part in _texts(batches):
            flat = [(*_features(own, words_of(r["text"])), r["toxic"]) for r in part]
            yield _table(flat, ("total", pa.float64()), ("density", pa.float64()), ("toxic", pa.int32()))

    points = rows.mapInArrow(tidy(features), "total double, density double, toxic int").groupBy("toxic", "total", "density").agg(F.count("*").alias("n"))
    points = points.toPandas().sort_values(["toxic", "total", "density"])  # one row for equal points, however many rows share an id
    if not len(points):
        return lexicon
    toxic, n = points["toxic"].to_numpy().astype(float), points["n"].to_numpy().astype(float)
    share = np.where(toxic == 1, sizes[1] / max(1, (toxic * n).sum()), sizes.get(0, 0) / max(1, ((1 - toxic) * n).sum())) * n
    lexicon.curve = _fit_curve(points[["total", "density"]].to_numpy(), toxic, share * n.sum() / share.sum())
    return lexicon


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def _choose(seen: dict[str, tuple[int, int]], texts: list[int]) -> dict[str, float]:
    """Weights of the entries (texts with it: toxic, others) that mark toxic texts, without those that another explains."""
    bad = {e: b for e, (b, _) in seen.items()}
    weights = {e: float(np.log((b + 0.5) / (texts[1] + 1) / ((c + 0.5) / (texts[0] + 1)))) for e, (b, c) in seen.items()}
    longer: dict[str, int] = {}
    for e in weights:
        stem = e.rstrip(" ")
        shorter = [stem[:k] for k in range(_SHORT + 1, len(stem))] + ([stem] if e.endswith(" ") else [])
        for s in shorter:
            longer[s] = max(longer.get(s, 0), bad[e])
    kept = {e: w for e, w in weights.items() if e.endswith(" ") or longer.get(e, 0) < 0.9 * bad[e]}
    stems = {e for e in kept if not e.endswith(" ")}
    return {e: w for e, w in kept.items() if not any(e[:k] in stems for k in range(_SHORT + 1, len(e.rstrip(" ")) + e.endswith(" ")))}


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in _texts(batches):
            flat = [(r["doc_id"], _score(lexicon.curve, *_features(machine, words_of(r["text"])))) for r in part]
            yield _table(flat, ("doc_id", pa.int64()), ("score", pa.float64()))

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, in one pass over the texts."""
    lexicon = learn(docs, labels, **params)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for rows in by_bytes(batches, "text", 1 << 20, 250):
            texts = rows.column("text").to_pylist()
            clean = [_score(lexicon.curve, *_features(machine, words_of(t))) < threshold for t in texts]
            yield rows.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
