"""Benchmark decontamination with spaced seeds. Only DataFrame and SQL functions.

A text is lower-cased and split into tokens (runs of letters and digits). A seed hashes the tokens of an eight-token
window that a mask keeps and ignores the others, so a substituted token at an ignored place does not hide a match. The
two masks together find every aligned stretch of 13 tokens with up to two substitutions (tests try all of them).
Items of fewer than 13 tokens have seeds of their own: all runs of so many tokens as any allowed laying leaves agreeing
side by side (the whole item below 6 tokens). The texts get seeds of these lengths only if the benchmark has such items.
Seeds of the training texts meet the seeds of the benchmark by an equi-join. All hits that lay an item over a text at the
same place are one laying; it is made once, and the tokens that agree are counted in every stretch of ``stretch`` tokens
(the whole item if it is shorter).

Documents are never shuffled in the first pass: the benchmark's seeds, three numbers each, are broadcast, and where they
are more than ``broadcast_seeds`` they are cut into hashed slices of at most about that size, each broadcast on its own
pass over the documents. The second pass reads the documents that were hit; layings and items reach them by joins whose
sizes are measured. No row carries a text or an item for each of its seeds, so a long item costs what its tokens cost.

Defined results: null and empty texts and items match nothing; an item of one token is in every text that has the token;
items with the same tokens are all reported; repeated rows of a document give the same rows again, merged by doc_id.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import lookup_join
from isoreach.session import materialise

SPAN = 8
#: Token places that a seed keeps.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Items of fewer tokens have seeds of runs.
SHORT = 13


def run_length(n: int, stretch: int, substitutions: int) -> int:
    """Tokens that agree side by side in any accepted laying of an item of ``n`` tokens."""
    width = min(n, stretch)
    allowed = min(substitutions, width // 6)
    return -(-(width - allowed) // (allowed + 1))


def runs_of(words: Column, length: int) -> Column:
    """A seed for each place of a token array, the last ones of shorter runs."""
    hashed = lambda i: F.xxhash64(F.lit(100 + length), *[F.get(words, i + o) for o in range(length)])
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) - 1), hashed)).otherwise(F.array().cast("array<bigint>"))


def seeds_of(words: Column) -> Column:
    """All seeds of a token array, mask by mask and place by place."""
    places = F.sequence(F.lit(1), F.size(words) - (SPAN - 1))

    def seed(number: int, mask: tuple[int, ...]):
        return lambda i: F.xxhash64(F.lit(number), *[F.get(words, i + (o - 1)) for o in mask])

    by_mask = [F.transform(places, seed(number, mask)) for number, mask in enumerate(MASKS)]
    return F.when(F.size(words) >= SPAN, F.concat(*by_mask)).otherwise(F.array().cast("array<bigint>"))


def _agreeing(words: Column, item: Column, shift: Column) -> Column:
    """1 or 0 for each token of the item laid over the text."""
    return F.transform(item, lambda w, j: F.coalesce((F.get(words, j + shift) == w).cast("int"), F.lit(0)))


def _best(same: Column, width: Column) -> Column:
    """Most ones in any stretch of ``width`` places."""
    starts = F.sequence(F.lit(1), F.size(same) - width + 1)
    return F.array_max(
        F.transform(starts, lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x))
    )


def _benchmark_seeds(items: DataFrame, stretch: int, substitutions: int) -> tuple[DataFrame, list[int]]:
    """(seed, item_no, item_at) of all items, stored, and the lengths of runs among the seeds."""
    sizes = items.filter(F.size("item") < SHORT).select(F.size("item").alias("n")).distinct().collect()
    lengths = {r["n"]: run_length(r["n"], stretch, substitutions) for r in sizes}
    seeds, places = seeds_of(F.col("item")), F.size("item") - (SPAN - 1)
    for n, run in lengths.items():
        short = F.size("item") == n
        seeds = F.when(short, F.slice(runs_of(F.col("item"), run), 1, n - run + 1)).otherwise(seeds)
        places = F.when(short, F.lit(n)).otherwise(places)
    listed = items.select("item_no", places.alias("places"), F.posexplode(seeds).alias("at", "seed"))
    listed = listed.select("seed", "item_no", (F.col("at") % F.col("places")).cast("int").alias("item_at"))
    return materialise(listed, "benchmark-seeds"), sorted(set(lengths.values()))


def _layings(docs: DataFrame, seeds: DataFrame, runs: list[int], broadcast_seeds: int) -> DataFrame:
    """Different (key, item_no, shift), stored: the item's first token would be token ``shift`` of the text with this key.

    The key is a hash of the text, so copies have their layings once; a text that only shares the key is laid in vain.
    """
    slices = max(1, math.ceil(seeds.count() / broadcast_seeds))
    words = tokens_of(F.col("text"))
    texts = docs.select(F.xxhash64("text").alias("key"), words.alias("words"))
    all_seeds = [seeds_of(F.col("words")), *[runs_of(F.col("words"), run) for run in runs]]
    texts = texts.select("key", F.size("words").alias("n"), (F.concat(*all_seeds) if runs else all_seeds[0]).alias("seeds"))
    # Outer: from an inner one the optimizer derives a filter on the array, which would split the text for every seed.
    texts = texts.select("key", "n", F.posexplode_outer("seeds").alias("at", "seed"))
    windows = F.col("n") - (SPAN - 1)
    place = (F.col("at") % windows).cast("int")
    if runs:
        masked = len(MASKS) * F.greatest(windows, F.lit(0))
        place = F.when(F.col("at") < masked, place).otherwise(((F.col("at") - masked) % F.col("n")).cast("int"))
    found = []
    for k in range(slices):
        part = seeds if slices == 1 else seeds.filter(F.pmod(F.xxhash64(F.lit(7), "seed"), F.lit(slices)) == k)
        hits = texts.join(F.broadcast(part), "seed")
        found.append(hits.select("key", "item_no", (place - F.col("item_at")).alias("shift")))
    return materialise(functools.reduce(DataFrame.unionByName, found).distinct(), "layings")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, stretch: int = 13, substitutions: int = 2, broadcast_seeds: int = 500_000
) -> DataFrame:
    """One row per document and benchmark item that overlap.

    doc_id, item_id, first_token (place in the document where the item would start, negative if cut off), n_matched
    (agreeing tokens of the best laying), n_item (tokens of the item).
    """
    items = benchmark.select("item_id", tokens_of(F.col("text")).alias("item"))
    items = items.filter(F.size("item") > 0).groupBy("item").agg(F.collect_set("item_id").alias("item_ids"))
    items = materialise(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")
    seeds, runs = _benchmark_seeds(items, stretch, substitutions)
    layings = _layings(docs, seeds, runs, broadcast_seeds)
    hit = lookup_join(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), layings, "key", "inner")
    laid = lookup_join(hit, items, "item_no", "inner").select("doc_id", "item_ids", "item", "shift", tokens_of(F.col("text")).alias("words"))
    # The one-element generator computes the tokens, then the agreement, once.
    laid = laid.select("doc_id", "item_ids", "shift", F.explode_outer(F.array(_agreeing(F.col("words"), F.col("item"), F.col("shift")))).alias("same"))
    width = F.least(F.lit(stretch), F.size("same"))
    allowed = F.least(F.lit(substitutions), F.floor(width / 6))
    laid = laid.filter(_best(F.col("same"), width) >= width - allowed)
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    laid = laid.select("doc_id", "item_ids", "shift", matched.alias("matched"), F.size("same").alias("n_item"))
    laid = laid.select("doc_id", F.explode("item_ids").alias("item_id"), "shift", "matched", "n_item")
    out = laid.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", -F.col("shift"), "n_item")).alias("b"))
    return out.select(
        "doc_id", "item_id", (-F.col("b.col2")).cast("int").alias("first_token"),
        F.col("b.matched").alias("n_matched"), F.col("b.n_item").alias("n_item"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that overlap with no benchmark item; all their columns. A null doc_id is kept."""
    return docs.join(overlaps(docs, benchmark, **params).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
