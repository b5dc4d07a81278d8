"""Exact Jaccard join of shingle sets with skipping by set relations.

Sets with the same content are one set, named by a hash of the content; everything below is per content, so a text that
is copied a thousand times costs as much as one.

1. Order. Shingles are ordered by hash, frequent ones last. Frequent ones (in more than ``frequent`` sets among the first
   shingles of all sets; the ``MOST_FREQUENT`` most frequent) are a bounded table. The order changes the work, never the
   result.
2. Index lists. Two sets above the threshold share at least l of their first n - ceil(t * n) + l shingles, for any l up
   to the overlap that is needed; l grows with the set size n, so long texts are not compared for a few common phrases.
   These shingles go to buckets by hash; a bucket forms the lists. Pairs of a list of at most ``SHORT`` sets are counted
   over all lists. A longer list, of copies mostly, is sorted by set size and cut into blocks; a block is skipped where
   sizes, or the shingles left after this position, cannot reach the overlap that is needed, and where it is already
   connected with the other block. Pairs counted l times and sets of long lists are candidates; clusters are the
   components of the candidates.
3. Verification in cells, by the first 48 bits of the hashes. The sets of a cluster meet in one cell, those of a large cluster in cells of two blocks each.
   A cell computes the overlap of a set with all others from an index once, and derives those of a similar set from it
   by the lists of the few shingles in which the two differ. No pairs leave a cell, only each set's least linked set.
4. Links of all cells are joined to components, and contents to documents.

No cap on partners, candidates or list lengths. Defined results: a null or empty text has an empty set, linked with
nothing; a row without doc_id is linked with nothing and has a null component; rows that share a doc_id are the same
document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm import columns
from isoreach.llm.batches import by_bytes, tidy
from isoreach.llm.components import connected, local_roots
from isoreach.llm.shingles import name_of, sets_of
from isoreach.session import materialise

MOST_FREQUENT = 1_000_000
_LIST_BLOCK = 64
_BLOBS = "part long, kind int, blob binary"
_FLUSH = 500_000
#: Lists of at most so many sets are taken pair by pair.
SHORT = 8
#: Bits of a shingle's hash that are compared inside a cell.
_CELL_BITS = np.uint64(48)


def shared_first(n: np.ndarray) -> np.ndarray:
    """How many first shingles two sets must share; the smaller of theirs counts."""
    return 1 + n // 50


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - (percent * n + 99) // 100 + shared_first(n))


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least shared shingles of sets of these sizes: 100 * i >= percent * (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return by_bytes(batches, "text", 2 << 20, 500)


def _sets(rows: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return sets_of([t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()], size)


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _by_hash(parts: int, kind: int, hashes: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One row for each range of hashes; ``hashes`` are sorted."""
    edges = np.searchsorted(hashes, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
    edges = [0, *edges.tolist(), len(hashes)]
    rows = [(p, kind, columns.dump(hashes[a:b], *(v[a:b] for v in values))) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return _out(rows)


def _frequent(docs: DataFrame, size: int, percent: int, frequent: int, parts: int) -> np.ndarray:
    """The frequent shingles, sorted."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            return _by_hash(parts, 0, *np.unique(np.concatenate(held), return_counts=True))

        for rows in _batches(batches):
            for s in _sets(rows, size):
                if len(s):
                    held.append(s[: 2 * int(prefix_size(np.int64(len(s)), percent))].copy())
            if sum(map(len, held)) > 2 * _FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        pieces = [columns.load(b) for b in table.column("blob").to_pylist()]
        shingle, n = (np.concatenate(c) for c in zip(*pieces, strict=True))
        kinds, at = np.unique(shingle, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        return pa.table({"shingle": kinds[n > frequent].view(np.int64), "n": n[n > frequent]})

    found = docs.select("text").mapInArrow(tidy(counts), _BLOBS).groupBy("part").applyInArrow(total, "shingle long, n long")
    top = found.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def _list_links(names: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, root: dict[int, int]) -> None:
    """Joins in ``root`` the sets of one index list that may reach the threshold."""

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(n, kind="stable")
    # Of the first shared shingles, this one may be the last that must be shared.
    names, n, left = names[order], n[order], (n - place + shared_first(n) - 1)[order]
    blocks = [slice(k, k + _LIST_BLOCK) for k in range(0, len(n), _LIST_BLOCK)]
    most_left = [int(left[b].max()) for b in blocks]
    keys = [[int(x) for x in names[b]] for b in blocks]
    for i, b in enumerate(blocks):
        for j in range(i, -1, -1):
            c = blocks[j]
            if 100 * int(n[c][-1]) < percent * int(n[b][0]):
                break  # sizes only fall from here on
            least = int(overlap_needed(n[b][0], n[c][0], percent))
            if min(most_left[i], most_left[j]) < least:
                continue
            if len({find(x) for x in keys[i]} | {find(x) for x in keys[j]}) == 1:
                continue
            need = overlap_needed(n[b][:, None], n[c][None, :], percent)
            can = np.minimum(left[b][:, None], left[c][None, :]) >= need
            if i == j:
                can &= np.tri(len(keys[i]), k=-1, dtype=bool)
            for x, y in zip(*np.nonzero(can), strict=True):
                p, q = find(keys[i][x]), find(keys[j][y])
                if p != q:
                    root[max(p, q)] = min(p, q)


def _candidates(docs: DataFrame, size: int, percent: int, often: np.ndarray, parts: int) -> DataFrame:
    """Rows of three kinds. 1, a document: doc_id a, name b, set size n. 0, names a and b of a long list. 2, names a and b
    that met in c short lists and must meet in n.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        held: dict[int, tuple[np.ndarray, int]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s, _ in held.values()], np.int64)
            shingle = np.concatenate([s for s, _ in held.values()])
            name = np.repeat(np.array(list(held), np.int64), sizes)
            whole = np.repeat(np.array([n for _, n in held.values()], np.int64), sizes)
            place = np.arange(len(shingle)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(shingle, kind="stable")
            return _by_hash(parts, 0, shingle[order], name[order], whole[order], place[order])

        for rows in _batches(batches):
            known = []
            for doc_id, s in zip(rows.column("doc_id").to_pylist(), _sets(rows, size), strict=True):
                name = name_of(s)
                known.append((doc_id, name, len(s)))
                if len(s) and doc_id is not None and name not in held:
                    n = len(s)
                    if len(late):
                        is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        s = np.concatenate([s[~is_late], s[is_late]])
                    first = s[: int(prefix_size(np.int64(n), percent))].copy()
                    held[name] = first, n
                    count += len(first)
            ids, names, ns = zip(*known, strict=True)
            missing = np.array([d is None for d in ids])
            ids = np.array([d or 0 for d in ids], np.int64)
            blob = columns.dump(ids, missing.astype(np.int64), np.array(names, np.int64), np.array(ns, np.int64))
            yield _out([(abs(names[0]) % parts, 1, blob)])
            if count > _FLUSH:
                yield flush()
                held, count = {}, 0
        if held:
            yield flush()

    def lists(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = []
        for blob in (b for b, k in zip(blobs, kinds, strict=True) if k == 1):
            ids, missing, name, n = columns.load(blob)
            out.append(pa.table({"kind": pa.array(np.ones(len(ids), np.int32)), "a": pa.array(ids, mask=missing == 1), "b": pa.array(name), "n": pa.array(n), "c": pa.array(n)}))
        sent = [columns.load(b) for b, k in zip(blobs, kinds, strict=True) if k == 0]
        if sent:
            shingle, name, n, place = (np.concatenate(c) for c in zip(*sent, strict=True))
            order = np.lexsort((name, shingle))
            shingle, name, n, place = shingle[order], name[order], n[order], place[order]
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1]))
            shingle, name, n, place = shingle[new], name[new], n[new], place[new]
            first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            length = np.diff(np.append(first, len(shingle)))
            root: dict[int, int] = {}
            for a, m in zip(first[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
                _list_links(name[a : a + m], n[a : a + m], place[a : a + m], percent, root)
            long = np.array([(x, y) for x, y in root.items() if x != y], np.int64).reshape(-1, 2)
            out.append(pa.table({"kind": np.zeros(len(long), np.int32), "a": long[:, 0], "b": long[:, 1], "n": np.zeros(len(long), np.int64), "c": np.zeros(len(long), np.int64)}))
            left, must = n - place, shared_first(n)
            found = []
            for m in range(2, SHORT + 1):
                start = first[length == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = start + i, start + j
                        need, share = overlap_needed(n[x], n[y], percent), np.minimum(must[x], must[y])
                        can = np.minimum(left[x], left[y]) + share - 1 >= need
                        x, y = x[can], y[can]
                        found.append(np.column_stack([name[x], name[y], np.minimum(share, need)[can]]))
            pairs, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
            out.append(pa.table({"kind": np.full(len(pairs), 2, np.int32), "a": pairs[:, 0], "b": pairs[:, 1], "n": pairs[:, 2], "c": times.astype(np.int64)}))
        return pa.concat_tables(out)

    sent = docs.select("doc_id", "text").mapInArrow(tidy(postings), _BLOBS)
    return materialise(sent.groupBy("part").applyInArrow(lists, "kind int, a long, b long, n long, c long"), "candidates")


def cell_links(names: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (name, root) that connect all linked sets of a cell."""
    sizes = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [word[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    holder = np.repeat(np.arange(m), sizes)[np.argsort(word, kind="stable")]
    at = np.append(0, np.cumsum(np.bincount(word)))

    def met(words: np.ndarray) -> np.ndarray:
        """How many of these shingles each set holds, from the index lists."""
        n = at[words + 1] - at[words]
        if not len(n):
            return np.zeros(m, np.int64)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(holder[np.repeat(at[words], n) + inside], minlength=m)

    todo = np.ones(m, bool)
    left, right = [], []
    now, shared = -1, None
    for _ in range(m):
        if now >= 0 and (similar := np.where(todo, shared, -1)).max() * 2 > sizes[now]:
            last, now = now, int(similar.argmax())
            gone, new = np.setdiff1d(own[last], own[now], True), np.setdiff1d(own[now], own[last], True)
            shared = shared - met(gone) + met(new) if 2 * (len(gone) + len(new)) < sizes[now] else met(own[now])
        else:
            now = int(todo.argmax())
            shared = met(own[now])
        todo[now] = False
        linked = np.flatnonzero(todo & (100 * shared >= percent * (sizes + sizes[now] - shared)))
        left.append(np.full(len(linked), now))
        right.append(linked)
    a, b = np.concatenate(left), np.concatenate(right)
    root = local_roots(m, a, b)
    moved = np.flatnonzero(root != np.arange(m))
    return names[moved], names[root[moved]]


def _verified(docs: DataFrame, needed: DataFrame, size: int, percent: int, block: int, cells: int) -> DataFrame:
    """(a, b) names that connect all linked sets, from ``needed`` (doc_id, name, cluster, members)."""
    blocks = F.ceil(F.col("members") / block)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    mine = F.pmod(F.xxhash64("name"), blocks).cast("int")
    others = F.sequence(F.lit(0), (blocks - 1).cast("int"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    cell = F.when(F.col("members") <= 2 * block, one).otherwise(pairs)
    placed = needed.select("doc_id", "name", F.transform(cell, lambda c: F.xxhash64("cluster", c["i"], c["j"])).alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            found = []
            for s, name, places in zip(_sets(rows, size), rows.column("name").to_pylist(), rows.column("places").to_pylist(), strict=True):
                if name_of(s) == name:
                    blob = columns.dump(np.diff(s >> (np.uint64(64) - _CELL_BITS), prepend=np.uint64(0)))
                    found += [(p, name, blob) for p in places]
            if found:
                place, name, blob = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([p % cells for p in place], pa.int64()), pa.array(place, pa.int64()), pa.array(name, pa.int64()), pa.array(blob, pa.binary())], names=["part", "cell", "name", "blob"])

    def verify(table: pa.Table) -> pa.Table:
        cell, name = table.column("cell").to_numpy(), table.column("name").to_numpy()
        blobs = table.column("blob").to_pylist()
        order = np.lexsort((name, cell))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            rows = rows[np.append(True, np.diff(name[rows]) != 0)]
            a, b = cell_links(name[rows], [np.cumsum(columns.load(blobs[r])[0]) for r in rows.tolist()], percent)
            out_a.append(a)
            out_b.append(b)
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    texts = docs.select("doc_id", "text").join(placed, "doc_id").select("text", "name", "places")
    sets = texts.mapInArrow(tidy(fetch), "part long, cell long, name long, blob binary")
    return materialise(sets.groupBy("part").applyInArrow(verify, "a long, b long"), "links")


def components(docs: DataFrame, size: int = 4, percent: int = 85, frequent: int = 8, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parts, math.ceil(n_bytes / (16 << 20)))
    often = _frequent(docs, size, percent, frequent, parts)
    found = _candidates(docs, size, percent, often, parts)
    named = found.filter("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("name"), "n")
    often_met = found.filter("kind = 2").groupBy("a", "b", "n").agg(F.sum("c").alias("c")).filter(F.col("c") >= F.col("n"))
    near = found.filter("kind = 0").select("a", "b").unionByName(often_met.select("a", "b"))
    clusters = connected(near).withColumnRenamed("node", "name")
    least = named.filter("doc_id IS NOT NULL AND n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    needed = materialise(least.join(clusters, "name").withColumnRenamed("component", "cluster"), "needed")
    sizes = materialise(needed.groupBy("cluster").agg(F.count("*").alias("members")), "cluster-sizes")
    links = _verified(docs, needed.join(sizes, "cluster"), size, percent, block, 4 * parts)
    joined = connected(links).withColumnRenamed("node", "name")
    placed = materialise(
        named.join(joined, "name", "left").select("doc_id", "n", F.coalesce("component", "name").alias("component")), "placed"
    )
    first = materialise(placed.groupBy("component").agg(F.min("doc_id").alias("first")), "firsts")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("first")).otherwise(F.col("doc_id"))
    return placed.join(first, "component").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The document with the least doc_id of each component, with all columns; rows without doc_id stay."""
    others = components(docs, **params).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
