"""Repeated passages of at least 50 bytes across documents, exactly, by sorting suffixes.

Which suffixes. Of all suffixes only those at anchors are sorted: in every window of ``length`` bytes the place whose
first ``GRAM`` bytes have the least hash. Equal windows have equal anchors, so documents that share a window share that
anchor's leading bytes, and about one place in seventeen is an anchor.

Sort. Splitters are sampled from the suffixes' leading bytes; every task cuts its suffixes at the splitters and sends
each range on as one row. A bucket sorts its suffixes column by column: leading eight bytes, hash of the first ``GRAM``
bytes, hash of the anchor's span (all windows that have this anchor), doc_id. Suffixes with the same leading bytes are
never on both sides of a splitter. Equal spans repeat wholly: all but those in the smallest doc_id are covered.

Boundaries. Where one document's repeated passage ends, spans differ although some of their windows agree. One span
for each different content (not each copy) of such leading bytes is fetched from its text and compared with the others
window by window. Texts move once: both joins with the texts reuse one exchange, by a hash of doc_id.

A passage that a third of all documents share costs one suffix for each task, since a task sends each equal span once,
for its smallest doc_id, and settles the others itself.

Sending. Every task sends to every bucket, so there are as many rows as tasks times buckets, with a square of the input,
until each suffix is a row of its own. A row's bytes are therefore cut from arrays and read as arrays, all rows at once.

Defined results: matches never cross documents; a null text is empty; a document with a null doc_id has no place in the
order, is compared with nothing and keeps its text; rows that share a doc_id are the same document and do not remove
each other's bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.llm import columns
from isoreach.llm.batches import by_bytes, give_back, tidy
from isoreach.llm.grams import BYTE, Rolling, least, mix, powers
from isoreach.session import materialise

GRAM = 16
_PLACE = np.uint64(24)
#: Bytes handled as one array; a longer text is taken in parts that overlap, so that each window lies in one part.
_BUFFER = (1 << 20) - 64
_FLUSH = 600_000
#: Documents, and bytes of them, that are taken at a time.
_ROWS = 250
_SLICE_BYTES = 2 << 20
_BLOBS = "part long, kind int, blob binary"
_SPANS = _BLOBS + ", bytes binary"
#: Bytes of spans to compare that are sent on at a time.
_SPAN_BYTES = 4 << 20
#: Columns of what is sent, with their bytes: suffixes (lead, gram, span, doc, at), covered anchors (doc, at, check), anchors
#: to compare (and group), their spans (group, doc, lo, hi - lo), runs of windows (doc, first, last, mark).
_SUFFIX, _COVERED, _OPEN, _SPAN, _RUN = "u8 u2 u5 i8 i4", "i8 i4 u2", "i8 i4 u2 i8", "i8 i8 i4 i4", "i8 i4 i4 u2"


@dataclass
class Anchors:
    """Of some texts, in order: document (index), anchor, first and last window start (places in the text), hashes."""

    doc: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    lead: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Whole texts, or parts of a long one, that fit a buffer: ((index, place of the part) of each, their bytes)."""
    step = _BUFFER
    names: list[tuple[int, int]] = []
    pieces: list[bytes] = []
    size = 0
    for index, text in enumerate(texts):
        for first in range(0, max(1, len(text) - length + 1), step):
            piece = text[first : first + step + length - 1]
            if size and size + len(piece) > _BUFFER:
                yield names, pieces
                names, pieces, size = [], [], 0
            names.append((index, first))
            pieces.append(piece)
            size += len(piece)
    if names:
        yield names, pieces


def anchors_of(texts: list[bytes], length: int) -> Anchors:
    found = []
    for names, pieces in _parts(texts, length):
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if len(buffer) < length:
            continue
        rolling = Rolling(buffer)
        grams = rolling.every(GRAM)
        ranked = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (least(ranked, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        change = np.zeros(len(buffer) + 1, np.int64)
        enough = sizes >= length
        np.add.at(change, starts[enough], 1)
        np.add.at(change, ends[enough] - length + 1, -1)
        valid = np.cumsum(change[: len(at)]) > 0
        first, last = valid.copy(), valid.copy()
        differs = at[1:] != at[:-1]
        first[1:] &= ~valid[:-1] | differs
        last[:-1] &= ~valid[1:] | differs
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        at = at[lo]
        piece = np.searchsorted(ends, lo, "right")
        index, offset = (np.array(x, np.int64) for x in zip(*names, strict=True))
        shift = offset[piece] - starts[piece]
        lead = np.zeros(len(at), np.uint64)
        for k in range(8):
            lead = lead << np.uint64(8) | buffer[at + k]
        found.append((index[piece], at + shift, lo + shift, hi + shift, lead, grams[at] & np.uint64(0xFFFF), rolling.of(lo, hi + length) >> np.uint64(24)))
    if not found:
        none, numbers = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Anchors(none, none, none, none, numbers, numbers, numbers)
    return Anchors(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _texts(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _bucket(lead: np.ndarray, gram: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many splitters (lead, gram) are not above each suffix."""
    leads, number = np.unique(split[0], return_inverse=True)
    if not len(leads):
        return np.zeros(len(lead), np.int64)
    # A place among the splitters' leads: odd at one of them, where the gram decides, even between two.
    place = np.searchsorted(leads, lead, "left")
    same = leads[np.minimum(place, len(leads) - 1)] == lead
    own = (2 * place + same).astype(np.uint64) << np.uint64(16) | np.where(same, gram, np.uint64(0))
    return np.searchsorted((2 * number + 1).astype(np.uint64) << np.uint64(16) | split[1], own, "right")


def _rows(part: np.ndarray, kind: int, *blobs: pa.Array) -> pa.RecordBatch:
    names = ["part", "kind", "blob", "bytes"][: 2 + len(blobs)]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.full(len(part), kind), pa.int32()), *blobs], names=names)


def _none(names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in map(str.split, names.split(", "))]).empty_table()


def _by(part: np.ndarray, kind: int, kinds: str, *values: np.ndarray) -> pa.RecordBatch:
    """One row for each value of ``part``, holding its values."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    firsts = np.flatnonzero(_firsts(part))
    return _rows(part[firsts], kind, columns.pack(firsts, kinds, *(v[order] for v in values)))


def _blobs(table: pa.Table, kind: int) -> pa.ChunkedArray:
    return table.filter(pc.equal(table.column("kind"), kind)).column("blob")


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def remove_repeats(
    docs: DataFrame, length: int = 50, bucket_suffixes: int = 250_000, group_bytes: int = 8 << 20, as_texts: bool = False
) -> DataFrame:
    """All columns of ``docs`` and: kept (binary, the bytes that stay), n_bytes, n_removed, n_spans.

    Columns of ``docs`` that have one of these four names are replaced. With ``as_texts`` the columns of ``docs`` only, as
    ``cut_texts`` describes them.
    """
    spark = docs.sparkSession
    docs = docs if as_texts else docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_bytes = size["b"] or 0
    groups = max(shuffles, math.ceil(n_bytes / group_bytes))
    buckets = max(shuffles, math.ceil(n_bytes / 16 / bucket_suffixes))
    split = _splitters(docs, length, size["n"], buckets)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lead, gram, span, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, span, gram, lead))
            lead, gram, span, doc, at = lead[order], gram[order], span[order], doc[order], at[order]
            first = np.flatnonzero(_firsts(lead, gram, span))
            least_doc = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
            mine = doc == least_doc
            yield _by(np.mod(doc[~mine], buckets), 1, _COVERED, doc[~mine], at[~mine], span[~mine] & np.uint64(0xFFFF))
            yield _by(_bucket(lead[mine], gram[mine], split), 0, _SUFFIX, lead[mine], gram[mine], span[mine], doc[mine], at[mine])

        for rows in by_bytes(batches, "text", _SLICE_BYTES, _ROWS):
            rows = rows.filter(rows.column("doc_id").is_valid())
            ids = rows.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            a = anchors_of(_texts(rows), length)
            held.append((a.lead, a.gram, a.span, ids[a.doc], a.at))
            count += len(a.at)
            if count >= _FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def sort_bucket(table: pa.Table) -> pa.Table:
        """kind 0: covered anchors; kind 1: spans to compare, with the number of their leading bytes."""
        give_back()
        out = []
        bucket = table.column("part")[0].as_py()
        doc, at, check = columns.unpack(_blobs(table, 1), _COVERED)
        out.append(_by(np.mod(doc, groups), 0, _COVERED, doc, at, check))
        lead, gram, span, doc, at = columns.unpack(_blobs(table, 0), _SUFFIX)
        if len(lead):
            order = np.lexsort((doc, span, gram, lead))
            lead, gram, span, doc, at = lead[order], gram[order], span[order], doc[order], at[order]
            check = span & np.uint64(0xFFFF)
            key_first, span_first = _firsts(lead, gram), _firsts(lead, gram, span)
            starts = np.flatnonzero(span_first)
            least_doc = np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))
            mine = doc == least_doc
            out.append(_by(np.mod(doc[~mine], groups), 0, _COVERED, doc[~mine], at[~mine], check[~mine]))
            number = np.cumsum(key_first) - 1
            low = np.minimum.reduceat(doc, np.flatnonzero(key_first))
            high = np.maximum.reduceat(np.where(mine, doc, low[number]), np.flatnonzero(key_first))
            spans = np.bincount(number[span_first])
            open_ = mine & ((spans > 1) & (high > low))[number]
            group = number[open_] + (np.int64(bucket) << np.int64(32))
            out.append(_by(np.mod(doc[open_], groups), 1, _OPEN, doc[open_], at[open_], check[open_], group))
        return pa.Table.from_batches(out)

    sent = docs.select("doc_id", "text").mapInArrow(tidy(suffixes), _BLOBS)
    settled = materialise(sent.groupBy("part").applyInArrow(sort_bucket, _BLOBS), "suffix-buckets")
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(groups))).otherwise(F.pmod("doc_id", F.lit(groups)))
    own = "_part"
    while own in docs.columns:
        own += "_"
    grouped = docs.withColumn(own, part.cast("long")).groupBy(own)

    def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The spans to compare: kind 2, by bucket."""
        give_back()
        if not wanted.num_rows or not texts.num_rows:
            return _none(_SPANS)
        doc, at, check, group = columns.unpack(wanted.column("blob"), _OPEN)
        out, held, count = [], [], 0

        def flush() -> None:
            group, doc, lo, more, data = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = group >> np.int64(32)
            order = np.argsort(bucket, kind="stable")
            sizes = more + length
            starts = np.cumsum(sizes) - sizes
            group, doc, lo, more, bucket = group[order], doc[order], lo[order], more[order], bucket[order]
            firsts = np.flatnonzero(_firsts(bucket))
            ends = np.append(0, np.cumsum(sizes[order]))[np.append(firsts, len(bucket))]
            out.append(_rows(bucket[firsts], 2, columns.pack(firsts, _SPAN, group, doc, lo, more), columns.strings(ends, _pieces(data, starts[order], sizes[order]))))

        for rows in _slices(texts):
            ids = _ids(rows)
            raw = _texts(rows)
            a = anchors_of(raw, length)
            a_doc, a_check = ids[a.doc], a.span & np.uint64(0xFFFF)
            mine, theirs = _matches((a_doc, a.at, a_check), (doc, at, check))
            if len(mine):
                sizes = np.array([len(t) for t in raw], np.int64)
                base, buffer = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), np.uint8)
                lo, more = a.lo[mine], a.hi[mine] - a.lo[mine]
                for x, y in _runs(more + length, _SPAN_BYTES):
                    m = mine[x:y]
                    data = _pieces(buffer, base[a.doc[m]] + lo[x:y], more[x:y] + length)
                    held.append((group[theirs[x:y]], a_doc[m], lo[x:y], more[x:y], data))
                    count += len(data)
                    if count >= _SPAN_BYTES:
                        flush()
                        held, count = [], 0
        if count:
            flush()
        return pa.Table.from_batches(out) if out else _none(_SPANS)

    def compare(table: pa.Table) -> pa.Table:
        """Windows that a smaller doc_id has too: kind 3, first and last window start."""
        give_back()
        group, doc, lo, more = columns.unpack(table.column("blob"), _SPAN)
        hashes = Rolling(columns.contents(table.column("bytes"))[1]).every(length)
        sizes = more + length
        starts = np.cumsum(sizes) - sizes
        span = np.repeat(np.arange(len(more)), more + 1)
        nth = np.arange(len(span)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        window = mix(hashes[starts[span] + nth] ^ mix(group[span].astype(np.uint64)))
        order = np.lexsort((doc[span], window))
        firsts = np.flatnonzero(_firsts(window[order]))
        least_doc = np.empty(len(order), np.int64)
        least_doc[order] = np.repeat(doc[span][order][firsts], np.diff(np.append(firsts, len(order))))
        covered = doc[span] != least_doc
        # Runs of covered windows within a span.
        before = np.append(False, covered[:-1] & (span[1:] == span[:-1]))
        after = np.append(covered[1:] & (span[1:] == span[:-1]), False)
        a, b = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
        run_doc = doc[span[a]]
        first = lo[span[a]] + nth[a]
        # An anchor's check also tells which of several texts with one doc_id is meant; here its span's hash does.
        mark = hashes[starts[span[a]] + nth[a]] & np.uint64(0xFFFF)
        return pa.Table.from_batches([_by(np.mod(run_doc, groups), 3, _RUN, run_doc, first, lo[span[b]] + nth[b], mark)])

    spans = grouped.cogroup(settled.filter("kind = 1").groupBy("part")).applyInArrow(fetch, _SPANS)
    compared = spans.groupBy("part").applyInArrow(compare, _BLOBS)
    covers = settled.filter("kind = 0").unionByName(compared)

    names = [f.name for f in docs.schema.fields]
    extra = [T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]]
    schema = docs.schema if as_texts else T.StructType([*docs.schema.fields, *extra])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        whole = columns.unpack(_blobs(found, 0), _COVERED)
        runs = columns.unpack(_blobs(found, 3), _RUN)
        out = []
        for rows in _slices(texts):
            ids, raw = _ids(rows), _texts(rows)
            sizes = np.array([len(t) for t in raw], np.int64)
            base = np.cumsum(sizes) - sizes
            buffer = np.frombuffer(b"".join(raw), np.uint8)
            change = np.zeros(len(buffer) + 1, np.int32)
            if len(whole[0]):
                a = anchors_of(raw, length)
                mine, _ = _matches((ids[a.doc], a.at, a.span & np.uint64(0xFFFF)), whole)
                np.add.at(change, base[a.doc[mine]] + a.lo[mine], 1)
                np.add.at(change, base[a.doc[mine]] + a.hi[mine] + length, -1)
            if len(runs[0]):
                _mark_runs(change, buffer, ids, base, sizes, runs, length)
            gone = np.cumsum(change[:-1]) > 0
            total = np.append(0, np.cumsum(gone))
            ends = base + sizes
            first = gone & ~np.append(False, gone[:-1])
            first[base[sizes > 0]] = gone[base[sizes > 0]]
            n_spans = np.append(0, np.cumsum(first))
            kept = [buffer[x:y][~gone[x:y]].tobytes() for x, y in zip(base.tolist(), ends.tolist(), strict=True)]
            removed = total[ends] - total[base]
            chunk = rows.select(names)
            if as_texts:
                out.append(_as_texts(chunk, kept, removed))
                continue
            for name, values in (("kept", pa.array(kept, pa.binary())), ("n_bytes", sizes), ("n_removed", removed), ("n_spans", n_spans[ends] - n_spans[base])):
                chunk = chunk.append_column(name, pa.array(values))
            out.append(chunk)
        if not out:
            out = [texts.select(names)]
            for name in [] if as_texts else ["kept", "n_bytes", "n_removed", "n_spans"]:
                out[0] = out[0].append_column(name, pa.array([], pa.binary() if name == "kept" else pa.int64()))
        give_back()
        return pa.concat_tables(out)

    return grouped.cogroup(covers.groupBy("part")).applyInArrow(cut, schema)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and last of the rows whose sizes together are about ``most``."""
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(sizes)], strict=True)


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of ``data`` from each start on, one piece after the other."""
    ends = np.cumsum(sizes)
    shift = starts - (ends - sizes)
    out = np.empty(sizes.sum(), np.uint8)
    for x, y in _runs(sizes, 1 << 18):
        first, last = ends[x] - sizes[x], ends[y - 1]
        out[first:last] = data[np.arange(first, last) + np.repeat(shift[x:y], sizes[x:y])]
    return out


def _slices(texts: pa.Table) -> Iterator[pa.Table]:
    return by_bytes([texts], "text", _SLICE_BYTES, _ROWS)


#: Stands for a null doc_id, which no list of matches holds.
_NO_ID = np.iinfo(np.int64).min


def _ids(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()


def _matches(mine: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal doc_id, place and check; several of mine may meet one of theirs."""
    docs = np.unique(mine[0])
    near = np.flatnonzero(np.isin(theirs[0], docs))

    def key(rows: tuple[np.ndarray, ...]) -> np.ndarray:
        number = np.searchsorted(docs, rows[0]).astype(np.uint64)
        return mix(mix(number) ^ mix(rows[1].astype(np.uint64) << np.uint64(16) | rows[2]) * np.uint64(3))

    wanted = key(tuple(c[near] for c in theirs))
    order = np.argsort(wanted, kind="stable")
    own = key(mine)
    place = np.searchsorted(wanted[order], own)
    hit = np.flatnonzero(place < len(order))
    hit = hit[wanted[order][place[hit]] == own[hit]]
    return hit, near[order[place[hit]]]


def _mark_runs(change, buffer, ids, base, sizes, runs, length) -> None:
    """Marks runs of windows, in every text of that doc_id whose first window has the run's hash."""
    doc, first, last, mark = runs
    order = np.argsort(ids, kind="stable")
    left, right = np.searchsorted(ids[order], doc, "left"), np.searchsorted(ids[order], doc, "right")
    rows = np.repeat(np.arange(len(doc)), right - left)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
    text = order[left[rows] + nth]
    inside = last[rows] + length <= sizes[text]
    rows, text = rows[inside], text[inside]
    if not len(rows):
        return
    start = base[text] + first[rows]
    data = BYTE[buffer[start[:, None] + np.arange(length)]] * powers(length)[0][:length]
    same = mix(data.sum(axis=1, dtype=np.uint64)) & np.uint64(0xFFFF) == mark[rows]
    rows, text, start = rows[same], text[same], start[same]
    np.add.at(change, start, 1)
    np.add.at(change, base[text] + last[rows] + length, -1)


def _splitters(docs: DataFrame, length: int, n_docs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of leading bytes from about 4000 documents, at most 1000 suffixes of each batch of them."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(0)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                a = anchors_of(_texts(batch.slice(k, 100)), length)
                some = rng.permutation(len(a.at))[:1000]
                yield pa.RecordBatch.from_arrays([pa.array(a.lead[some].view(np.int64)), pa.array(a.gram[some].view(np.int64))], names=["lead", "gram"])

    sample = docs.select("text").sample(fraction=min(1.0, 4000 / max(1, n_docs)), seed=1)
    rows = sample.mapInArrow(leading, "lead long, gram long").toPandas()
    lead, gram = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("lead", "gram"))
    order = np.lexsort((gram, lead))
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) >= buckets else order
    return lead[at], gram[at]


def cut_texts(docs: DataFrame, length: int = 50, **params) -> DataFrame:
    """The columns of ``docs`` with the repeats cut out of ``text`` and, where there is one, ``n_chars`` counted anew.

    A character that a cut has left in part is dropped. A text that is nothing but repeats goes with its row; one that
    was null or empty before stays.
    """
    return remove_repeats(docs, length, as_texts=True, **params)


def _as_texts(rows: pa.Table, kept: list[bytes], removed: np.ndarray) -> pa.Table:
    whole = pa.array(removed == 0)
    text = [k.decode("utf-8", "ignore") for k in kept]
    stays = pa.array((removed == 0) | np.array([t != "" for t in text], bool))
    new = {"text": pa.array(text), "n_chars": pa.array(list(map(len, text)), pa.int64())}
    for name, values in new.items():
        if name in rows.column_names:
            own = rows.column(name).combine_chunks()
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            at = rows.column_names.index(name)
            rows = rows.set_column(at, rows.schema.field(at), pc.if_else(whole, own, values.cast(own.type)))
    return rows.filter(stays)
