"""Concatenate and cut: documents laid end to end and cut into sequences of equal length.

First pass: every task encodes its documents and writes the ids with their start within the task's part. Second pass:
the parts' totals (one row per write task, which bounds what is broadcast) become global offsets by prefix sums, and
each document is cut where its global range crosses a multiple of the sequence length. The pieces are the boundary
records. No text and no ids are shuffled; only the last sequence of all is padded.

Defined results: a null text is empty and has only the end id; the order is that of the written parts, not of doc_id;
rows that share a doc_id are separate documents; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isoreach.llm.batches import by_bytes, tidy
from isoreach.llm.tokens import word_ids
from isoreach.session import materialise

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def encode(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """The written table (part, start_in_part, doc_id, n_tokens, ids as little-endian bytes, width in bytes)."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], dtype=coder.dtype).tobytes(), coder.dtype.itemsize
        for rows in by_bytes(batches, "text"):
            coded = [c + end for c in coder.encode([t or "" for t in rows.column("text").to_pylist()])]
            lengths = np.array([len(c) // width for c in coded], np.int64)
            starts = start + np.cumsum(lengths) - lengths
            start += int(lengths.sum())
            same = np.full(len(coded), part, np.int64), np.full(len(coded), width, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(same[0]), pa.array(starts), rows.column("doc_id").cast(pa.int64()), pa.array(lengths), pa.array(coded, pa.binary()), pa.array(same[1])],
                names=["part", "start_in_part", "doc_id", "n_tokens", "ids", "width"],
            )

    schema = "part long, start_in_part long, doc_id long, n_tokens long, ids binary, width int"
    return materialise(docs.select("doc_id", "text").mapInArrow(tidy(ids_of), schema), "token-ids")


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    coded = encode(docs, vocabulary, end_id)
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    placed = coded.join(F.broadcast(starts), "part")
    placed = placed.select("doc_id", "n_tokens", "ids", "width", (F.col("before") + F.col("start_in_part")).alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches, "ids"):
            n, place = rows.column("n_tokens").to_numpy(), rows.column("place").to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[doc] // length + nth
            first = np.maximum(place[doc], sequence * length)
            size = np.minimum(place[doc] + n[doc], (sequence + 1) * length) - first
            start = first - place[doc]
            kind = np.dtype(f"<u{rows.column('width')[0].as_py()}")
            wide = [np.frombuffer(b, kind).astype("<u4") for b in rows.column("ids").to_pylist()]
            parts = [wide[d][s : s + c] for d, s, c in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            crc = [zlib.crc32(p.tobytes()) for p in parts]
            ids = pa.array(parts if with_ids else [None] * len(parts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(first - sequence * length), ids],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    out = placed.mapInArrow(tidy(cut), PIECES)
    return out if with_ids else out.drop("ids")
