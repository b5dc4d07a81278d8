"""Token ids in word-aligned blocks: an encoder, a decoder and the file format around them.

Packing. Ids go into 64-bit words. The upper four bits, the selector, say how many ids share the lower 60 bits and how
wide each is (``SHAPES``). Selector 0 is an escape: its 60 bits number an entry of the block's list of ids that need
more than 60 bits. The words of one selector decode with one shift and one mask on arrays.

File. A folder of Parquet files, written by Spark and so complete or absent whichever executors are lost. A row is a
block of whole documents in ascending doc_id order with at least ``block_ids`` ids (less in the last block of a part):

    part long, block int     order of blocks
    start_in_part long       ids of the part before the block
    doc_ids array<long>      the block's documents, and for each
    lengths array<long>      its number of ids
    words binary             packed ids, little-endian
    escapes binary           ids above 60 bits, little-endian 64-bit

Global starts are prefix sums in two steps: ids before a block within its part, known while writing, and totals of the
parts (one row per write task, which bounds what is broadcast) added when reading.

Defined results: a null text is empty and gets only the end id; a null doc_id comes first; rows that share a doc_id are
separate documents, ordered by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from isoreach.llm.batches import by_bytes, tidy
from isoreach.llm.tokens import word_ids

#: Fixed values of the format: ids per word and bits per id for selectors 1 to 14.
SHAPES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_BITS = 60

BLOCKS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("block", T.IntegerType()),
    T.StructField("start_in_part", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
    T.StructField("escapes", T.BinaryType()),
])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    selector = np.zeros(n, np.uint8)
    for number in range(len(SHAPES), 0, -1):  # widest ids first, so that a denser shape overwrites
        count, bits = SHAPES[number - 1]
        # A word may begin in a gap between ids that are too wide, where the gap has room for it.
        wide = np.flatnonzero(ids >> np.uint64(bits))
        if n - len(wide) < min(count, n):
            continue
        begins, ends = np.append(0, wide + 1), np.append(wide, n) - count + 1
        room = np.flatnonzero(ends > begins)
        begins, ends = begins[room], ends[room]
        if len(begins):
            inside = np.zeros(n + 1, np.int8)
            inside[begins] = 1
            inside[ends] = -1
            selector[np.cumsum(inside[:n], dtype=np.int8).view(bool)] = number
        # The block's last word may be short and is filled with zeros.
        selector[wide[-1] + 1 if len(wide) else 0 :] = number
    taken = np.array([1, *[c for c, _ in SHAPES]])[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += taken[i]
    at = np.array(starts, dtype=np.int64)
    kind = selector[at]
    words = kind.astype(np.uint64) << np.uint64(_BITS)
    padded = np.concatenate([ids, np.zeros(SHAPES[0][0], np.uint64)])
    for number, (count, bits) in enumerate(SHAPES, 1):
        rows = np.flatnonzero(kind == number)
        for k in range(count if len(rows) else 0):
            words[rows] |= padded[at[rows] + k] << np.uint64(k * bits)
    wide = np.flatnonzero(kind == 0)
    words[wide] |= np.arange(len(wide), dtype=np.uint64)
    return words, ids[at[wide]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    kind = (words >> np.uint64(_BITS)).astype(np.int64)
    counts = np.array([1, *[c for c, _ in SHAPES], 0])[kind]
    at = np.cumsum(counts) - counts
    out = np.zeros(n + SHAPES[0][0], np.uint64)
    for number, (count, bits) in enumerate(SHAPES, 1):
        rows = np.flatnonzero(kind == number)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            ids = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[(at[rows][:, None] + np.arange(count)).ravel()] = ids.ravel()
    wide = kind == 0
    out[at[wide]] = escapes[(words[wide] & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
    return out[:n]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, block_ids: int = 1 << 16) -> None:
    """Encodes all texts with the tokenizer file ``vocabulary``, adds ``end_id`` to each and writes the blocks."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_ids(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        block, start, doc_ids, coded, size = 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            words, escapes = pack(np.frombuffer(b"".join(coded), coder.dtype))
            lengths = [len(c) // coder.dtype.itemsize for c in coded]
            values = (part, block, start, doc_ids, lengths, words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=BLOCKS.names)

        for rows in by_bytes(batches, "text"):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                doc_ids.append(doc_id)
                coded.append(ids + end)
                size += len(ids) // coder.dtype.itemsize + 1
                if size >= block_ids:
                    yield row()
                    block, start, doc_ids, coded, size = block + 1, start + size, [], [], 0
        if coded:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(encode), BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: the ids of all documents before the block."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.sum(size).alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    return blocks.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), int(ends[-1]))
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    needed = read(spark, path).select("start", "doc_ids", "lengths", "words", "escapes")
    return needed.mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
