"""Whole-number columns as one compressed byte string, for rows that carry many values through a shuffle."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard


def dump(*columns: np.ndarray) -> bytes:
    """Equally long 64-bit columns, each less its minimum and byte by byte without bytes that are zero everywhere."""
    n = len(columns[0])
    head, body = [struct.pack("<QB", n, len(columns))], []
    for column in columns:
        signed = column.dtype.kind == "i"
        low = column.min() if n else 0
        rest = (column - low).astype(np.uint64)
        planes = rest.astype("<u8", copy=False).view(np.uint8).reshape(n, 8).T
        used = [k for k in range(8) if planes[k].any()]
        head.append(struct.pack("<BqB" if signed else "<BQB", signed, int(low), sum(1 << k for k in used)))
        body += [np.ascontiguousarray(planes[k]).tobytes() for k in used]
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def load(data: bytes) -> list[np.ndarray]:
    n, count = struct.unpack_from("<QB", data)
    at, shapes = 9, []
    for _ in range(count):
        signed = data[at] == 1
        shapes.append((signed, *struct.unpack_from("<qB" if signed else "<QB", data, at + 1)))
        at += 10
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:]), np.uint8)
    out, start = [], 0
    for signed, low, used in shapes:
        planes = np.zeros((n, 8), np.uint8)
        for k in range(8):
            if used >> k & 1:
                planes[:, k] = body[start : start + n]
                start += n
        values = planes.view("<u8").reshape(n)
        out.append(values.astype(np.int64) + np.int64(low) if signed else values + np.uint64(low))
    return out


def pack(firsts: np.ndarray, kinds: str, *columns: np.ndarray) -> pa.Array:
    """The rows from each of ``firsts`` to the next as one byte string, without work for each string.

    ``kinds`` names the sign and the bytes of each column, as in ``"u8 i4"``; higher bytes are left out, so a signed column
    of less than 8 bytes has no negative values. Equal bytes lie together, which the shuffle's own compression uses.
    """
    n, sizes = len(columns[0]), [int(k[1]) for k in kinds.split()]
    width = sum(sizes)
    ends = np.append(firsts, n).astype(np.int64)
    counts = np.diff(ends)
    out = np.empty(n * width, np.uint8)
    at = np.arange(n) + np.repeat(ends[:-1] * (width - 1), counts)
    step = np.repeat(counts, counts)
    for column, size in zip(columns, sizes, strict=True):
        planes = np.ascontiguousarray(column).astype(f"<{column.dtype.kind}8", copy=False).view(np.uint8).reshape(n, 8)
        for k in range(size):
            out[at] = planes[:, k]
            at += step
    return strings(ends * width, out)


def unpack(blobs: pa.Array | pa.ChunkedArray, kinds: str) -> list[np.ndarray]:
    """The columns of all byte strings that ``pack`` has made with these ``kinds``, one after the other."""
    sizes = [int(k[1]) for k in kinds.split()]
    ends, data = contents(blobs)
    counts = np.diff(ends) // sum(sizes)
    n = int(counts.sum())
    at = np.arange(n) + np.repeat(ends[:-1] - (np.cumsum(counts) - counts), counts)
    step = np.repeat(counts, counts)
    out = []
    for kind, size in zip(kinds.split(), sizes, strict=True):
        planes = np.zeros((n, 8), np.uint8)
        for k in range(size):
            planes[:, k] = data[at]
            at += step
        out.append(planes.view(f"<{kind[0]}8").reshape(n))
    return out


def strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Byte strings of ``data``, from each of ``ends`` to the next."""
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GB in one array of byte strings")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def contents(blobs: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where byte strings end in their joint bytes, beginning with 0, and these bytes."""
    ends, data, size = [np.zeros(1, np.int64)], [], 0
    for chunk in blobs.chunks if isinstance(blobs, pa.ChunkedArray) else [blobs]:
        if len(chunk):
            places = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
            if places[-1] > places[0]:
                data.append(np.frombuffer(chunk.buffers()[2], np.uint8)[places[0] : places[-1]])
            ends.append(places[1:] - places[0] + size)
            size = int(ends[-1][-1])
    return np.concatenate(ends), np.concatenate(data) if data else np.zeros(0, np.uint8)
