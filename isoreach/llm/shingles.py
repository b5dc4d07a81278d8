"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from isoreach.llm.grams import BYTE, Rolling, mix

#: Bytes that separate words.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
#: A-Z count as a-z.
_FOLDED = BYTE.copy()
_FOLDED[65:91] = BYTE[97:123]
_PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words each text has."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    start, end = edge[::2], edge[1::2]
    hashes = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + _PIECE)))
        a, b = int(start[first]), int(end[last - 1])
        hashes[first:last] = Rolling(data[a:b], _FOLDED).of(start[first:last] - a, end[first:last] - a)
        first = last
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    counts = np.diff(np.searchsorted(start, np.append(0, np.cumsum(sizes))))
    return hashes, counts


def sets_of(texts: list[bytes], size: int = 4) -> list[np.ndarray]:
    """The distinct ``size``-word shingles of each text; a text with fewer words is one shingle, without words none."""
    words, counts = word_hashes(texts)
    joined = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        joined = joined * _ODD + mix(words[k : k + len(joined)] + np.uint64(k))
    joined = mix(joined)
    out = []
    at = 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(joined[at : at + n - size + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one = one * _ODD + mix(words[at + k : at + k + 1] + np.uint64(k))
            out.append(mix(one))
        else:
            out.append(joined[:0])
        at += n
    return out


def name_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set's content, as a signed number."""
    total = mix(shingles).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(shingles * _ODD, initial=0)
    return int(mix(np.array([total], np.uint64) + np.uint64(len(shingles))).view(np.int64)[0])
