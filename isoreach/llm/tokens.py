"""Token ids of whole texts by a tokenizer file, inside Spark tasks.

White space separates tokens for the word tokenizer, so texts are cut at blanks and line ends, by Arrow, many texts at a
time. Each distinct piece of such a group is looked up once. A piece that is one word of plain letters, perhaps with a
mark after it, has the ids of the word in lower case and those of the mark; new words are given to the library many at
once, and the vocabulary's word ends tell them apart. Other pieces go to the library as they are. The ids of each
distinct piece are one binary value, and Arrow takes these in the order of the pieces. Tests compare this with the
library on whole texts.

A table of at most ``MOST_WORDS`` words stays with the worker process across tasks: where it is full, those met in one
group only go. That costs time, not ids. Texts beyond ``LONG`` characters are cut at a blank, so that memory follows the
group and not the text (a longer text without any blank is one piece).
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 300_000
LONG = 4 << 20
_KEPT_LENGTH = 80
#: Letters whose lower case and composition are the same for any library, and marks that are tokens of their own.
_MARKS = ".,;:!?|"
_PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{_MARKS}]?$"


def _check(path: str) -> None:
    """The shortcuts above hold for lower-casing word tokenizers whose tokens mark word ends."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    steps = (held.get("normalizer") or {}).get("normalizers", [])
    if held["model"].get("end_of_word_suffix") != "</w>" or not any(s.get("type") == "Lowercase" for s in steps):
        raise ValueError(f"{path} is no lower-casing word tokenizer with '</w>' at word ends")


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _check(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        #: Row of every known word or piece; row k has ids flat[starts[k]:starts[k + 1]] and was met in met[k] groups.
        self.rows: dict[str, int] = {}
        self.flat, self.starts, self.met = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)
        marks = ["", *_MARKS]
        self._append(marks, [self.tokenizer.encode(m, add_special_tokens=False).ids for m in marks])
        self.fixed = len(marks)

    def _append(self, names: list[str], ids: list[list[int]]) -> None:
        self._append_flat(names, np.array([i for row in ids for i in row], self.dtype), np.array([len(row) for row in ids], np.int64))

    def _append_flat(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.met)
        self.rows.update(zip(names, range(first, first + len(names)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.met = np.concatenate([self.met, np.zeros(len(names), np.int64)])

    def _shrink(self) -> None:
        """Keeps the words met in several groups, the most often met ones if these are too many."""
        often = np.sort(self.met)[-(MOST_WORDS // 2)] if len(self.met) > MOST_WORDS // 2 else 0
        keep = self.met >= max(2, often + 1)
        keep[: self.fixed] = True
        sizes = np.diff(self.starts)
        self.flat = self.flat[np.repeat(keep, sizes)]
        number = np.cumsum(keep) - 1
        self.rows = {w: int(number[k]) for w, k in self.rows.items() if keep[k]}
        self.starts = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.met = np.minimum(self.met[keep], 1)

    def _add_words(self, new: list[str]) -> None:
        """Plain words in lower case."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new):
            self._append_flat(new, ids.astype(self.dtype), np.diff(ends, prepend=0))
        else:
            self._append(new, [self.tokenizer.encode(w, add_special_tokens=False).ids for w in new])

    def _add_pieces(self, new: list[str]) -> None:
        """Pieces of any kind."""
        coded = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(new))
        self._append_flat(new, np.array(coded.ids, self.dtype), sizes)

    def _rows_of(self, names: list[str], add) -> np.ndarray:
        """Rows of distinct names; ``add`` appends those of the new ones in their order."""
        out = np.fromiter((self.rows.get(w, -1) for w in names), np.int64, len(names))
        unknown = np.flatnonzero(out < 0)
        new = [names[k] for k in unknown.tolist()]
        if new:
            out[unknown] = np.arange(len(self.met), len(self.met) + len(new))
            add(new)
        self.met[out] += 1
        for w in new:
            if len(w) > _KEPT_LENGTH:
                del self.rows[w]
        return out

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has."""
        if len(self.met) > MOST_WORDS or len(self.flat) > 8 * MOST_WORDS:
            self._shrink()
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False)
        word, mark = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        chosen = pieces.filter(pa.array(plain))
        bare = pc.utf8_rtrim(chosen, characters=_MARKS)
        marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(chosen)).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(bare).dictionary_encode()
        word[plain] = self._rows_of(_strings(lower.dictionary), self._add_words)[lower.indices.to_numpy()] if len(chosen) else 0
        last = pc.utf8_slice_codeunits(chosen.filter(pa.array(marked)), -1)
        # The marks' rows follow that of the empty string, see above.
        mark[np.flatnonzero(plain)[marked]] = 1 + pc.index_in(last, value_set=pa.array([*_MARKS])).to_numpy()
        odd = np.flatnonzero(~plain)
        if len(odd):
            word[odd] = self._rows_of(_strings(pieces.take(pa.array(odd))), self._add_pieces)
        rows = np.empty(2 * len(pieces), np.int64)
        rows[::2], rows[1::2] = word, mark
        sizes = np.diff(self.starts)[rows]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.starts[rows] - before, sizes) + np.arange(int(sizes.sum()))]
        width = self.dtype.itemsize
        bounds = width * np.append(before[::2], len(ids)).astype(np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
        _, ends, data = values.take(coded.indices).buffers()
        ends = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()] // width
        return np.frombuffer(data or b"", self.dtype, int(ends[-1])), np.diff(ends)

    def _one(self, text: str) -> bytes:
        """A long text, in stretches that end at a blank."""
        out, at = [], 0
        while at < len(text):
            end = at + LONG
            if end < len(text):
                last = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                if last <= at:
                    later = [p for p in (text.find(" ", end), text.find("\n", end)) if p >= 0]
                    last = min(later, default=len(text))
                end = last
            out.append(self._group(pa.array([text[at:end]]))[0].tobytes())
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        short = [t if len(t) <= LONG else "" for t in texts]
        ids, sizes = self._group(pa.array(short, pa.string()))
        data, width = ids.tobytes(), self.dtype.itemsize
        ends = (np.cumsum(sizes) * width).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return [c if len(t) <= LONG else self._one(t) for t, c in zip(texts, out, strict=True)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
