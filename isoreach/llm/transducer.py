"""Token counts of a BPE vocabulary by a deterministic finite-state transducer.

Compilation. Let c(i) be the number of tokens of the first i characters and t(i) the last of them. A token u ends at i
with t(i) = u exactly if its merges stay apart from those of the token before it, that is, if the two alone are encoded
as the two; that token is unique. So what decides the rest of the text is, for each start p of a piece that may still be
unfinished at i, the trie node of the characters from p to i, t(p) and c(p) - c(i). These tuples are the states; there
are finitely many, since pieces have a greatest length. Each transition carries the number of tokens it adds,
c(i + 1) - c(i) (it may be negative: a merge takes back what looked like several tokens). States are numbered when
they are first met, and each worker keeps the compiled table; when the table is large it is dropped and compiled anew,
which costs time, not counts.

Running. The characters of a batch are cut into chunks of equal length that are run side by side, one array operation
per place. Each chunk has a map from entry states to exit states and tokens; chunks with the same characters share
one. It begins with one entry, found by running the ``WARM`` characters before the chunk; then, for all chunks at once,
the exits of a chunk that are no entry of the next one become entries there, until none is missing. A blank after another
character always leads to the same state, so in usual text the first entries are nearly all; a long run of one letter has
few different chunks. The maps, which now lead from entries to entries, are composed in doubling steps, which gives every
chunk's true entry. Where maps grow beyond ``MOST_ENTRIES`` a chunk on average, the rest of the chunks follow one by one.

A vocabulary with byte fallback gives an unknown character one token for each of its bytes. No piece joins a blank to
the character before it; the loader checks this and that every character of a piece is a piece.
"""

from __future__ import annotations

import numpy as np

BLANK = "▁"
WARM, CHUNK = 48, 1024
MOST_ENTRIES = 64
_MOST_STATES = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REST, _COUNT_0 = (1 << 40) - 1, 512


class _Cells:
    """Transitions by state * 2**16 + class in arrays with open addressing."""

    def __init__(self) -> None:
        self.bits, self.used = 16, 0
        self._make()

    def _make(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.adds = np.zeros(1 << self.bits, np.int16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot where it would go."""
        mask = (1 << self.bits) - 1
        slot = ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return slot

    def put(self, key: int, to: int, added: int) -> None:
        if 2 * self.used > len(self.keys):
            full = np.flatnonzero(self.keys >= 0)
            old = self.keys[full], self.next[full], self.adds[full]
            self.bits += 1
            self._make()
            for k, n, a in zip(*(x.tolist() for x in old), strict=True):
                self._set(k, n, a)
        self._set(key, to, added)
        self.used += 1

    def _set(self, key: int, to: int, added: int) -> None:
        slot = ((key * int(_MIX)) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] != -1:
            slot = (slot + 1) & ((1 << self.bits) - 1)
        self.keys[slot], self.next[slot], self.adds[slot] = key, to, added


class Transducer:
    def __init__(self, scores: dict[str, float], prefix: str = BLANK) -> None:
        """``scores``: the pieces that merges can make; the higher score merges first, ties from the left."""
        joined = [p for p in scores if BLANK in p[1:] and p.strip(BLANK)]
        single = [p for p in scores if len(p) > 1 and any(c not in scores for c in p)]
        if joined or single:
            raise ValueError(f"pieces that this transducer can't count: {(joined + single)[:3]}")
        self.scores, self.prefix = scores, prefix
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in scores:
            node = 0
            for c in p:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                node = self.trie[node][c]
            self.piece[node] = p
        self.names = [None, *scores]
        self.ids = {p: i for i, p in enumerate(self.names)}
        texts = [""] * len(self.trie)
        for n, children in enumerate(self.trie):
            for c, m in children.items():
                texts[m] = texts[n] + c
        self.in_word = [bool(t.strip(BLANK)) for t in texts]
        self.apart: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # Class 0: between documents. 1 to 4: unknown characters of so many bytes. 5: the blank. Then others, as met.
        self.classes = np.full(0x110000, -1, np.int16)
        self.chars = ["", "", "", "", "", BLANK]
        self.classes[[ord(" "), ord(BLANK)]] = 5
        # A state is a tuple of trie node, last piece and count, each packed into one number.
        self.states: list[tuple[int, ...]] = [(_COUNT_0,)]
        self.number = {self.states[0]: 0}
        self.cells = _Cells()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, before: int, piece: int) -> bool:
        key = before << 32 | piece
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            u = self.names[piece]
            if before == 0:
                known = self.merged(u) == [u]
            elif not self._apart(0, piece):
                known = False
            else:
                t = self.names[before]
                across = any(t[i:] + u[:j] in self.scores for i in range(len(t)) for j in range(1, len(u) + 1))
                known = not across or self.merged(t + u) == [t, u]
            self.apart[key] = known
        return known

    def _step(self, state: tuple[int, ...], cls: int) -> tuple[tuple[int, ...], int]:
        if cls < 5:
            return (_COUNT_0,), cls
        char = self.chars[cls]
        if cls == 5 and any(self.in_word[e >> 40] for e in state):
            state = (_COUNT_0,)
        last = added = None
        on = []
        for e in state:
            n = self.trie[e >> 40].get(char)
            if n is not None:
                on.append((n, e & _REST))
                if last is None and self.piece[n] is not None:
                    piece = self.ids[self.piece[n]]
                    if self._apart(e >> 10 & 0x3FFFFFFF, piece):
                        last, added = piece, (e & 0x3FF) - _COUNT_0 + 1
        if last is None:
            raise ValueError(f"no piece ends at {char!r}")
        return (*[(n << 40 | rest) - added for n, rest in on if self.trie[n]], last << 10 | _COUNT_0), added

    def _compile(self, keys: np.ndarray) -> None:
        """Adds the transitions ``keys`` (state * 2**16 + class)."""
        for key in np.unique(keys).tolist():
            to, added = self._step(self.states[key >> 16], key & 0xFFFF)
            if to not in self.number:
                self.number[to] = len(self.states)
                self.states.append(to)
            self.cells.put(key, self.number[to], added)

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]).tolist():
                char = chr(code)
                if char in self.scores:
                    self.classes[code] = len(self.chars)
                    self.chars.append(char)
                else:
                    self.classes[code] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            found = self.classes[codes]
        return found.astype(np.int64)

    def _run(self, columns: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Runs all chunks place by place; ``columns[i]`` holds their classes at place i, ``out[i]`` gets the tokens."""
        for i, column in enumerate(columns):
            keys = (state << 16) | column
            slot = self.cells.slots(keys)
            missing = self.cells.keys[slot] < 0
            if missing.any():
                self._compile(keys[missing])
                slot = self.cells.slots(keys)
            state = self.cells.next[slot].astype(np.int64)
            if out is not None:
                out[i] = self.cells.adds[slot]
        return state

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > _MOST_STATES:
            self._clear()
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(texts):
            return sizes
        # Each text: the mark between documents, then the prefix (none for an empty text), then its characters.
        long = sizes + 1 + (sizes > 0) * len(self.prefix)
        text = "".join("\0" + self.prefix + t if t else "\0" for t in texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(long) - long
        classes = self._classify(codes)
        classes[starts] = 0
        n = len(classes)
        chunks = -(-n // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.int64)
        padded[:n] = classes
        grid = padded.reshape(chunks, CHUNK)
        warm = np.zeros((chunks, WARM), np.int64)
        warm[1:] = grid[:-1, -WARM:]
        columns = np.ascontiguousarray(grid.T)
        entry = self._run(np.ascontiguousarray(warm.T), np.zeros(chunks, np.int64), None)
        kinds: dict[bytes, int] = {}
        content = np.array([kinds.setdefault(row.astype(np.int16).tobytes(), len(kinds)) for row in grid], np.int64)
        maps = _Maps(content)
        place = np.zeros(len(kinds), np.int64)  # of some chunk with these characters
        place[content] = np.arange(chunks)
        wanted = maps.missing(content, entry)
        while len(wanted[0]):
            added = np.empty((CHUNK, len(wanted[0])), np.int16)
            leave = self._run(columns[:, place[wanted[0]]], wanted[1], added)
            wanted = maps.add(*wanted, leave, added)
            if len(maps.kind) > MOST_ENTRIES * chunks:
                break
        added = np.empty((CHUNK, chunks), np.int16)
        known, state = maps.follow(int(entry[0]), added)
        for k in range(known, chunks):
            state = int(self._run(columns[:, k : k + 1], np.array([state]), added[:, k : k + 1])[0])
        return np.add.reduceat(added.T.reshape(-1)[:n].astype(np.int64), starts)


class _Maps:
    """Maps of chunks, by their content: entry states, and where each leads."""

    def __init__(self, content: np.ndarray) -> None:
        self.content = content
        self.after: dict[int, set[int]] = {}
        for a, b in zip(content[:-1].tolist(), content[1:].tolist(), strict=True):
            self.after.setdefault(a, set()).add(b)
        #: Number of each entry (content, state), and by number its content, exit and rank in its map.
        self.known: dict[tuple[int, int], int] = {}
        self.kind, self.leave, self.rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blocks: list[np.ndarray] = []
        self.firsts: list[int] = []

    def missing(self, content: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different entries among these that are not known."""
        new = set(zip(content.tolist(), state.tolist(), strict=True)).difference(self.known)
        out = np.array(sorted(new), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def add(self, content: np.ndarray, entry: np.ndarray, leave: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes entries with their exits and tokens; returns the entries that are missing now."""
        first = len(self.kind)
        self.firsts.append(first)
        self.blocks.append(added)
        self.known.update(zip(zip(content.tolist(), entry.tolist(), strict=True), range(first, first + len(content)), strict=True))
        sizes = np.bincount(self.kind, minlength=int(content.max()) + 1)
        order = np.argsort(content, kind="stable")
        nth = np.empty(len(content), np.int64)
        nth[order] = np.arange(len(content)) - np.searchsorted(content[order], content[order], "left")
        self.rank = np.concatenate([self.rank, sizes[content] + nth])
        self.kind, self.leave = np.concatenate([self.kind, content]), np.concatenate([self.leave, leave])
        pairs = [(b, s) for a, s in zip(content.tolist(), leave.tolist(), strict=True) for b in self.after.get(a, ())]
        nexts = np.array(pairs, np.int64).reshape(-1, 2)
        return self.missing(nexts[:, 0], nexts[:, 1])

    def follow(self, entry: int, out: np.ndarray) -> tuple[int, int]:
        """Tokens of the chunks on the way from the first chunk's entry; how many are known, and the exit of the last."""
        order = np.argsort(self.kind, kind="stable")
        entries = {}
        for numbers in np.split(order, np.flatnonzero(np.diff(self.kind[order])) + 1):
            entries[int(self.kind[numbers[0]])] = numbers[np.argsort(self.rank[numbers])]
        # Every chunk's entries in a row, chunk after chunk; the last place stands for an entry that is not known.
        sizes = np.array([len(entries[c]) for c in self.content.tolist()], np.int64)
        start = np.cumsum(sizes) - sizes
        none = int(sizes.sum())
        steps: dict[tuple[int, int], np.ndarray] = {}
        jump = np.full(none + 1, none, np.int64)
        for k, (a, b) in enumerate(zip(self.content[:-1].tolist(), self.content[1:].tolist(), strict=True)):
            if (a, b) not in steps:
                to = [self.known.get((b, s), -1) for s in self.leave[entries[a]].tolist()]
                steps[a, b] = np.array([self.rank[t] if t >= 0 else -1 for t in to], np.int64)
            rank = steps[a, b]
            jump[start[k] : start[k] + sizes[k]] = np.where(rank < 0, none, start[k + 1] + rank)
        number = self.known.get((int(self.content[0]), entry))
        way = np.array([none if number is None else self.rank[number]], np.int64)
        while len(way) < len(self.content):  # the way of twice the length, then the maps of twice as many chunks
            way = np.concatenate([way, jump[way]])
            jump = jump[jump]
        way = way[: len(self.content)]
        way = way[: int(np.argmax(np.append(way == none, True)))]
        met = np.array([entries[c][w - a] for c, w, a in zip(self.content.tolist(), way.tolist(), start.tolist(), strict=False)], np.int64)
        rounds = np.searchsorted(self.firsts, met, "right") - 1
        for r in np.unique(rounds).tolist():
            here = np.flatnonzero(rounds == r)
            out[:, here] = self.blocks[r][:, met[here] - self.firsts[r]]
        return len(met), int(self.leave[met[-1]]) if len(met) else entry


def sentencepiece(path: str) -> Transducer:
    """From a sentencepiece BPE model with byte fallback and no normalisation."""
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=path)
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    return Transducer(scores)
