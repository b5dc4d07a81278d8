"""Secrets in texts: an Aho-Corasick automaton of keywords, regular expressions anchored at its hits, then checksums.

The automaton runs once over the bytes of a text with A-Z lowered. A regular expression is tried only where a keyword of
its kind was hit, at that place, and never searches. Runs of hexadecimal digits have no keyword: every eighth byte is
looked at instead, since a run of 24 holds three such places in a row, and the expression is tried around those.
Candidates of the kinds with an embedded checksum count only if it holds.

Kinds, in this order:
  assign   a name such as password or api_key, a sign and a value of 6 characters or more
  access   AKIA and capitals or digits, 20 characters or more
  hex      24 or more of 0-9 a-f
  token    gh?_ or npm_ with 36 characters, the last six being the CRC-32 of the others in base 62
  xprv     an extended private key, base 58 with its four bytes of a double SHA-256
  card     13 to 19 digits after a word for a card, with the check digit of Luhn's formula
Matches of one kind are the leftmost ones that do not overlap; a match that is too short or fails its checksum is dropped
but has used up its text. Kinds may overlap each other.

Defined results: a null or empty text has no span; repeated rows and null doc_ids are rows of their own; columns other
than doc_id and text are not read by ``find`` and stay as they are in ``redact``. Offsets are code points, the end is
exclusive. Nothing is shuffled and a text's length only costs its own memory.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.batches import by_bytes

KINDS = ("assign", "access", "hex", "token", "xprv", "card")
BASE_KINDS = KINDS[:3]

#: The names and prefixes that announce a secret.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "xprv": ("xprv",),
    "card": ("card", "visa", "amex"),
}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "token": re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "xprv": re.compile(rb"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![0-9A-Za-z])"),
    "card": re.compile(rb"([0-9](?:[ -]?[0-9]){12,18})(?![0-9])"),
}
#: Bytes after a word for a card within which its number begins.
CARD_WINDOW = 32
_DIGIT = re.compile(rb"[0-9]")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_STEP, _HEX_LENGTH = 8, 24
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def crc_holds(body: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62."""
    number = 0
    for c in body[-6:]:
        number = number * 62 + _BASE62.index(c)
    return number == zlib.crc32(body[:-6])


def base58_holds(body: bytes) -> bool:
    """Whether the last four bytes of a base 58 number begin the double SHA-256 of the others."""
    number = 0
    for c in body:
        number = number * 58 + _BASE58.index(c)
    data = number.to_bytes((number.bit_length() + 7) // 8, "big")
    data = b"\0" * (len(body) - len(body.lstrip(b"1"))) + data
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def luhn_holds(body: bytes) -> bool:
    digits = [c - 48 for c in body if 48 <= c <= 57]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0 and any(digits)


#: What a match must satisfy to count.
_VALID = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "hex": lambda m: len(m[0]) >= _HEX_LENGTH,
    "token": lambda m: crc_holds(m[1]),
    "xprv": lambda m: base58_holds(m[1]),
    "card": lambda m: luhn_holds(m[1]),
}


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def _hex_places(data: bytes) -> list[int]:
    """Places of which every run of 24 hexadecimal digits contains one, at most ``_STEP`` after the run's start."""
    probe = _HEX[np.frombuffer(data, np.uint8)[_STEP - 1 :: _STEP]]
    if len(probe) < 3:
        return []
    return (np.flatnonzero(probe[:-2] & probe[1:-1] & probe[2:]) * _STEP + _STEP - 1).tolist()


def _anchors(machine: ahocorasick.Automaton, data: bytes) -> dict[str, list[int]]:
    """By kind, the places where its expression is to be tried, ascending."""
    hits: dict[str, list[int]] = {"hex": _hex_places(data)}
    for end, (kind, size) in machine.iter(data.lower().decode("latin-1")):
        place = end - size + 1
        if kind == "card":
            digit = _DIGIT.search(data, end + 1, end + 1 + CARD_WINDOW)
            if digit is None:
                continue
            place = digit.start()
        hits.setdefault(kind, []).append(place)
    return hits


def spans_of(machine: ahocorasick.Automaton, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every secret in bytes of UTF-8, in that order; offsets are code points."""
    found = []
    for kind, places in _anchors(machine, data).items():
        free, number, pattern, valid = 0, KINDS.index(kind), PATTERNS[kind], _VALID[kind]
        for place in sorted(places):
            if place < free:
                continue
            if kind == "hex":
                while place > free and _HEX[data[place - 1]]:
                    place -= 1
            match = pattern.match(data, place)
            if match:
                free = match.end()
                if valid(match):
                    found.append((place, number, free))
    if found and not data.isascii():
        points = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        found = [(int(points[a]) - 1, k, int(points[b - 1])) for a, k, b in found]
    return sorted(found)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans, by start and then by kind as listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for rows in by_bytes(batches, "text"):
            spans = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(machine, data or b"")]
                for data in rows.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"])

    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets; overlapping spans count as one of the first's kind."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for rows in by_bytes(batches, "text"):
            texts = []
            for text in rows.column("text").to_pylist():
                parts, at = [], 0
                for a, k, b in spans_of(machine, (text or "").encode()):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                    at = max(at, b)
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
