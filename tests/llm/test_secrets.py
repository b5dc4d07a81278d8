"""Secrets against plain searches with regular expressions over whole texts."""

import hashlib
import random
import re
import zlib

from isoreach.llm import registry, secret_scan
from tests.llm.helpers import documents, rows

BASE = {
    "assign": r"""((?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"(AKIA[A-Z0-9]+)()",
    "hex": r"([0-9a-f]+)()",
}
LEAST = {"access": 20, "hex": 24}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def plain(text):
    """Base spans by searching the whole text."""
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[2]) >= 6 if kind == "assign" else len(m[1]) >= LEAST[kind]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check(got, given):
    """Against (doc_id, text) in any order."""
    want = sorted(((d, plain(t)) for d, t in given), key=str)
    seen = []
    for r in got.collect():
        listed = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in listed) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        seen.append((r["doc_id"], listed))
    assert sorted(seen, key=str) == want


def token(rng, prefix="ghp_"):
    body = "".join(rng.choice(DIGITS) for _ in range(30))
    number, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, d = divmod(number, 62)
        tail = DIGITS[d] + tail
    return prefix + body + tail


def spliced(seed, n):
    rng = random.Random(seed)
    bits = [
        "password", "PassWd", "ſecret", "SECRET", "toKen", "toKen", "api_key", "apiKEY", "api", "_", "key", '"', "'", " ", "  ", "=", ":", "\n", "\t",
        "abc", "abcdef", "x/y+z.9-_", "AKIA", "AKIAKIA", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15, "akia", "deadbeef", "0123456789abcdef01234567", "0" * 23,
        "f" * 24, "F" * 24, "g", "é", "日本", "🙂", "0a1b2c3d" * 4,
    ]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_same_as_searching(spark):
    texts = [*spliced(1, 3000), None, "", "a" * 500_000, "deadbee " * 50_000 + "password=hunter22", "0123456789abcdef" * 30_000 + "z" + "ab" * 12]
    given = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    check(secret_scan.digest(secret_scan.find(documents(spark, given))), given)


def test_hex_runs_at_every_place():
    machine = secret_scan.automaton()
    for before in range(20):
        for size in range(20, 45):
            for after in ("", "xyz", "g" + "a" * 24):
                text = "g" * before + "c" * size + after
                got = [f"hex:{a}:{b}" for a, k, b in secret_scan.spans_of(machine, text.encode()) if k == 2]
                assert got == plain(text), text


def test_checksums(spark):
    rng = random.Random(3)
    good = [token(rng, p) for p in ("ghp_", "gho_", "npm_") for _ in range(50)]
    bad = [t[:9] + ("A" if t[9] != "A" else "B") + t[10:] for t in good]
    # A published test vector of extended keys.
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    number = "4111 1111 1111 1111"
    texts = [*good, *bad, key, key[:-1] + "j", f"Card no: {number}", number, "card 4111 1111 1111 1112", "card " + "0" * 16, "é " + good[0] + " é", good[0] + "x"]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"] if s["kind"] not in BASE] for r in secret_scan.find(documents(spark, list(enumerate(texts)))).collect()}
    n = len(good)
    assert all(got[k] == ["token"] for k in range(n)) and not any(got[k] for k in range(n, 2 * n))
    assert [got[2 * n + k] for k in range(8)] == [["xprv"], [], ["card"], [], [], [], ["token"], []]


def test_extra_columns_and_redaction(spark):
    given = documents(spark, [(1, "é password=hunter22 é"), (1, "é password=hunter22 é"), (2, None), (None, "x")])
    given = given.withColumnRenamed("lang", "spans").withColumnRenamed("n_chars", "base_sha256")
    assert secret_scan.digest(secret_scan.find(given)).count() == 4
    clean = secret_scan.redact(given)
    assert clean.columns == given.columns
    assert rows(clean, "doc_id", "text") == sorted([(1, "é [assign] é"), (1, "é [assign] é"), (2, None), (None, "x")], key=str)
    assert secret_scan.find(given.limit(0)).count() == 0


def test_query(spark, sf_dir):
    given = [(r["doc_id"], r["text"]) for r in registry.table(spark, sf_dir, "documents").collect()]
    check(registry.op12_secret_scan(spark, sf_dir), given)
