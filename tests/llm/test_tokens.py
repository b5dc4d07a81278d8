import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from isoreach.llm import counting, packing, registry, tokenfile, tokens, transducer
from isoreach.llm.registry import vocabulary
from isoreach.llm.tokens import WordIds
from tests.llm.helpers import copies, documents, rows

WORDS, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
ODD = [(None, "no id"), (1, None), (2, ""), (3, "  \n"), (4, "<|endoftext|> it's"), (5, "long " * 9000), (5, "again"), (6, "x" * 6000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def noise(seed, n, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_pieces_are_encoded_as_in_the_whole_text(library):
    letters = [*"abcsé'tdm \n\t\r\x0b\x0cćΣßİA.,;|0123漢😀", "<|endoftext|>", "<|startoftext|>", " ", "\u0085", "﻿", " "]
    texts = noise(1, 1500, letters)
    coder = WordIds(WORDS)
    for _ in range(2):
        got = [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_and_a_full_table(library, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 500)
    monkeypatch.setattr(tokens, "MOST_WORDS", 40)
    texts = [*noise(2, 60, [*"ab \né"]), "a" * 3000, "ab c" * 900, " " * 1200, "x\n" * 700 + "y" * 600 + " z. " * 300, *(t for _, t in copies(3, 40))]
    coder = WordIds(WORDS)
    for k in range(0, 3 * len(texts), 7):
        some = [texts[(k + j) % len(texts)] for j in range(7)]
        got = [np.frombuffer(b, coder.dtype).tolist() for b in coder.encode(some)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert len(coder.rows) < 2000


def test_repeated_pieces_are_not_worked_on_one_by_one():
    coder, texts = WordIds(WORDS), ["A quick brown fox, and lazy dogs. " * 500] * 60
    coder.encode(texts)
    tracemalloc.start()
    try:
        coder.encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 16 * 60 * 3500
    finally:
        tracemalloc.stop()


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        WordIds(vocabulary("byte_bpe_50k.json"))


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    given = [rng.integers(0, hi, n).astype(np.uint64) for n in (0, 1, 5, 700, 5000) for hi in (1, 2, 300, 50_000, 2**62)]
    given.append(np.concatenate([rng.integers(0, 2 ** int(b), int(rng.integers(1, 90))).astype(np.uint64) for b in rng.integers(0, 63, 300)]))
    for ids in given:
        words, escapes = tokenfile.pack(ids)
        assert (tokenfile.unpack(words, escapes, len(ids)) == ids).all()
        assert (escapes >= 2**60).all()


def test_file_holds_every_document_in_order(spark, library, tmp_path):
    given = ODD + copies(5, 80)
    tokenfile.write(documents(spark, given), str(tmp_path / "f"), WORDS, block_ids=500)
    got = [tuple(r) for r in tokenfile.documents(spark, str(tmp_path / "f")).orderBy("start").collect()]
    start, want = 0, []
    for d, t in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, t)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_file_of_no_documents(spark, tmp_path):
    tokenfile.write(documents(spark, []), str(tmp_path / "f"), WORDS)
    assert tokenfile.documents(spark, str(tmp_path / "f")).count() == 0


def test_file_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    got = registry.op5_tokenfile(spark, sf_dir).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ids_of(library, texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def check_pieces(pieces, want):
    """``want``: (doc_id, ids) of every document."""
    places, docs = {}, {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for n, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or n == max(places)
    assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in want)
    whole = {(d, len(ids), crc(ids)): ids for d, ids in want}
    for d, n, c in whole:
        parts = sorted(docs[d, n], key=lambda p: p["start"])
        assert any(crc(whole[d, n, c][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for p in parts)


def test_pieces(spark, library):
    given = ODD + copies(6, 80)
    check_pieces(packing.pack(documents(spark, given), WORDS).collect(), [(d, ids_of(library, t)) for d, t in given])
    assert packing.pack(documents(spark, []), WORDS).count() == 0


def test_packing_query(spark, sf_dir, library):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {r["doc_id"]: ids_of(library, r["text"]) for r in texts}
    pieces = registry.op8_packing(spark, sf_dir).collect()
    check_pieces(pieces, list(ids.items()))
    for p in pieces:
        assert crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]


def test_transducer_counts_as_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = transducer.sentencepiece(PIECES)
    letters = [*"abcdethin   \n\t▁▁ABC.,;0123éß漢字梦①🙂_--__==　 ", "<s>", "</s>", "<unk>", "<0x0A>"]
    texts = [*noise(2, 1500, letters), "", "a", " ", "▁", " " * 5000, "ab" * 3000, "=" * 4097, "the" * 5000, "\x00"]
    assert machine.counts(texts).tolist() == [len(model.encode(t)) for t in texts]
    assert machine.counts([]).tolist() == []


def test_wrong_guesses_are_run_again(monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", 16)
    monkeypatch.setattr(transducer, "WARM", 1)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = noise(3, 60, "abcdethin") + noise(4, 60, "the and ")
    assert transducer.sentencepiece(PIECES).counts(texts).tolist() == [len(model.encode(t)) for t in texts]


def test_counts_query_and_odd_rows(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]

    def want(of):
        return sorted(((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in of), key=str)

    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows(registry.op9_token_counts(spark, sf_dir), *columns) == want(given)
    assert rows(counting.count_tokens(documents(spark, ODD), PIECES), *columns) == want(ODD)
    assert counting.count_tokens(documents(spark, []), PIECES).count() == 0


def test_long_runs_without_blanks():
    """Chunks whose entries depend on how a run began; equal chunks share a map."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = transducer.sentencepiece(PIECES)
    rng = random.Random(6)
    texts = ["a" * 20_000, "x" + "=" * 20_011, " " * 9_000, "ab" * 6_000, "".join(rng.choice("abcde") for _ in range(9_000)), "", "é" * 5_000 + "z" * 5_000]
    for limit in (64, 1, 0):
        transducer.MOST_ENTRIES, before = limit, transducer.MOST_ENTRIES
        assert machine.counts(texts).tolist() == [len(library.encode(t)) for t in texts]
        transducer.MOST_ENTRIES = before
    start = time.process_time()
    machine.counts(["a" * 300_000])
    assert time.process_time() - start < 3  # about 0.1 s; one by one it took 7
