"""The pipeline's stages against plain versions, one after another."""

from pyspark.sql import functions as F

import corpus_pipeline
from isoreach.llm.registry import table, vocabulary
from tests.llm.helpers import documents, jaccard_plain, repeats_plain
from tests.llm.test_tokens import check_pieces, ids_of


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "repeats", "decontamination", "packing"]
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        given = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "packing":
            check_pieces(out.collect(), [(d, ids_of(library, t)) for d, t in given])
            break
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out = corpus_pipeline.materialise(out, "test")
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "near_copies":
            assert set(got) == {d for d, _, c in jaccard_plain(given, 5, 80) if d == c}
        if name == "repeats":
            want = {d: k.decode("utf-8", "ignore") for d, k, n, _ in repeats_plain(given) if k or not n}
            assert got == {d: t for d, t in want.items() if t or d in got}
        if name in ("toxicity", "decontamination"):
            assert set(got) < set(d for d, _ in given) and len(got) > 0.8 * len(given)
        docs, before = out, got
    assert before


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_tables(spark, sf_dir):
    """Nothing at all; null and repeated ids, null and empty texts and a column that clashes."""
    some = [(None, "a row without an id"), (None, None), (5, "twice " * 30), (5, "twice " * 30), (6, ""), (7, None), (8, "kind words " * 40)]
    empty, odd = documents(spark, []), documents(spark, some).withColumn("part", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {None, 5, 6, 7, 8}
        else:
            assert out.columns == odd.columns
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert {d for d, _ in kept} == {None, 5, 6, 7, 8} and sum(d is None for d, _ in kept) == 2
            if name != "near_copies":
                assert sorted(kept, key=str) == sorted(some, key=str)
