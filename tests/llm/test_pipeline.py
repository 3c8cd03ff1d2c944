"""The pipeline's stages, each against what it should do to its own input."""

import re

import corpus_pipeline
from tests.llm.test_corpus_operators import WORD, brute, measured


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "sentencepiece"]

    kept = stages["quality_rules"](spark, docs, small).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        n, _, symbols, _, repeats = measured(r["text"])
        if n < 20 or 100 * repeats > 30 * n or 4 * symbols > n:
            assert r["doc_id"] not in ids

    lines = stages["line_dedup"](spark, kept, small).cache()
    assert lines.columns == columns
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in lines.collect():
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split("\n")) <= set(before[r["doc_id"]].split("\n"))

    single = stages["near_dedup"](spark, lines, small).cache()
    want = brute([(r["doc_id"], r["text"]) for r in lines.collect()], 5)
    assert sorted(str(r["doc_id"]) for r in single.collect()) == sorted(i for i, _, lead in want if i == lead)

    mixed = stages["mixing"](spark, single, small).cache()
    assert mixed.columns == columns
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in single.collect()}
    taken = sum(sizes[r["doc_id"]] for r in mixed.collect())
    assert abs(taken / sum(sizes.values()) - 1.5) < 0.2

    final = stages["sentencepiece"](spark, mixed, small)
    assert final.count() == mixed.count() and final.filter("not round_trip").count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "ids" in out.columns
    assert not re.search("localCheckpoint", open(corpus_pipeline.__file__).read())
