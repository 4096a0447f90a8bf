"""The pipeline's stages against brute force, one after the other."""

from test_near_dedup import brute

import corpus_pipeline
from huespan.llm.common import materialize
from huespan.llm.decontaminate import words_of


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        out = materialize(stage(spark, kept, sf), name)
        after = {r.doc_id for r in out.collect()}
        assert out.count() == len(after)
        if name == "toxicity":
            gone = before.keys() - after
            assert len(gone & clean) <= 0.01 * len(clean) and len(gone & toxic) > 0.75 * len(toxic)
        if name == "near_dedup":
            assert after == {d for d, _, _, keep in brute(sorted(before.items()))[0] if keep}
        if name == "decontamination":
            bench = [f" {' '.join(words_of(r.text))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert before.keys() - after == {d for d, t in before.items() if any(b in f" {' '.join(words_of(t))} " for b in bench)}
        if name == "bpe":
            assert after == before.keys()
        else:
            assert out.columns == docs.columns
        kept = out
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in kept.collect()}


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, sf):
    long = "word after word of a long text " * 20_000
    rows = [(None, None, None, 1.0, "a", 1), (None, "null id", "en", 2.0, "b", 2), (1, None, "en", None, None, None), (2, "", None, 1.0, "c", 3), (3, long, "en", 1.0, "c", 3), (3, long, "en", 1.0, "c", 3), (4, long, "en", 1.0, "d", 4), (5, "you stupid idiot", "en", 1.0, "e", 5), (6, "short", "en", 1.0, "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, token string, rep long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "score", "token", "rep"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "6", "None", "None"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out) == [("1", False), ("2", False), ("3", True), ("6", True), ("None", False), ("None", True)]
