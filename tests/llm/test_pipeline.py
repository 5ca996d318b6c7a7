"""The pipeline against a plain Python version of what its stages decide."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, queries, toxicity
from test_jaccard import plain_roots
from test_tokens import check_packing


def stage(spark, name, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_plain_version(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model, keep=["doc_id"]).where("predicted = 1").collect()}
    rows = [r for r in rows if r.doc_id not in bad]
    left = spark.createDataFrame(rows, docs.schema)
    found = {r.doc_id: r for r in langid.predict(left, langid.fit(left), keep=["doc_id"]).collect()}
    rows = [r for r in rows if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= corpus_pipeline.LEAST_SHARE]
    rows.sort(key=lambda r: r.doc_id)
    groups = plain_roots([r.text for r in rows])
    kept = {r.doc_id: r.text for k, r in enumerate(rows) if groups[k] == k}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(got, kept, Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), 2048)


def test_filters_keep_columns_and_values(spark, sf_dir, docs):
    clash = docs.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "fp": F.lit("f"), "row": F.lit(1), "__text": F.lit("t"), "lang_pred": F.lit("l"), "component_id": F.lit("c"), "label": F.lit(2.5)})
    before = {r.doc_id: r for r in clash.collect()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, name, clash, sf_dir)
        assert out.columns == clash.columns
        got = out.collect()
        assert 0 < len(got) <= len(before) and all(r == before[r.doc_id] for r in got)


def test_odd_documents(spark, sf_dir, odd_texts):
    rows = [(k if k != 5 else None, t, "en", "s", len(t or "")) for k, t in enumerate(odd_texts)]
    rows += [(8, odd_texts[8], "en", "s", 0), (8, "other text of a repeated id", "en", "s", 0), (None, "  a  b ", "en", "s", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, name, odd.limit(0), sf_dir).count() == 0
    left = stage(spark, "near_dedup", odd, sf_dir).collect()
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 7 in ids
    assert [r.text for r in left if r.doc_id == 8] == ["other text of a repeated id"]
    assert sum(r.doc_id is None for r in left) == 2
    assert {r.doc_id for r in stage(spark, "language", odd, sf_dir).collect()} >= {3, 4, 7}
    assert stage(spark, "toxicity", odd, sf_dir).count() == len(rows)


def test_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and len({n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()}) == 13
