"""Each stage of the pipeline against brute force on its own input."""

import collections
from pathlib import Path

import duckdb
import pytest
from test_neardup import brute

import corpus_pipeline
from orderweave.llm import mixing, pieces, pii, quality


def in_duckdb(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(sql).fetchall()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    kept = {r[0] for r in in_duckdb(docs, f"select doc_id from ({quality.ORACLE}) where kept")}
    assert good.columns == columns and {r.doc_id: r.text for r in good.collect()} == {i: texts[i] for i in kept}

    ids = sorted(kept)
    root, _ = brute([texts[i] for i in ids], 5)
    single = corpus_pipeline.near_dedup(spark, good, sf).cache()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {ids[i] for i, r in enumerate(root) if i == r}

    clean = corpus_pipeline.personal_data(spark, single, sf).cache()
    assert clean.columns == columns
    for r in clean.collect():
        assert r.text == pii.redacted(texts[r.doc_id], pii.all_spans(texts[r.doc_id])[1]) and r.n_chars == len(r.text)

    mixed = corpus_pipeline.mixture(spark, clean, sf).cache()
    want = collections.Counter(r[0] for r in in_duckdb(clean, f"select doc_id from ({mixing.ORACLE})"))
    assert mixed.columns == columns and collections.Counter(r.doc_id for r in mixed.collect()) == want

    encoded = corpus_pipeline.encoding(spark, mixed, sf).cache()
    assert encoded.count() == mixed.count() and encoded.where("not round_trip").count() == 0
    back = pieces.decode(encoded, pieces.Vocabulary.of(), "doc_id").collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r.doc_id, r.text) for r in mixed.collect())


def test_awkward_rows_pass_all_stages(spark, awkward, tmp_path):
    (tmp_path / "in").mkdir()
    awkward.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    assert all(r.round_trip for r in corpus_pipeline.run(spark, str(tmp_path / "in")).collect())
    none = awkward.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(Path(tmp_path)))
        assert out.count() == 0


@pytest.mark.parametrize("name", ["mixture"])
def test_native_stage_has_no_python(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
