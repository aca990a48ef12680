import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from proofline.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR)
    assert ok, note


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(docs.count())
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert kept[0] == n  # clean documents stay
    assert kept[1] == docs.sparkSession.read.parquet(f"{SF_DIR}/documents.parquet").select("text").distinct().count()
    assert kept[2] <= kept[1] and kept[3] == kept[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.select("doc_id").distinct().count() == kept[3]
    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().count() == kept[3]


def test_repeated_rows_keep_one_row_of_each_text(spark):
    base = [f"w{i}" for i in range(200)]
    long, like, other = " ".join(base), " ".join(base[:199] + ["x"]), " ".join(f"v{i}" for i in range(200))
    rows = [(5, long), (5, long), (6, other), (6, like), (6, like), (7, other), (None, "a b c"), (None, "a b c"), (8, None), (8, ""), (9, like + "!")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.exact(spark, docs, SF_DIR).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in once)) == sorted([(5, long), (6, other), (6, like), (0, "a b c"), (8, ""), (9, like + "!")])
    for given in (docs.filter("text <> ''"), corpus_pipeline.exact(spark, docs, SF_DIR).filter("text <> ''")):
        kept = corpus_pipeline.near(spark, given, SF_DIR).filter("doc_id is not null").collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, long), (6, other)])


def test_near_dedup_keeps_one_row_of_an_id_with_two_like_texts(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base[:199] + ["x"]), " ".join(base) + "!", " ".join(f"v{i}" for i in range(200))]
    docs = spark.createDataFrame([(5, t, "en", "s", 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.text for r in corpus_pipeline.near(spark, docs, SF_DIR).collect()]
    assert len(kept) == 2 and texts[3] in kept


def test_stages_on_messy_rows(spark, messy):
    docs, digests = messy, {r.text or "" for r in messy.select("text").collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out[name] = docs.collect()
    lettered = {t for t in digests if any(c.isalpha() for c in t)}
    texts = [r.text for r in out["exact_dedup"]]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in out["language_id"]} <= lettered
    assert {r.text for r in out["near_dedup"]} <= set(texts)
    assert len(out["pii"]) == len(out["near_dedup"]) and {r.doc_id for r in out["packing"]} == {r.doc_id for r in out["pii"]}
    messy_exact = corpus_pipeline.exact(spark, messy, SF_DIR).collect()
    assert sorted(r.text or "" for r in messy_exact) == sorted(digests)
