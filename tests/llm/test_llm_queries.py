"""The opN_ queries against their SQL, and the pipeline against its parts."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import decontam, near_dedup
from terraloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted([tuple(map(str, (r[c] for c in names))) for r in df.collect()]) == sorted([tuple(map(str, r)) for r in result.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op10_decontam"}))
def test_one_row_a_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and got.count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, state, SF)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            kept = {r.doc_id for r in near_dedup.cluster(state, size=5).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "decontaminated":
            leaks = {r.doc_id for r in decontam.leaks(state, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert leaks and {r.doc_id for r in out.collect()} == {r.doc_id for r in state.collect()} - leaks
        state = out
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "lossless"]
    assert last.count() == state.count() and last.where("n_tokens <> size(ids) OR NOT lossless").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en' AND length(text) > 500").orderBy("doc_id").limit(20).collect()
    text = [r.text for r in good]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(text)] + [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, " \n", "en", None, 2), (103, text[0], None, None, None), (None, text[1], "en", "s", 1)]
    rows += [(0, text[0], "en", "s", len(text[0]))] * 2 + [(104, " ".join(text) * 10, "en", "s", None), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({c: F.lit(7) for c in ("n", "keys", "component", "component_id", "kept", "ids", "score", "spans", "loss", "item_id", "decoded", "count", "h", "batch")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        kept[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        assert name == "encoded" or out.columns == odd.columns
    every = sorted((r[0] for r in rows), key=str)
    assert kept["language"] == sorted([k for k in every if k not in (100, 101, 102, None)] + [None], key=str)
    assert kept["near_duplicates"] == sorted([*range(20), 100, 101, 102, 104, None, None], key=str)
    assert kept["without_personal_data"] == every and kept["encoded"] == every
    assert {100, 101, 102} <= set(kept["decontaminated"])
    hidden = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, odd, SF).collect()}
    assert hidden[100].text is None and hidden[101].text == "" and hidden[104].n_chars is None


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
