"""The pipeline's stages against brute force on the smallest tables, and its plans."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from classtilt.llm import quality_rules, surrogates
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import DOCS, ODD, normal
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == documents.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    good = {r.doc_id for r in quality_rules.quality_rules(documents).filter("kept").collect()}
    assert {r.doc_id for r in kept[0]} == good
    least = {}
    for r in kept[0]:
        least[normal(r.text)] = min(least.get(normal(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept[1]) == sorted(least.values())
    assert {r.doc_id for r in kept[2]} == brute_kept([(r.doc_id, r.text) for r in kept[1]])
    old = {r.doc_id: r.text for r in kept[2]}
    assert {r.doc_id for r in kept[3]} == set(old)
    for r in kept[3]:
        private = {e for _, _, _, e in surrogates.entities(old[r.doc_id])}
        assert not private & {e for _, _, _, e in surrogates.entities(r.text)}
        assert (r.text == old[r.doc_id]) == (not private)
    assert {r.doc_id for r in kept[4]} == set(old)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_url_filters", "op6_chat_format", "op11_fill_in_middle", "op12_phrases"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    mine, columns = rows_of(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    theirs, other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == other and mine == theirs


def test_registered():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_url_filters"])
def test_native_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_digest_is_of_the_normal_text():
    assert hashlib.sha256(normal(" a\n\tb").encode()).hexdigest() == hashlib.sha256(b" a b").hexdigest()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeats, names that stages use inside; and an empty table."""

    clash = {c: F.lit("x") for c in ("_key_", "_stays_", "_c0", "n_words", "n_entities", "kept")}
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 1), (None, None, None, None, None)]
    clean = " ".join(f"word{i}" for i in range(40))
    rows += [(100, clean, "en", "s", 1), (100, clean, "en", "s", 1), (101, clean.replace(" ", "  "), "en", "s", 1)]
    for name, docs in (("odd", spark.createDataFrame(rows, DOCS)), ("none", spark.createDataFrame([], DOCS))):
        docs, kept = docs.withColumns(clash), []
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert stage_name == "packing" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}/{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage_name}")
            kept.append(docs.collect())
        assert (name == "none") == (not kept[-1])
        assert [r.doc_id for r in kept[3] if r.text == clean] == ([] if name == "none" else [100])
