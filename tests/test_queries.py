"""Registered queries against their SQL at the smallest scale, and plan properties that matter at a large one."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["macro_f1_by_fold", "aud_profile", "aud_eligibility", "prep_impute_median", "rs_knn_in_class", "rs_smote", "met_bundle", "thr_fit", "acc_failure_summary", "st_rankings", "st_posterior", "txt_redact"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    mine, columns = rows_of(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    theirs, other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == other and mine == theirs


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["st_cell_means"](spark, SF))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("l_shipdate" not in s for s in schemas)


@pytest.mark.parametrize("name", ["rs_knn_in_class", "rs_knn_all_rows", "rs_tomek", "st_friedman_permutation", "prep_split_check", "aud_scope_summary", "met_bundle", "acc_expected", "st_coverage_grid", "st_posterior", "thr_fit"])
def test_no_cartesian_plans(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_copies_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(entry.queries()["rs_knn_all_rows"](spark, SF))
