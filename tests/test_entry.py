"""The driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from slidegrid.plans import workflows
from slidegrid.queries import REGISTRY
from slidegrid.queries.cohort_queries import samples
from check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SAMPLE = ["label_resolution", "slide_assembly", "patient_folds", "roc_corners", "cell_coverage", "seeded_cap", "slide_probabilities"]


def test_contract_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(REGISTRY)
    assert len(entry.entry(spark).collect()) == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = REGISTRY[name].run(spark, SF)
    result = con.execute(REGISTRY[name].sql)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([c[0] for c in result.description], result.fetchall())


def test_cohort_flow(spark):
    s = samples(spark, SF).withColumnsRenamed({"sample": "sample"}).selectExpr("*", "sample AS folder", "1 AS cna")
    report = workflows.cohort_report(s)
    assert report["prevalence"].first()["n"] == s.count() and report["cna"].count() == 1
