"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import os
import re

import pytest

from quire.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from quire.session import table

    plan = table(spark, SF, "documents").where("doc_id > 5").select("lang")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_rest_works_without_llm(monkeypatch):
    """The entry module imports without the training-data operators."""
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "word_coverage_top3" in entry.queries() and "pipeline" not in entry.queries()
    sys.modules.pop("__spark_entry__", None)


@pytest.mark.parametrize("name", ["word_coverage_top3", "reverse_coverage"])
def test_pairs_are_counted_in_slices_that_follow_the_input(spark, monkeypatch, name):
    """A task's pairs of passage and document are bounded: slices of documents, from which pairs aren't dealt out again."""
    from quire.plans import text_queries

    n = spark.read.parquet(f"{SF}/benchmark.parquet").count() * spark.read.parquet(f"{SF}/documents.parquet").count()
    monkeypatch.setattr(text_queries, "SLICE_PAIRS", -(-n // 23), raising=False)
    out = catalogue.QUERIES[name](spark, SF)
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(doc_id, 23)" in plan and "hashpartitioning(item_id, doc_id" not in plan
    same(out, catalogue.SQL[name], SF)
