"""Queries of the subpackage against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_warc", "op4_decontamination", "op5_chat_format", "op9_jaccard_join", "op10_mixing"])
def test_query_equals_sql(spark, name):
    from quire.llm.queries import QUERIES, SQL
    from tests.oracle import same

    same(QUERIES[name](spark, SF), SQL[name], SF)
