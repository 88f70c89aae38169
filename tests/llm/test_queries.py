"""The problems' queries over the smallest tables, against their SQL where they have one."""

import pytest

from tests.oracle import compare, tables
from wordloom.llm import registry

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.gather("QUERIES"), registry.gather("SQL")
COLUMNS = {"p1_found": ["youtube_id", "line_no"], "p2_found": ["record_id", "seg_idx", "stream_name"], "p3_found": ["channel_a", "channel_b"], "p5_found": ["youtube_id", "line_no", "pi_kind"], "p6_found": ["channel_id", "youtube_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.fixture(scope="module")
def con():
    return tables(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, D, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, D).columns == COLUMNS[name]
