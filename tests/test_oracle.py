"""Registered queries against their SQL in DuckDB, on the smallest data."""

import re

import pytest
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import connect, difference

JOBS, SQL = queries(), oracle_sql()
CHOSEN = sorted(
    n for n in JOBS
    if n.startswith(("q", "gen_", "edge_", "lookup_", "runs_", "plan_", "overhead_", "op_", "index_", "src_", "sink_"))
    or n in ("rid_q02", "rid_q13", "rid_q18", "rid_q21", "back_q11", "back_q18", "rid_mtm", "rid_theta_lt", "win_q01")
    or n.startswith(("flat_", "fetch_"))
    or n in ("edges_q03", "edges_q06", "edges_q13", "edges_q18", "edges_q20", "win_q02", "win_q15", "trace_by_key")
    or n in ("rid_mtm_skewed", "rid_mtm_chosen", "rid_group_bitmap", "rid_group_bitmap_rows", "rid_group_bitmap_union", "rid_theta_or")
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    # queries of the llm subpackage are named opN_..., and pipeline; their own tests compare them with brute force
    apart = re.compile(r"op\d+_.*|pipeline")
    assert {n for n in JOBS if not apart.fullmatch(n)} == {n for n in SQL if not apart.fullmatch(n)}


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, con, name):
    got = JOBS[name](spark, SMALL).toPandas()
    assert difference(got, con.execute(SQL[name]).fetchdf()) is None


def test_entry(spark):
    assert entry(spark).count() > 0
