"""Questions that count lineage rows make no ids; one output's question restricts the scans."""

import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowtrace import session
from rowtrace.operators import attach
from rowtrace.operators.lineage import Lineage, Traced
from rowtrace.operators.trace import sizes
from rowtrace.plans import overhead
from rowtrace.plans.params import TRACE_KEYS
from rowtrace.plans.tpch import query
from rowtrace.session import release_caches


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def seen_by(monkeypatch, tables, ask):
    seen = []
    monkeypatch.setattr(overhead, "QUERIES", dict.fromkeys(["q01", "q03", "q18"]))
    monkeypatch.setattr(overhead, "query", lambda *a, **k: seen.append(query(*a, **k)) or seen[-1])
    ask(tables).collect()
    return seen


@pytest.mark.parametrize("ask", [overhead.trace_sample, overhead.trace_all, overhead.fanout])
def test_counts_make_no_ids(small, monkeypatch, ask):
    seen = seen_by(monkeypatch, small, ask)
    assert len(seen) == 3 and not any("concat_ws" in plan(lineage.core.df) for lineage in seen)


@pytest.mark.parametrize("name", ["q01", "q02", "q11", "q13", "q15", "q18", "q20", "q21", "q22"])
def test_counts_do_not_depend_on_ids(small, name):
    by = TRACE_KEYS[name]
    expected = [rows(sizes(query(name, small), by, n)) for n in (10, None)]
    release_caches()
    assert [rows(sizes(query(name, small.unnamed()), by, n)) for n in (10, None)] == expected


def test_unnamed_tables_share_what_was_derived(small):
    unnamed = small.unnamed()
    small.partsupp, unnamed.partsupp
    assert unnamed._raw is small._raw and small.rid == "keys"
    assert unnamed.orders.filter("o_rid is not null").isEmpty()


@pytest.mark.parametrize(("name", "on"), [("q02", "ps_suppkey"), ("q05", "l_suppkey"), ("q07", "l_suppkey"), ("q11", "ps_suppkey"), ("q21", "l_suppkey")])
def test_few_sellers_are_sent_to_the_lines(spark, small, name, on):
    """Measured as small, however large the estimate is: the lines are not shuffled by supplier."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = query(name, small, reuse=False).core.df._jdf.queryExecution().sparkPlan().toString()
        assert any("BroadcastHashJoin" in line and f"[{on}#" in line for line in physical.splitlines())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_output_restricts_the_scan(small):
    lineage = query("q03", small, reuse=False)
    by = TRACE_KEYS["q03"]
    asked = lineage.traced(by, lineage.wanted(1, by), bound=1)
    scans = re.findall(r"Filter .*\((?:l|o)_orderkey#\d+L = \d+\)", plan(asked))
    assert any("l_orderkey" in x for x in scans) and any("o_orderkey" in x for x in scans)


@pytest.mark.parametrize("keys", [[None, "a"], ["a", "b"], []])
def test_first_output_may_be_null_or_missing(spark, keys):
    facts = [(10 * i + j, k) for i, k in enumerate(keys) for j in range(3 + i)]
    core = Traced(spark.createDataFrame(facts, "f_rid long, g string"), ("f_rid",))
    lineage = Lineage(core=core, keys=("g",), aggregates={"n": F.count(F.lit(1))}, outputs=("g", "n"), order=(F.col("g"),))
    expected = [("f_rid", 3, "2")] if keys else [("f_rid", 0, None)]
    assert rows(lineage.traced(["g"], lineage.wanted(1, ["g"]), bound=1)) == expected


def test_answered_takes_outputs_that_hold_ids_from_itself(small):
    own, other = query("q15", small), query("q15", small.unnamed()).pinned()
    assert rows(own.answered(other).main().select("s_rid").distinct()) == rows(query("q15", small).main().select("s_rid").distinct())
    release_caches()
    found = query("q12", small.unnamed()).pinned()
    answered = query("q12", small, reuse=False).answered(found)
    assert answered.base is found.base and answered.main().filter("l_rid is null or o_rid is null").isEmpty()


def held(spark):
    """How many relations are kept, and how many files of shuffles there are."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return spark.sparkContext._jsc.getPersistentRDDs().size(), files.count("/shuffle_")


@pytest.mark.parametrize("ask", [overhead.lineage_stats, overhead.avg_lineage_size, overhead.trace_by_key])
def test_queries_are_answered_one_by_one(spark, small, monkeypatch, ask):
    """Nothing that one query kept or shuffled is left when the next begins, or at the end."""
    names, found = ["q18", "q03", "q21"], []
    small.partsupp

    def begun(name, *a, **k):
        if name not in [x for x, _ in found]:
            freed()
            found.append((name, held(spark)))
        return query(name, *a, **k)

    def freed():
        until = time.time() + 5
        while (held(spark)[0] or held(spark)[1] > before) and time.time() < until:
            spark._jvm.System.gc()
            time.sleep(0.2)

    release_caches()
    with session.passing(spark):
        pass
    time.sleep(1)
    before = held(spark)[1]
    monkeypatch.setattr(overhead, "QUERIES", dict.fromkeys(names))
    monkeypatch.setattr(overhead, "query", begun)
    result = ask(small)
    freed()
    found.append(("end", held(spark)))
    assert [x for x, _ in found] == [*names, "end"]
    assert all(kept == 0 and shuffles <= before for _, (kept, shuffles) in found)
    assert result.count() > 0


def test_passing_leaves_what_was_kept_before(spark):
    outer = session.keep(spark.range(3))
    with session.passing(spark):
        inner = session.keep(spark.range(4))
        assert inner.is_cached
    assert outer.is_cached and not inner.is_cached


def test_filtered_joins_ask_bloom_filters_inside_only(spark, small, monkeypatch):
    """Lines are asked for the keys of the filtered orders before they are shuffled; the rows are the same."""
    monkeypatch.setitem(session.PRUNED, "applicationSideScanSizeThreshold", "0")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    usual = spark.conf.get(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = query("q03", small, reuse=False).core.df
        assert "might_contain" not in plan(plain)
        expected = rows(plain)
        with session.pruned(spark):
            asked = query("q03", small, reuse=False).core.df
            assert "might_contain" in plan(asked)
            assert rows(asked) == expected
        assert spark.conf.get(name) == usual
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("bound", "broadcast"), [(3, True), (2, False)])
def test_rare_keys_are_broadcast_if_they_are_few(spark, monkeypatch, bound, broadcast):
    left = spark.createDataFrame([(k % 5 or None, k) for k in range(20)], "a long, v long")
    right = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, None)], "b long")
    expected = rows(left.filter("a in (1, 2, 3)"))
    limits = session.Limits(broadcast_rows=bound)
    monkeypatch.setattr(attach.few, "__defaults__", (limits,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach.known_keys_join(left, right, [("a", "b")], "left_semi", rare=True)
        assert ("BroadcastHashJoin" in plan(joined)) == broadcast
        assert rows(joined) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
