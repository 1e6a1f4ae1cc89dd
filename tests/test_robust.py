"""Data that earlier versions refused, dropped, overwrote or left in one task."""

import datetime

import duckdb
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from rowtrace.operators import generators as G
from rowtrace.operators.attach import left_join
from rowtrace.operators.lineage import Traced
from rowtrace.plans.overhead import flat_plan
from rowtrace.plans.params import GIVEN
from rowtrace.plans.registry import jobs
from rowtrace.plans.tpch import query
from rowtrace.sources.tables import Tables

c = F.col


def test_steps_permute_any_count():
    for n in (1, 7, G.STEP, 2 * G.STEP, 1000):
        step = G.step_for(n)
        assert len({(i * step + G.OFFSET) % n for i in range(min(n, 5000))}) == min(n, 5000)


def test_exact_selectivity_at_a_multiple_of_the_step(spark):
    n = G.STEP
    ids = spark.range(n).select(c("id").alias("idx"))
    assert G.selective(ids, n, 0.25).filter("z = 0").count() == int(n * 0.25)


def test_zipf_over_many_groups(spark):
    groups = 200_000
    ids = spark.range(5000).select(c("id").alias("idx"))
    assert G.zipf_groups(ids, groups, 1.0).count() == 5000
    ranges = G.zipf_ranges(ids, groups, 1.0)
    after = ranges.select((c("z") - 1).alias("z"), c("low").alias("next"))
    gaps = ranges.join(after, "z").filter("high <> next").count()
    ends = ranges.agg(F.min("low"), F.max("high"), F.count("*")).first()
    assert gaps == 0 and tuple(ends) == (0.0, 1.0, groups)


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


@pytest.mark.parametrize("form", ["exists", "not_exists", "not_in", "left_join"])
def test_a_hot_outer_key_is_split(spark, form):
    before = {name: spark.conf.get(name, None) for name in HOT}
    for name, value in HOT.items():
        spark.conf.set(name, value)
    try:
        ids = spark.range(300_000).repartition(16)
        outer = ids.select(F.md5(c("id").cast("string")).alias("f_rid"), F.when(c("id") % 3 == 0, 0).otherwise(c("id")).alias("k"))
        low = ids.filter("id < 150000").select(c("id").alias("i_rid"), c("id").alias("j"))
        high = ids.filter("id >= 150000").select(c("id").alias("i_rid"), c("id").alias("j"))
        left, n = Traced(outer, ("f_rid",)), 100_000 + 100_000
        got = {
            "exists": lambda: left.exists(Traced(low, ("i_rid",)), [("k", "j")]).df,
            "not_exists": lambda: left.not_exists(high, [("k", "j")]).df,
            "not_in": lambda: left.not_in("k", Traced(high, ("i_rid",)), "j").df,
            "left_join": lambda: left_join(outer, low, [("k", "j")]),
        }[form]()
        counted = got.groupBy().agg(F.count("*").alias("n"), F.max("f_rid"))
        assert counted.collect()[0]["n"] == (300_000 if form == "left_join" else n)
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["win_q01", "win_q09", "rid_group_window"])
def test_window_forms_run_windows(spark, small, name):
    plan = jobs()[name](small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The small tables with stored values for columns that are otherwise derived, and a stored partsupp."""
    folder = tmp_path_factory.mktemp("stored")
    t = Tables(spark, SMALL)
    late = F.date_add("l_shipdate", 90)
    lines = t.lineitem.drop("l_rid").withColumns({"l_receiptdate": late, "l_commitdate": F.date_add("l_shipdate", 3), "l_shipmode": F.lit("MAIL")})
    lines = lines.withColumn("l_quantity", c("l_quantity").cast("decimal(15,2)"))
    stock = t.part.select(c("p_partkey").alias("ps_partkey"), F.lit(1).alias("ps_suppkey"), F.lit(7).alias("ps_availqty"), F.lit("2.50").cast("decimal(15,2)").alias("ps_supplycost"))
    for name, frame in {"lineitem": lines, "partsupp": stock}.items():
        frame.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    for name in ("region", "nation", "supplier", "customer", "part", "orders"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_stored_columns_are_kept(stored):
    line = stored.lineitem.select("l_shipmode", "l_quantity", (c("l_receiptdate").cast("date") - c("l_shipdate")).alias("d"))
    assert {tuple(r)[0] for r in line.distinct().collect()} == {"MAIL"}
    assert dict(stored.lineitem.dtypes)["l_quantity"] == "double"
    assert rows(stored.partsupp.select("ps_suppkey", "ps_availqty", "ps_supplycost").distinct()) == [(1, 7, 2.5)]
    assert "ps_rid" in stored.partsupp.columns


def test_late_receipts_stay_in_q12(stored):
    got = {r["l_shipmode"]: r["high_line_count"] + r["low_line_count"] for r in query("q12", stored).result().collect()}
    start, end = (datetime.date.fromisoformat(str(GIVEN["q12"][k])) for k in ("start", "end"))
    con = duckdb.connect()
    want = con.execute(
        f"select count(*) from '{stored.folder}/lineitem.parquet/*.parquet' where l_commitdate < l_receiptdate "
        f"and l_shipdate < l_commitdate and l_receiptdate >= date '{start}' and l_receiptdate < date '{end}'"
    ).fetchone()[0]
    assert sum(got.values()) == want > 0


def test_plans_are_read_in_both_forms(spark):
    nested = '{"name": "ROOT", "children": [{"name": "HASH JOIN 2", "timing": 1.5e-1, "children": [{"name": "SEQ_SCAN", "timing": 2, "children": []}]}]}'
    flat = "{'HASH_JOIN0': 0.25, 'SEQ_SCAN1': 1e-3}"
    plans = spark.createDataFrame([(1, nested), (2, flat), (3, "{}")], "r int, plan string")
    got = {r["r"]: r["m"] for r in plans.select("r", flat_plan(c("plan")).alias("m")).collect()}
    assert got == {1: {"HASH JOIN 20": 0.15, "SEQ_SCAN1": 2.0}, 2: {"HASH_JOIN0": 0.25, "SEQ_SCAN1": 0.001}, 3: {}}
