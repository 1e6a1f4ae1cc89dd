"""Properties of the 22 queries and their lineage."""

import math

import pytest
from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from rowtrace.operators.trace import by_key
from rowtrace.plans.params import BENCHMARK, DECORRELATED, GIVEN, TRACE_KEYS, WINDOWED
from rowtrace.plans.tpch import QUERIES, query
from rowtrace.session import release_caches
from rowtrace.sources.tables import Tables

ALL = list(QUERIES)
MONOTONE = ["q01", "q03", "q05", "q06", "q07", "q08", "q09", "q10", "q12", "q14", "q19"]
PREFIXES = {
    "r_rid": "region", "n_rid": "nation", "n1_rid": "nation", "n2_rid": "nation", "s_rid": "supplier",
    "c_rid": "customer", "p_rid": "part", "ps_rid": "partsupp", "o_rid": "orders", "l_rid": "lineitem",
}


@pytest.mark.parametrize("name", ALL)
def test_result_can_be_recovered_from_lineage(small, name):
    lineage = query(name, small)
    expected = rows(lineage.result())
    if not lineage.keys and lineage.grouped and expected == [(None,)]:
        expected = []  # nothing went into the aggregate, so nothing is traced
    assert rows(lineage.recover()) == expected


@pytest.mark.parametrize("name", ALL)
def test_edges_hold_the_same_ids_as_the_lineage(small, name):
    direct, indexed = query(name, small).frame(), query(name, small).frame(indexed=True)
    rids = [x for x in direct.columns if x.endswith("_rid")]
    assert rows(direct.select(rids)) == rows(indexed.select(rids))
    top = indexed.agg(F.max("out_index"), F.count_distinct("out_index")).first()
    assert top[0] is None or top[0] + 1 == top[1]


@pytest.mark.parametrize("name", WINDOWED)
def test_window_form_equals_join_form(small, name):
    assert rows(query(name, small).frame("window")) == rows(query(name, small).frame("join"))


@pytest.mark.parametrize("name", DECORRELATED)
def test_counted_lineage_equals_its_joined_form(small, name):
    lineage = query(name, small)
    keys = list(lineage.outputs)
    flat = lineage.flat(keys, lineage.result().select(*keys))
    counted = lineage.backward(()).first()["n"] or 0
    assert flat.count() == counted


class Restricted(Tables):
    """Tables cut down to given ids."""

    def __init__(self, spark, folder, ids):
        super().__init__(spark, folder)
        self.ids = ids

    def _cut(self, frame, name, rid):
        return frame.join(self.ids[name], F.col(rid) == F.col("_id"), "left_semi") if name in self.ids else frame

    def with_rid(self, name, rid, keys, **derived):
        return self._cut(super().with_rid(name, rid, keys, **derived), name, rid)

    @property
    def partsupp(self):
        return self._cut(super().partsupp, "partsupp", "ps_rid")


@pytest.mark.parametrize("name", MONOTONE)
def test_traced_rows_alone_produce_the_output_again(spark, medium, name):
    lineage = query(name, medium)
    keys = TRACE_KEYS[name]
    traced = lineage.frame()
    wanted = lineage.wanted(1, keys) if keys else lineage.result()
    if keys:
        traced = by_key(traced, wanted, keys, bound=1)
    ids = {}
    for rid in [x for x in traced.columns if x in PREFIXES]:
        part = traced.select(F.col(rid).alias("_id"))
        table = PREFIXES[rid]
        ids[table] = part.union(ids[table]) if table in ids else part
    expected = rows(wanted)
    ids = {table: spark.createDataFrame(frame.distinct().collect(), frame.schema) for table, frame in ids.items()}
    release_caches()
    again = query(name, Restricted(spark, MEDIUM, ids)).result()
    assert expected[0] in rows(again)


def test_equal_minimum_cost_of_another_part_does_not_leak(spark, tmp_path):
    """Two parts whose cheapest offers cost the same: each only depends on its own offers."""
    folder = str(tmp_path)
    tables = {
        "region": ([(3, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(3, "NATION_3", 3)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": (
            [(1, "S1", 3, 10.0), (2, "S2", 3, 20.0)],
            "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
        ),
        "part": (
            [(k, "p", "B", "SHINY", 15, 1.0) for k in (7, 8)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
    }
    lines = [(1, 7, 1, 1, 5.0), (2, 7, 2, 1, 9.0), (3, 8, 1, 1, 5.0), (4, 8, 2, 1, 6.0)]
    lines = [(o, p, s, n, 1.0, cost, 0.0, 0.0, "R", "F") for o, p, s, n, cost in lines]
    schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    )
    tables["lineitem"] = (lines, schema)
    for name, (data, columns) in tables.items():
        spark.createDataFrame(data, columns).write.parquet(f"{folder}/{name}.parquet")
    params = {"size": 15, "type": "%Y", "region": "EUROPE"}
    lineage = query("q02", Tables(spark, folder), params)
    flat = lineage.flat(["p_partkey"], lineage.result().select("p_partkey").distinct())
    assert rows(flat.select("p_partkey", "ps_rid", "sub_ps_rid")) == [
        (7, "7-1", "7-1"), (7, "7-1", "7-2"), (8, "8-1", "8-1"), (8, "8-1", "8-2"),
    ]


def test_file_positions_serve_as_ids_too(spark):
    tables = Tables(spark, MEDIUM, rid="file")
    ids = tables.lineitem.select("l_rid")
    assert ids.distinct().count() == ids.count() == tables.raw("lineitem").count()
    by_file, by_key_ = query("q12", tables).frame(), query("q12", Tables(spark, MEDIUM)).frame()
    assert by_file.count() == by_key_.count()
    outputs = ["l_shipmode", "high_line_count", "low_line_count"]
    assert rows(by_file.select(outputs)) == rows(by_key_.select(outputs))


def test_unknown_modes_are_rejected(spark, small):
    with pytest.raises(ValueError):
        Tables(spark, MEDIUM, rid="none")
    with pytest.raises(ValueError):
        query("q01", small).main("guess")


@pytest.mark.parametrize("name", ALL)
def test_benchmark_literals_run(small, name):
    assert set(BENCHMARK[name]) == set(GIVEN[name])
    query(name, small, BENCHMARK[name], reuse=False).result().collect()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_result_reads_no_id_columns_and_pushes_filters(spark, small):
    text = plan(query("q06", small, reuse=False).result())
    assert "concat_ws" not in text and "l_linenumber" not in text
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in pushed or "IsNotNull(l_shipdate)" in pushed
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate" in text
    top = plan(query("q03", small, reuse=False).result())
    assert "TakeOrderedAndProject" in top and "l_linenumber" not in top


def test_lineage_of_few_groups_does_not_shuffle_the_rows(small):
    text = plan(query("q01", small).frame())
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_single_row_aggregates_are_attached_as_scalars(small):
    text = plan(query("q06", small).frame())
    assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_result_totals_are_exact(medium):
    """Sums in hundredths equal sums of decimals."""
    exact = medium.raw("lineitem").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double")
    ).first()[0]
    everything = query("q01", medium, {"until": "2100-01-01"}, reuse=False).result()
    assert math.isclose(everything.agg(F.sum("sum_base_price")).first()[0], exact, rel_tol=1e-15)
