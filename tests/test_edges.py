"""Edge tables of operators, their composition, stored edges, bitmaps and ids by file."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowtrace.operators import attach, bitmaps, edges, graph, store, trace
from rowtrace.operators.attach import Branch
from rowtrace.operators.lineage import Lineage, Traced
from rowtrace.plans.micro import group_edges, store_of
from rowtrace.plans.overhead import FETCH, fetched, flat_plan, plan_op, plan_prefix, plan_total
from rowtrace.plans.registry import jobs
from rowtrace.plans.tpch import query
from rowtrace.session import Limits
from rowtrace.sources.tables import Tables

c = F.col


@pytest.mark.parametrize("name", ["q03", "q06", "q13", "q18", "q20", "q02", "q21"])
def test_composed_edges_are_the_captured_lineage(small, name):
    whole, composed = query(name, small).frame(indexed=True), query(name, small).composed()
    assert sorted(composed.columns) == sorted(whole.columns)
    assert rows(composed.select(*whole.columns)) == rows(whole)


def test_composed_lineage_comes_from_the_edges(small, monkeypatch):
    """Without an edge, what it leads to is missing."""
    before = query("q03", small).composed().collect()
    lost = before[0]["c_rid"]
    build = graph.Op.build

    def without(self):
        frame = build(self)
        return frame.filter(c("c_rid") != lost) if "c_rid" in frame.columns else frame

    monkeypatch.setattr(graph.Op, "build", without)
    after = query("q03", small).composed().collect()
    assert Counter(map(repr, after)) == Counter(repr(r) for r in before if r["c_rid"] != lost) and len(after) < len(before)


def test_operators_record_as_few_ids_as_name_a_row(small):
    found = [(op.kind, op.key) for op in query("q03", small).core.op.walk()]
    assert found[-1] == ("join", ("l_rid",)) and found[-2] == ("join", ("o_rid",))
    assert query("q13", small).core.op.key == ("c_rid", "o_rid")
    # the many-to-many join names both rows
    left = Traced.scan(small.customer).join(Traced.scan(small.supplier), [("c_nationkey", "s_nationkey")])
    assert left.op.key == ("c_rid", "s_rid")
    assert left.op.anchor(["c_custkey"]).key == ("c_rid",) and left.op.anchor(["s_suppkey"]) is left.op


def test_joins_of_hot_keys_expand_by_address(spark):
    left = spark.createDataFrame([(i, 1 if i < 30 else i) for i in range(40)] + [(99, None)], "a_rid long, k long")
    right = spark.createDataFrame([(i, 1 if i < 20 else i + 10) for i in range(30)] + [(99, None)], "b_rid long, j long")
    for how in ("inner", "left"):
        joined = Traced.scan(left).join(Traced.scan(right), [("k", "j")], how)
        pairs = joined.df.select("a_rid", "b_rid")
        for few in (False, True):
            grown = joined.op.expand(left.select("a_rid"), few)
            assert rows(grown.select("a_rid", "b_rid")) == rows(pairs)
        assert joined.op.edges().count() == 41 + 31


def test_grouped_many_to_many_composes(spark):
    left = spark.createDataFrame([(i, i % 3, "xy"[i % 2]) for i in range(20)], "a_rid long, k long, g string")
    right = spark.createDataFrame([(i, i % 4) for i in range(20)], "b_rid long, j long")
    core = Traced.scan(left).join(Traced.scan(right), [("k", "j")])
    lineage = Lineage(core=core, keys=("g",), aggregates={"n": F.count(F.lit(1))}, outputs=("g", "n"), order=(c("g"),))
    assert core.op.anchor(["g"]).key == ("a_rid",)
    assert rows(lineage.composed()) == rows(lineage.frame(indexed=True))


def test_address_edges_lead_back_to_the_pairs(spark):
    r = random.Random(3)
    left = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, 5, None]), r.choice("ab")) for i in range(60)], "lid long, k long, s string")
    right = spark.createDataFrame([(i, r.choice([1, 1, 2, 3, None]), r.choice("ab")) for i in range(40)], "rid long, k long, s string")
    addressed = edges.address_edges(left, right, [("k", "k"), ("s", "s")], "lid", "rid")
    want = left.alias("l").join(right.alias("r"), (c("l.k") == c("r.k")) & (c("l.s") == c("r.s"))).select("lid", "rid")
    got = edges.pairs_of(addressed).select(c("lhs_id").cast("long"), c("rhs_id").cast("long"))
    assert rows(got) == rows(want)
    assert addressed.count() <= 100
    assert edges.pair_counts(addressed).agg(F.sum("n_pairs")).first()[0] == want.count()
    assert edges.pairs_of(edges.address_edges(left.limit(0), right, [("k", "k")], "lid", "rid")).count() == 0


def test_full_composition_keeps_both_sides(spark):
    upper = spark.createDataFrame([(1, 10), (1, 11), (2, None), (3, 12)], "out_id long, in_id long")
    lower = spark.createDataFrame([(10, 100), (10, 101), (13, 102), (None, 103)], "out_id long, low long")
    got = rows(edges.full_compose(upper, lower).select("out_id", "low"))
    want = [(1, 100), (1, 101), (1, None), (2, None), (3, None), (None, 102), (None, 103)]
    assert got == sorted(want, key=repr)
    plan = edges.full_compose(upper, lower)._jdf.queryExecution().toString()
    assert "FullOuter" not in plan


def test_disjunctions_are_joined_branch_by_branch(spark):
    r = random.Random(4)
    left = spark.createDataFrame([(i, r.choice([1, 2, 3, None]), r.choice([5, 6, None])) for i in range(40)], "a long, x long, lo long")
    right = spark.createDataFrame([(i, r.choice([1, 2, 4, None]), r.choice([4, 6, 7, None])) for i in range(40)], "b long, y long, hi long")
    branches = [Branch(equal=(("x", "y"),)), Branch(low="lo", high="hi"), Branch(equal=(("a", "b"),))]
    want = left.join(right, (c("x") == c("y")) | (c("lo") < c("hi")) | (c("a") == c("b")), "cross").select("a", "b")
    for limits in (Limits(), Limits(broadcast_rows=1, broadcast_bytes=1)):
        got = attach.any_of(left, right, branches, limits)
        assert rows(got.select("a", "b")) == rows(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = attach.any_of(left, right, branches, Limits(broadcast_rows=1, broadcast_bytes=1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bitmaps_hold_the_ids(spark):
    r = random.Random(5)
    pairs = {(r.choice("abc"), r.choice([1, 2, 32768, 32769, 65536, 70000, r.randint(1, 200_000)])) for _ in range(300)}
    df = spark.createDataFrame(sorted(pairs), "g string, id long")
    maps = bitmaps.group_bitmaps(df, ["g"])
    assert rows(bitmaps.members(maps).select("g", "id")) == sorted(pairs, key=repr)
    want = Counter(g for g, _ in pairs)
    assert {x["g"]: x["cnt"] for x in bitmaps.sizes(maps, ["g"]).collect()} == want
    every = bitmaps.union(maps.withColumn("one", F.lit(1)), ["one"])
    assert {x["id"] for x in bitmaps.members(every).collect()} == {i for _, i in pairs}
    common = bitmaps.intersection(maps.withColumn("one", F.lit(1)), ["one"], 3)
    assert {x["id"] for x in bitmaps.members(common).collect()} == set.intersection(*[{i for g, i in pairs if g == k} for k in "abc"])
    assert bitmaps.members(bitmaps.group_bitmaps(df.limit(0), ["g"])).count() == 0


def test_sparse_sets_are_moved_as_words_not_as_pieces(spark):
    """Sets of single ids: what is shuffled is their words; the 4 KB pieces are made after the last exchange."""
    df = spark.range(1, 40_001).select((F.col("id") % 20_000).alias("g"), (F.col("id") * 17).alias("id"))
    maps = bitmaps.group_bitmaps(df, ["g"])
    assert max(x["n"] for x in maps.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()) <= 2
    assert "bits" in maps.columns and dict(maps.dtypes)["bits"] == "bigint"
    held = bitmaps.pieces(maps, ["g"])
    assert rows(held.select("g", "bucket", F.bitmap_count("bits").alias("n"), F.length("bits").alias("b"))) == rows(
        df.groupBy("g", F.bitmap_bucket_number("id").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select("g", "bucket", "n", F.lit(4096).alias("b"))
    )
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan[plan.rindex("Exchange") :] and "bitmap_construct_agg" in plan


def test_counts_of_a_lineage_table(spark):
    """Rows without a shuffle of ids; distinct ones and bytes by ids of either type."""
    held = [(1, "1-a", None), (1, "1-b", None), (2, "1-b", None), (None, None, None), (-30, "x", None)]
    table = spark.createDataFrame(held, "o_rid long, l_rid string, n_rid int")
    assert rows(trace.row_counts(table)) == [("l_rid", 4), ("n_rid", 0), ("o_rid", 4)]
    assert rows(trace.id_counts(table)) == [("l_rid", 4, 10, 3), ("o_rid", 4, 6, 3)]
    plan = trace.row_counts(table)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_outputs_are_written_down_once(medium):
    pinned = query("q03", medium).pinned()
    assert pinned.pinned() is pinned and pinned.base_rows == query("q03", medium).result().count()


def test_rows_are_numbered_in_slices_of_bounded_size(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.col("id").alias("v")).repartition(3)
    numbered = attach.ordinal(df, [F.col("k").desc()], limits=Limits(broadcast_rows=1, slice_rows=500))
    assert rows(numbered.select("out_index", "k")) == rows(spark.range(5_000).select("id", (4_999 - F.col("id")).alias("k")))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" not in plan  # no second shuffle of all rows, dealt by a hash of the slices
    assert numbered.select(F.spark_partition_id().alias("p")).distinct().count() >= 10


def test_stored_edges_are_opened_by_path_and_read_in_part(spark, medium):
    kept = store.EdgeStore.write(group_edges(medium), bucket_rows=3_000)
    again = store.EdgeStore.open(spark, kept.path)
    assert kept.buckets > 10 and again.buckets == kept.buckets and rows(again.edges()) == rows(group_edges(medium))
    few = medium.raw("part").select(c("p_partkey").alias("out_id")).orderBy("out_id").limit(2)
    want = group_edges(medium).join(few, "out_id", "left_semi")
    assert rows(again.lookup(few, 2).select("out_id", "in_id")) == rows(want)
    assert rows(again.lookup(few).select("out_id", "in_id")) == rows(want)
    whole = store.rows_read(again.edges().select("in_id"))
    part = store.rows_read(again.edges().filter(c("out_id").isin([r[0] for r in few.collect()])).select("in_id"))
    assert whole == group_edges(medium).count() and part < whole / 4


def test_stored_lookups_of_many_ids_do_not_move_the_store(spark, medium):
    kept = store.EdgeStore.write(group_edges(medium), bucket_rows=3_000)
    ids = spark.range(0, 5_000).select(c("id").alias("out_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = kept.lookup(ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_a_hot_output_is_stored_in_several_files(spark):
    hot = spark.range(0, 5_000).select(F.lit(0).cast("long").alias("out_id"), c("id").cast("string").alias("in_id"))
    kept = store.EdgeStore.write(hot, bucket_rows=1_000)
    assert len(kept.edges().inputFiles()) >= 3 and kept.edges().count() == 5_000
    assert kept.lookup(spark.createDataFrame([(0,)], "out_id long"), 1).count() == 5_000


def test_stores_are_written_once(medium):
    first = store_of(medium, "filter")
    assert store_of(medium, "filter") is first


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parted"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["rid_q03", "rid_q18", "edges_q13", "edges_q18", "edges_q20", "fetch_q18", "fetch_q20", "fetch_q21", "back_q09", "lookup_hashjoin"])
def test_ids_by_file_number_and_position(spark, small, parted, name):
    job = jobs()[name]
    by_key, by_file = job(small), job(Tables(spark, parted, rid="file"))
    data = [x for x in by_key.columns if not x.endswith("_rid")]
    assert rows(by_file.select(*data)) == rows(by_key.select(*data))


def test_ids_by_file_are_small_and_lead_to_the_rows(spark, small, parted):
    tables = Tables(spark, parted, rid="file")
    lines = tables.lineitem
    assert dict(lines.dtypes)["l_rid"] == "bigint" and lines.select("l_rid").distinct().count() == lines.count()
    found = tables.places("lineitem", lines.select("l_rid"), "l_rid")
    assert found.select("file_path").distinct().count() == 3 and found.count() == lines.count()
    sizes = {}
    for kind, t in (("keys", small), ("file", tables)):
        frame = query("q01", t).frame().select("l_rid")
        sizes[kind] = frame.select(F.length(F.to_json(F.struct("l_rid"))).alias("n")).agg(F.sum("n")).first()[0]
    assert sizes["file"] < sizes["keys"]


def test_ids_by_file_take_half_the_room_when_stored(spark, medium, tmp_path):
    """What `sink_ctas` writes for a join of three tables."""
    held = {}
    for kind in ("keys", "file"):
        t = Tables(spark, medium.folder, rid=kind)
        lines = Traced.scan(t.lineitem).select("l_orderkey").join(Traced.scan(t.orders), [("l_orderkey", "o_orderkey")])
        lines.df.select("l_rid", "o_rid").coalesce(1).write.parquet(f"{tmp_path}/{kind}")
        held[kind] = sum(f.stat().st_size for f in (tmp_path / kind).glob("*.parquet"))
    assert held["file"] <= held["keys"] / 2


def test_distinct_keeps_its_lineage(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "t_rid long, k string")
    lineage = Traced.scan(df).traced_distinct(["k"])
    assert rows(lineage.result()) == sorted([("a",), (None,)], key=repr)
    assert rows(lineage.frame().select("k", "t_rid")) == sorted([("a", 1), ("a", 2), (None, 3), (None, 4)], key=repr)
    assert rows(lineage.composed().select("out_index", "t_rid")) == [(0, 3), (0, 4), (1, 1), (1, 2)]


def test_a_wrong_id_is_noticed(small):
    lineage = query("q12", small).frame()
    wrong = lineage.orderBy("l_rid").limit(1).select("l_rid").first()[0]
    other = small.orders.join(lineage.select(c("o_rid").alias("x")), c("o_rid") == c("x"), "left_anti").orderBy("o_rid").first()["o_rid"]
    broken = lineage.withColumn("o_rid", F.when(c("l_rid") == wrong, F.lit(other)).otherwise(c("o_rid")))
    holds = F.expr(FETCH["q12"]["main"])
    for frame, lost in ((lineage, 0), (broken, 1)):
        found = fetched(small, frame, ["l_rid", "o_rid"])
        assert found.count() - found.filter(holds).count() == lost


def test_window_forms_run_windows(small):
    for name in ("q02", "q15"):
        plan = query(name, small).frame("window")._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan
        assert rows(query(name, small).frame("window")) == rows(query(name, small).frame("join"))
        small_groups = replace(query(name, small), limits=Limits(window_group_rows=0))
        assert rows(small_groups.frame("window")) == rows(query(name, small).frame("join"))


def test_plans_are_read_as_trees(spark):
    deep = "".join('{"timing": 0.5, "children": [' for _ in range(6)) + '{"name": "SEQ_SCAN", "timing": 2}' + "".join(f'], "name": "L\\"{k}"}}' for k in range(6))
    plans = spark.createDataFrame(
        [
            (1, '{"children": [{"children": [], "timing": 1.5, "name": "a b"}, {"name": "x", "children": [{"name": "WINDOW", "timing": 4}]}], "name": "ROOT"}', "Logical_window"),
            (2, deep, "Baseline"),
            (3, '{"SEQ_SCAN0": 1.0, "HASH_JOIN1": 2.5}', "Baseline"),
            (4, None, "Baseline"),
            (5, "{'name': 'ROOT', 'children': [{'name': 'HASH_JOIN', 'timing': 3, 'extra': {'children': [1]}}]}", "Baseline"),
        ],
        "r long, plan string, lineage_type string",
    )
    flat = flat_plan(c("plan"))
    got = {
        x["r"]: x
        for x in plans.select("r", flat.alias("m"), plan_total(flat).alias("t"), plan_op(flat, plan_prefix(F.lit("HASH_JOIN"), c("lineage_type"))).alias("o")).collect()
    }
    assert got[1]["m"] == {"a b0": 1.5, "WINDOW1": 4.0} and got[1]["o"] == 4.0
    assert got[2]["m"] == {f'L"{5 - k}{k}': 0.5 for k in range(6)} | {"SEQ_SCAN6": 2.0} and got[2]["t"] == 5.0
    assert got[3]["m"] == {"SEQ_SCAN0": 1.0, "HASH_JOIN1": 2.5} and got[3]["o"] == 2.5
    assert got[4]["m"] is None and got[5]["m"] == {"HASH_JOIN0": 3.0}
