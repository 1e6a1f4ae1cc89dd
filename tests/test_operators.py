"""Each lineage operator against brute force on small fixtures."""

from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rowtrace.functions.exact import ExactSum
from rowtrace.operators import edges as E
from rowtrace.operators.attach import attach, inequality_join, left_join, ordinal, over_groups
from rowtrace.operators.lineage import Lineage, Traced
from rowtrace.operators.trace import by_key, originals
from rowtrace.session import Limits

TINY = Limits(broadcast_rows=0, broadcast_bytes=0, window_group_rows=3, list_rows=4)
WINDOWS = Limits(broadcast_rows=0, broadcast_bytes=0)
c = F.col

# one group holds most rows, one key is null
FACTS = [(i, "hot" if i % 3 else ("null" if i % 2 else "cold"), i % 7) for i in range(60)]
FACTS = [(i, None if g == "null" else g, v) for i, g, v in FACTS]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, "f_rid long, g string, v long")


def grouped():
    groups = defaultdict(list)
    for rid, g, v in FACTS:
        groups[g].append((rid, v))
    return groups


def expected_sums():
    return sorted(
        ((g, sum(v for _, v in members), rid) for g, members in grouped().items() for rid, _ in members), key=repr
    )


@pytest.mark.parametrize("limits", [Limits(), TINY, WINDOWS])
def test_group_values_reach_every_row_also_with_null_keys(facts, limits):
    sums = facts.groupBy("g").agg(F.sum("v").alias("s"))
    joined = attach(facts.select("f_rid", "g"), sums, ["g"], limits)
    assert rows(joined.select("g", "s", "f_rid")) == expected_sums()
    spread = over_groups(facts.select("f_rid", "g", "v"), ["g"], {"s": F.sum("v")}, limits)
    assert rows(spread.select("g", "s", "f_rid")) == expected_sums()


def test_exact_sum_over_windows_and_groups(facts):
    big = facts.select("f_rid", "g", (c("v") * 10**12 - 3 * 10**12).alias("x"))
    expected = {g: sum(v * 10**12 - 3 * 10**12 for _, v in m) for g, m in grouped().items()}
    for limits in (Limits(), WINDOWS):
        got = over_groups(big, ["g"], {"s": ExactSum(c("x"))}, limits)
        assert {(r["g"], int(r["s"])) for r in got.collect()} == set(expected.items())


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_positions_follow_the_total_order(facts, limits):
    got = ordinal(facts, [c("v").desc(), c("f_rid")], limits=limits)
    expected = sorted(FACTS, key=lambda f: (-f[2], f[0]))
    assert [(r["out_index"], r["f_rid"]) for r in sorted(got.collect())] == [(i, f[0]) for i, f in enumerate(expected)]


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("or_equal", [False, True])
def test_inequality_join_equals_all_pairs(spark, limits, or_equal):
    left = [(i, (i * 7) % 40) for i in range(50)]
    right = [(i, 20 if i < 30 else (i * 11) % 45) for i in range(70)]  # one hot value
    a = spark.createDataFrame(left, "l_rid long, x long")
    b = spark.createDataFrame(right, "r_rid long, y long")
    got = inequality_join(a, b, "x", "y", or_equal, limits, buckets=6, cell_rows=9)
    expected = sorted((i, x, j, y) for i, x in left for j, y in right if x < y or (or_equal and x == y))
    assert rows(got) == sorted(expected, key=repr)


def test_left_join_keeps_unmatched_rows(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "a_rid long, k long")
    b = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "b_rid long, j long")
    got = left_join(a, b, [("k", "j")]).select("a_rid", "b_rid")
    assert rows(got) == sorted([(1, 10), (1, 11), (2, None), (3, None)], key=repr)


def test_segments_hold_every_id_once_and_split_hot_groups(facts):
    for as_text in (False, True):
        packed = E.segments(facts, ["g"], "f_rid", TINY, as_text).collect()
        found = defaultdict(list)
        for r in packed:
            found[r["g"]] += [int(x) for x in (r["rids"].split(",") if as_text else r["rids"])]
            assert r["cnt"] == len(grouped()[r["g"]])
        assert {g: sorted(x) for g, x in found.items()} == {g: sorted(i for i, _ in m) for g, m in grouped().items()}
        assert max(Counter(r["g"] for r in packed).values()) > 1


def traced(spark, data, schema):
    return Traced.scan(spark.createDataFrame(data, schema))


def test_exists_depends_on_each_match_and_not_exists_on_nothing(spark):
    outer = traced(spark, [(1, 1), (2, 2), (3, 3)], "a_rid long, k long")
    inner = traced(spark, [(10, 1), (11, 1), (12, 2)], "b_rid long, j long")
    there = outer.exists(inner, [("k", "j")])
    lineage = Lineage(core=there, outputs=("k",), order=(c("k"),))
    assert rows(lineage.result()) == [(1,), (2,)]
    flat = lineage.flat(["k"], lineage.result())
    assert rows(flat.select("a_rid", "b_rid")) == [(1, 10), (1, 11), (2, 12)]
    absent = outer.not_exists(inner.df, [("k", "j")])
    assert absent.rids == ("a_rid",) and not absent.subs
    assert rows(absent.df) == [(3, 3)]


@pytest.mark.parametrize("inner_values, kept", [([1], [2]), ([1, None], []), ([], [1, 2, None])])
def test_not_in_follows_three_valued_logic(spark, inner_values, kept):
    outer = traced(spark, [(1, 1), (2, 2), (3, None)], "a_rid long, k long")
    inner = traced(spark, [(i, v) for i, v in enumerate(inner_values)], "b_rid long, j long")
    whole = outer.not_in("k", inner, "j")
    assert [r["k"] for r in whole.df.orderBy("a_rid").collect()] == kept
    assert whole.subs[0].frame.count() == len(inner_values)
    assert not outer.not_in("k", inner, "j", capture="none").subs


def test_joins_unions_and_distinct_keep_ids(spark):
    a = traced(spark, [(1, 1), (2, 2)], "a_rid long, k long")
    b = traced(spark, [(10, 1), (11, 1)], "b_rid long, j long")
    joined = a.join(b, [("k", "j")])
    assert joined.rids == ("a_rid", "b_rid")
    assert rows(joined.select("k").df) == [(1, 1, 10), (1, 1, 11)]
    theta = a.join(b, c("k") >= c("j"))
    assert theta.df.count() == 4
    assert a.product(b).df.count() == 4
    outer = a.join(b, [("k", "j")], "left")
    assert rows(outer.df.select("a_rid", "b_rid")) == sorted([(1, 10), (1, 11), (2, None)], key=repr)
    union = a.union(b.select(c("j").alias("k")))
    assert rows(union.df.select("k", "a_rid", "b_rid")) == sorted(
        [(1, 1, None), (2, 2, None), (1, None, 10), (1, None, 11)], key=repr
    )
    assert rows(union.distinct(["k"])) == [(1,), (2,)]


def test_composed_edges_equal_the_direct_ones(spark):
    orders = [(i, i % 4) for i in range(12)]
    lines = [(100 + i, i % 9) for i in range(40)]
    upper = spark.createDataFrame([(k, o) for o, k in orders], "out_id long, in_id long")
    lower = spark.createDataFrame([(o, r) for r, o in lines], "out_id long, in_id long")
    assert rows(E.compose(upper, lower)) == sorted((k, r) for o, k in orders for r, p in lines if p == o)
    kept = rows(E.compose(upper, lower, how="left"))
    missing = [(k, None) for o, k in orders if o > 8]
    assert kept == sorted([(k, r) for o, k in orders for r, p in lines if p == o] + missing, key=repr)


def test_trace_by_key_matches_nulls(facts, spark):
    wanted = spark.createDataFrame([(None,), ("cold",)], "g string")
    expected = [f for f in FACTS if f[1] in (None, "cold")]
    assert rows(by_key(facts, wanted, ["g"])) == sorted(expected, key=repr)
    assert rows(by_key(facts, wanted, ["g"], bound=2)) == sorted(expected, key=repr)


def test_originals_fetches_base_columns(facts, spark):
    base = spark.createDataFrame([(r, v * 10) for r, _, v in FACTS], "id long, ten long")
    got = originals(facts.select("f_rid", "v"), [("f_rid", base, ["ten"])])
    assert got.filter("ten = v * 10").count() == len(FACTS)


def test_lineage_of_linked_subqueries_multiplies_only_on_request(spark):
    """Two outputs share a group of sub rows: stored once, counted as a product."""
    main = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 6)], "m_rid long, o string, link long")
    sub = spark.createDataFrame([(10, 5), (11, 5), (12, 6), (13, 7)], "s_rid long, link long")
    core = Traced(main, ("m_rid",)).depends_on(Traced(sub, ("s_rid",)), ["link"])
    lineage = Lineage(
        core=core, outputs=("o", "n"), keys=("o",), aggregates={"n": F.count(F.lit(1))}, order=(c("o"),)
    )
    stored = lineage.frame()
    assert stored.count() == 3 + 3
    counted = {r["o"]: (r["n"], r["m_rid"], r["s_rid"]) for r in lineage.backward(["o"]).collect()}
    assert counted == {"a": (4, 2, 11), "b": (1, 3, 12)}
    flat = lineage.flat(["o"], lineage.result().select("o"), bound=2)
    assert rows(flat.select("o", "m_rid", "s_rid")) == sorted(
        [("a", 1, 10), ("a", 1, 11), ("a", 2, 10), ("a", 2, 11), ("b", 3, 12)]
    )


def test_hot_keys_are_split_where_values_are_too_many_to_broadcast(spark):
    """One key holds a third of the rows: adaptive execution cuts its partition in the shuffled form."""
    ids = spark.range(300_000).repartition(16)
    rows_ = ids.select(F.md5(c("id").cast("string")).alias("f_rid"), F.when(c("id") % 3 == 0, 0).otherwise(c("id")).alias("k"))
    values = ids.select(c("id").alias("k"), (c("id") * 2).alias("v"))
    tuned = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {name: spark.conf.get(name) for name in tuned}
    for name, value in tuned.items():
        spark.conf.set(name, value)
    try:
        joined = attach(rows_, values, ["k"], TINY)
        counted = joined.groupBy().agg(F.count("*").alias("n"), F.sum(c("v") - 2 * c("k")).alias("off"), F.max("f_rid"))
        assert tuple(counted.collect()[0])[:2] == (300_000, 0)
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
