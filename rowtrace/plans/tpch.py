"""The 22 decision-support queries, each written once as a traced plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowtrace.functions.exact import ExactSum, cents, net, real
from rowtrace.operators.attach import join_values
from rowtrace.operators.lineage import Level, Lineage, Traced
from rowtrace.plans.params import GIVEN, Params
from rowtrace.sources.tables import Tables

scan = Traced.scan
c = F.col


def day(text: str) -> Column:
    return F.to_date(F.lit(text))


def between_days(column: str, start: str, end: str) -> Column:
    """start <= column < end"""
    return (c(column) >= day(start)) & (c(column) < day(end))


def q01(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    lines = scan(t.lineitem).where(c("l_shipdate") <= day(p["until"]))
    return Lineage(
        core=lines,
        keys=("l_returnflag", "l_linestatus"),
        aggregates={
            "qty": ExactSum(cents("l_quantity")),
            "price": ExactSum(cents("l_extendedprice")),
            "disc_price": ExactSum(net()),
            "charge": ExactSum(net() * (100 + cents("l_tax"))),
            "disc": ExactSum(cents("l_discount")),
            "count_order": F.count(F.lit(1)),
        },
        finish={
            "sum_qty": real("qty", 2),
            "sum_base_price": real("price", 2),
            "sum_disc_price": real("disc_price", 4),
            "sum_charge": real("charge", 6),
            "avg_qty": real("qty", 2) / c("count_order"),
            "avg_price": real("price", 2) / c("count_order"),
            "avg_disc": real("disc", 2) / c("count_order"),
        },
        outputs=(
            "l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price",
            "sum_charge", "avg_qty", "avg_price", "avg_disc", "count_order",
        ),
        order=(c("l_returnflag"), c("l_linestatus")),
    )


def q02(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    places = scan(t.nation).join(scan(t.region).where(c("r_name") == p["region"]), [("n_regionkey", "r_regionkey")])
    sellers = scan(t.supplier).join(places, [("s_nationkey", "n_nationkey")])
    wanted = scan(t.part).where(c("p_size") == p["size"], c("p_type").like(p["type"]))
    offers = (
        scan(t.partsupp)
        .join(wanted, [("ps_partkey", "p_partkey")])
        .join(sellers.measured(), [("ps_suppkey", "s_suppkey")])
        .select(
            "p_partkey", "ps_supplycost", "s_acctbal", "s_name", "n_name", "p_mfgr", "s_address", "s_phone", "s_comment"
        )
        .kept(reuse)
    )
    looked_at = replace(offers, rids=("ps_rid", "s_rid", "n_rid", "r_rid")).prefixed("sub_")
    outputs = ("s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment")
    return Lineage(
        core=replace(offers, rids=("p_rid", "s_rid", "ps_rid", "n_rid", "r_rid")).depends_on(looked_at, ["p_partkey"]),
        levels=(Level(("p_partkey",), {"least": F.min("ps_supplycost")}),),
        only=c("ps_supplycost") == c("least"),
        outputs=outputs,
        order=(c("s_acctbal").desc(), c("n_name"), c("s_name"), c("p_partkey")),
        limit=100,
    )


def q03(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    buyers = scan(t.customer).where(c("c_mktsegment") == p["segment"])
    placed = scan(t.orders).where(c("o_orderdate") < day(p["ordered_before"]))
    lines = scan(t.lineitem).where(c("l_shipdate") > day(p["shipped_after"]))
    rows = lines.join(placed.join(buyers, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    return Lineage(
        core=rows.select("l_orderkey", "o_orderdate", "o_shippriority", net().alias("net")).kept(reuse),
        keys=("l_orderkey", "o_orderdate", "o_shippriority"),
        aggregates={"total": ExactSum(c("net"))},
        finish={"revenue": real("total", 4)},
        outputs=("l_orderkey", "revenue", "o_orderdate", "o_shippriority"),
        order=(c("revenue").desc(), c("o_orderdate"), c("l_orderkey")),
        limit=10,
    )


def q04(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    placed = scan(t.orders).where(between_days("o_orderdate", p["start"], p["end"]))
    late = scan(t.lineitem).where(c("l_commitdate") < c("l_receiptdate"))
    return Lineage(
        core=placed.exists(late, [("o_orderkey", "l_orderkey")], single=True),
        keys=("o_orderpriority",),
        aggregates={"order_count": F.count(F.lit(1))},
        outputs=("o_orderpriority", "order_count"),
        order=(c("o_orderpriority"),),
    )


def q05(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    places = scan(t.nation).join(scan(t.region).where(c("r_name") == p["region"]), [("n_regionkey", "r_regionkey")])
    sellers = scan(t.supplier).join(places, [("s_nationkey", "n_nationkey")])
    sellers = sellers.select("s_suppkey", "s_nationkey", "n_name").measured()
    placed = scan(t.orders).where(between_days("o_orderdate", p["start"], p["end"]))
    bought = placed.join(scan(t.customer), [("o_custkey", "c_custkey")])
    rows = (
        scan(t.lineitem)
        .join(sellers, [("l_suppkey", "s_suppkey")])
        .join(bought, [("l_orderkey", "o_orderkey"), ("s_nationkey", "c_nationkey")])
    )
    return Lineage(
        core=rows.select("n_name", net().alias("net")).kept(reuse),
        keys=("n_name",),
        aggregates={"total": ExactSum(c("net"))},
        finish={"revenue": real("total", 4)},
        outputs=("n_name", "revenue"),
        order=(c("revenue").desc(), c("n_name")),
    )


def q06(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    rows = scan(t.lineitem).where(
        between_days("l_shipdate", p["start"], p["end"]),
        c("l_discount").between(p["low"], p["high"]),
        c("l_quantity") < p["quantity"],
    )
    return Lineage(
        core=rows,
        aggregates={"total": ExactSum(cents("l_extendedprice") * cents("l_discount"))},
        finish={"revenue": real("total", 4)},
        outputs=("revenue",),
        order=(),
    )


def q07(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    pair = [p["one"], p["other"]]
    from_nation = scan(t.occurrence("nation", "n1")).where(c("n1_name").isin(pair))
    to_nation = scan(t.occurrence("nation", "n2")).where(c("n2_name").isin(pair))
    sellers = scan(t.supplier).join(from_nation, [("s_nationkey", "n1_nationkey")])
    sellers = sellers.select("s_suppkey", "n1_name").measured()
    bought = scan(t.orders).join(
        scan(t.customer).join(to_nation, [("c_nationkey", "n2_nationkey")]), [("o_custkey", "c_custkey")]
    )
    shipped = scan(t.lineitem).where(c("l_shipdate").between(day(p["start"]), day(p["end"])))
    rows = (
        shipped.join(sellers, [("l_suppkey", "s_suppkey")])
        .join(bought, [("l_orderkey", "o_orderkey")])
        .where(c("n1_name") != c("n2_name"))
        .select(
            c("n1_name").alias("supp_nation"),
            c("n2_name").alias("cust_nation"),
            F.year("l_shipdate").cast("long").alias("l_year"),
            net().alias("net"),
        )
    )
    return Lineage(
        core=rows.kept(reuse),
        keys=("supp_nation", "cust_nation", "l_year"),
        aggregates={"total": ExactSum(c("net"))},
        finish={"revenue": real("total", 4)},
        outputs=("supp_nation", "cust_nation", "l_year", "revenue"),
        order=(c("supp_nation"), c("cust_nation"), c("l_year")),
    )


def q08(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    buyer_places = scan(t.occurrence("nation", "n1")).join(
        scan(t.region).where(c("r_name") == p["region"]), [("n1_regionkey", "r_regionkey")]
    )
    buyers = scan(t.customer).join(buyer_places, [("c_nationkey", "n1_nationkey")])
    placed = scan(t.orders).where(c("o_orderdate").between(day(p["start"]), day(p["end"])))
    bought = placed.join(buyers, [("o_custkey", "c_custkey")])
    sellers = scan(t.supplier).join(scan(t.occurrence("nation", "n2")), [("s_nationkey", "n2_nationkey")])
    rows = (
        scan(t.lineitem)
        .join(scan(t.part).where(c("p_type") == p["type"]), [("l_partkey", "p_partkey")])
        .join(bought, [("l_orderkey", "o_orderkey")])
        .join(sellers, [("l_suppkey", "s_suppkey")])
        .select(F.year("o_orderdate").cast("long").alias("o_year"), net().alias("net"), "n2_name")
    )
    return Lineage(
        core=rows.kept(reuse),
        keys=("o_year",),
        aggregates={
            "ours": ExactSum(F.when(c("n2_name") == p["nation"], c("net")).otherwise(0)),
            "total": ExactSum(c("net")),
        },
        finish={"mkt_share": real("ours", 4) / real("total", 4)},
        outputs=("o_year", "mkt_share"),
        order=(c("o_year"),),
    )


def q09(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    sellers = scan(t.supplier).join(scan(t.nation), [("s_nationkey", "n_nationkey")])
    rows = (
        scan(t.lineitem)
        .join(scan(t.part).where(c("p_name").like(p["name"])), [("l_partkey", "p_partkey")])
        .join(scan(t.partsupp), [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")])
        .join(sellers, [("l_suppkey", "s_suppkey")])
        .join(scan(t.orders), [("l_orderkey", "o_orderkey")])
        .select(
            c("n_name").alias("nation"),
            F.year("o_orderdate").cast("long").alias("o_year"),
            (net() - cents("ps_supplycost") * cents("l_quantity")).alias("amount"),
        )
    )
    return Lineage(
        core=rows.kept(reuse),
        keys=("nation", "o_year"),
        aggregates={"total": ExactSum(c("amount"))},
        finish={"sum_profit": real("total", 4)},
        outputs=("nation", "o_year", "sum_profit"),
        order=(c("nation"), c("o_year").desc()),
    )


def q10(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    placed = scan(t.orders).where(between_days("o_orderdate", p["start"], p["end"]))
    buyers = scan(t.customer).join(scan(t.nation), [("c_nationkey", "n_nationkey")])
    returned = scan(t.lineitem).where(c("l_returnflag") == p["flag"])
    keys = ("c_custkey", "c_name", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment")
    rows = returned.join(placed, [("l_orderkey", "o_orderkey")]).join(buyers, [("o_custkey", "c_custkey")])
    return Lineage(
        core=rows.select(*keys, net().alias("net")).kept(reuse),
        keys=keys,
        aggregates={"total": ExactSum(c("net"))},
        finish={"revenue": real("total", 4)},
        outputs=("c_custkey", "c_name", "revenue", "c_acctbal", "n_name", "c_address", "c_phone", "c_comment"),
        order=(c("revenue").desc(), c("c_custkey")),
        limit=20,
    )


def q11(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    sellers = scan(t.supplier).join(
        scan(t.nation).where(c("n_name") == p["nation"]), [("s_nationkey", "n_nationkey")]
    )
    sellers = sellers.select("s_suppkey").measured()
    worth = (cents("ps_supplycost") * c("ps_availqty")).alias("worth")
    stock = scan(t.partsupp).join(sellers, [("ps_suppkey", "s_suppkey")]).select("ps_partkey", worth).kept(reuse)
    threshold = stock.df.agg(ExactSum(c("worth")).column().alias("total"))
    threshold = threshold.select((real("total", 2) * p["fraction"]).alias("threshold"))
    return Lineage(
        core=stock.depends_on(stock.prefixed("sub_")),
        keys=("ps_partkey",),
        aggregates={"total": ExactSum(c("worth"))},
        having=real("total", 2) > threshold.scalar(),
        finish={"value": real("total", 2)},
        outputs=("ps_partkey", "value"),
        order=(c("value").desc(), c("ps_partkey")),
    )


def q12(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    lines = scan(t.lineitem).where(
        c("l_shipmode").isin(p["modes"]),
        c("l_commitdate") < c("l_receiptdate"),
        c("l_shipdate") < c("l_commitdate"),
        between_days("l_receiptdate", p["start"], p["end"]),
    )
    high = F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    rows = lines.join(scan(t.orders), [("l_orderkey", "o_orderkey")])
    return Lineage(
        core=rows.select("l_shipmode", high.alias("high")).kept(reuse),
        keys=("l_shipmode",),
        aggregates={"high_line_count": F.sum("high"), "low_line_count": F.sum(1 - c("high"))},
        outputs=("l_shipmode", "high_line_count", "low_line_count"),
        order=(c("l_shipmode"),),
    )


def q13(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    plain = scan(t.orders).where(~c("o_comment").like(p["comment"]))
    rows = scan(t.customer).join(plain, [("c_custkey", "o_custkey")], "left")
    placed = plain.df.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    per_customer = t.customer.join(placed, c("c_custkey") == c("o_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("c_count")
    )
    per_customer = Traced(per_customer, ()).kept(reuse).df
    base = per_customer.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist"))
    return Lineage(
        core=rows.select("c_custkey", "o_orderkey"),
        levels=(Level(("c_custkey",), {"c_count": F.count("o_orderkey")}, per_customer),),
        keys=("c_count",),
        base=base,
        outputs=("c_count", "custdist"),
        order=(c("custdist").desc(), c("c_count").desc()),
    )


def q14(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    lines = scan(t.lineitem).where(between_days("l_shipdate", p["start"], p["end"]))
    rows = lines.join(scan(t.part), [("l_partkey", "p_partkey")]).select("p_type", net().alias("net"))
    return Lineage(
        core=rows.kept(reuse),
        aggregates={
            "promo": ExactSum(F.when(c("p_type").like(p["type"]), c("net")).otherwise(0)),
            "total": ExactSum(c("net")),
        },
        finish={"promo_revenue": F.lit(100.0) * real("promo", 4) / real("total", 4)},
        outputs=("promo_revenue",),
        order=(),
    )


def q15(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    window = scan(t.lineitem).where(
        c("l_shipdate") >= day(p["start"]), c("l_shipdate") < F.add_months(day(p["start"]), p["months"])
    )
    lines = window.select(c("l_suppkey").alias("s_suppkey"), net().alias("net"))
    revenue = lines.df.groupBy("s_suppkey").agg(ExactSum(c("net")).column().alias("total"))
    best = revenue.agg(F.max("total").alias("best"))
    winners = revenue.filter(c("total") == best.scalar())
    base = t.supplier.join(winners, "s_suppkey").select(
        "s_suppkey", "s_name", "s_address", "s_phone", real("total", 4).alias("total_revenue"), "s_rid"
    )
    return Lineage(
        core=lines.depends_on(window.prefixed("sub_")),
        keys=("s_suppkey",),
        base=base,
        base_rids=("s_rid",),
        over={"total": ExactSum(c("net"))},
        over_only=c("total") == best.scalar(),
        outputs=("s_suppkey", "s_name", "s_address", "s_phone", "total_revenue"),
        order=(c("s_suppkey"),),
    )


def q16(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    wanted = scan(t.part).where(
        c("p_brand") != p["brand"], ~c("p_type").like(p["type"]), c("p_size").isin(p["sizes"])
    )
    unhappy = scan(t.supplier).where(c("s_comment").like(p["comment"])).prefixed("sub_")
    rows = scan(t.partsupp).join(wanted, [("ps_partkey", "p_partkey")])
    rows = rows.not_in("ps_suppkey", unhappy, "s_suppkey").select("p_brand", "p_type", "p_size", "ps_suppkey")
    return Lineage(
        core=rows.kept(reuse),
        keys=("p_brand", "p_type", "p_size"),
        aggregates={"supplier_cnt": F.count_distinct("ps_suppkey")},
        outputs=("p_brand", "p_type", "p_size", "supplier_cnt"),
        order=(c("supplier_cnt").desc(), c("p_brand"), c("p_type"), c("p_size")),
    )


def q17(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    wanted = scan(t.part).where(c("p_brand") == p["brand"], c("p_container") == p["container"])
    lines = (
        scan(t.lineitem)
        .join(wanted, [("l_partkey", "p_partkey")])
        .select("l_partkey", "l_quantity", cents("l_extendedprice").alias("price"))
        .kept(reuse)
    )
    usual = lines.df.groupBy("l_partkey").agg(F.avg("l_quantity").alias("usual"))
    rows = join_values(lines.df, usual, ["l_partkey"]).filter(c("l_quantity") < F.lit(0.2) * c("usual"))
    looked_at = Traced(lines.df, ("l_rid",), op=lines.op).prefixed("sub_")
    return Lineage(
        core=lines.narrowed(rows).depends_on(looked_at, ["l_partkey"]),
        aggregates={"total": ExactSum(c("price"))},
        finish={"avg_yearly": real("total", 2) / F.lit(7.0)},
        outputs=("avg_yearly",),
        order=(),
    )


def q18(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    sums = t.lineitem.groupBy("l_orderkey").agg(ExactSum(cents("l_quantity")).column().alias("qty"))
    large = sums.filter(c("qty") > 100 * p["quantity"]).select("l_orderkey")
    # the lines of the few large orders: what both the joined rows and the subquery's rows come from
    few = scan(t.lineitem).exists_only(large, [("l_orderkey", "l_orderkey")], rare=True)
    few = few.select("l_orderkey", cents("l_quantity").alias("qty")).kept(reuse)
    bought = scan(t.orders).join(scan(t.customer), [("o_custkey", "c_custkey")])
    rows = few.join(bought, [("l_orderkey", "o_orderkey")])
    keys = ("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = rows.select(*keys, "qty").kept(reuse)
    looked_at = few.select(c("l_orderkey").alias("o_orderkey")).prefixed("sub_")
    return Lineage(
        core=rows.depends_on(looked_at, ["o_orderkey"]),
        keys=keys,
        aggregates={"total": ExactSum(c("qty"))},
        finish={"sum_l_quantity": real("total", 2)},
        outputs=(*keys, "sum_l_quantity"),
        order=(c("o_totalprice").desc(), c("o_orderdate"), c("o_orderkey")),
        limit=100,
    )


def q19(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    brands = [case[0] for case in p["cases"]]
    lines = scan(t.lineitem).where(
        c("l_shipmode").isin(p["modes"]), c("l_shipinstruct") == p["instruct"]
    )
    parts = scan(t.part).where(c("p_brand").isin(brands))
    allowed = F.lit(False)
    for brand, containers, quantity, size in p["cases"]:
        allowed = allowed | (
            (c("p_brand") == brand)
            & c("p_container").isin(containers)
            & c("l_quantity").between(quantity, quantity + 10)
            & c("p_size").between(1, size)
        )
    rows = lines.join(parts, [("l_partkey", "p_partkey")]).where(allowed).select(net().alias("net"))
    return Lineage(
        core=rows.kept(reuse),
        aggregates={"total": ExactSum(c("net"))},
        finish={"revenue": real("total", 4)},
        outputs=("revenue",),
        order=(),
    )


def q20(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    sellers = scan(t.supplier).join(
        scan(t.nation).where(c("n_name") == p["nation"]), [("s_nationkey", "n_nationkey")]
    )
    parts = scan(t.part).where(c("p_name").like(p["name"]))
    shipped = scan(t.lineitem).where(between_days("l_shipdate", p["start"], p["end"]))
    shipped = shipped.exists_only(parts.df, [("l_partkey", "p_partkey")])
    half = shipped.df.groupBy("l_partkey", "l_suppkey").agg(
        (F.lit(0.5) * F.sum("l_quantity")).alias("half")
    ).withColumnsRenamed({"l_partkey": "h_partkey", "l_suppkey": "h_suppkey"})
    stock = scan(t.partsupp).join(parts, [("ps_partkey", "p_partkey")])
    ample = stock.df.join(half, (c("ps_partkey") == c("h_partkey")) & (c("ps_suppkey") == c("h_suppkey")))
    ample = ample.filter(c("ps_availqty") > c("half"))
    stock = stock.narrowed(ample).select("ps_partkey", "ps_suppkey").kept(reuse)
    behind = stock.join(shipped, [("ps_partkey", "l_partkey"), ("ps_suppkey", "l_suppkey")])
    behind = behind.select(c("ps_suppkey").alias("s_suppkey"))
    chosen = sellers.df.join(stock.df.select("ps_suppkey").distinct(), c("s_suppkey") == c("ps_suppkey"), "left_semi")
    return Lineage(
        core=sellers.narrowed(chosen).depends_on(behind, ["s_suppkey"], single=True),
        outputs=("s_name", "s_address"),
        order=(c("s_name"), c("s_address")),
    )


def q21(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    sellers = scan(t.supplier).join(
        scan(t.nation).where(c("n_name") == p["nation"]), [("s_nationkey", "n_nationkey")]
    )
    sellers = sellers.select("s_suppkey", "s_name").measured()
    placed = scan(t.orders).where(c("o_orderstatus") == p["status"])
    is_late = c("l_receiptdate") > c("l_commitdate")
    late_supplier = F.when(is_late, c("l_suppkey"))
    late = scan(t.lineitem).where(is_late).join(sellers, [("l_suppkey", "s_suppkey")])
    rows = late.join(placed, [("l_orderkey", "o_orderkey")]).select("s_name", "l_orderkey").kept(reuse)
    # The lines of the orders in question are read once, and kept for the lineage.
    # Several suppliers, exactly one of them late. One pass of partial aggregates over the
    # orders in question replaces both existence tests: lines are never compared in pairs.
    asked = scan(t.lineitem).exists_only(rows.df, [("l_orderkey", "l_orderkey")])
    asked = asked.select("l_orderkey", "l_suppkey", late_supplier.alias("late_supplier")).kept(reuse)
    blamed = (
        asked.df.groupBy(c("l_orderkey").alias("b_orderkey"))
        .agg(
            F.min("l_suppkey").alias("first"),
            F.max("l_suppkey").alias("last"),
            F.min("late_supplier").alias("culprit"),
            F.max("late_supplier").alias("last_late"),
        )
        .filter((c("first") != c("last")) & (c("culprit") == c("last_late")))
        .select("b_orderkey", "culprit")
    )
    blamed = Traced(blamed, ()).kept(reuse).df
    rows = rows.narrowed(rows.df.join(blamed, c("l_orderkey") == c("b_orderkey")))
    others = asked.select("l_orderkey", "l_suppkey").prefixed("sub_")
    others = others.narrowed(others.df.join(blamed, (c("l_orderkey") == c("b_orderkey")) & (c("l_suppkey") != c("culprit"))))
    return Lineage(
        core=rows.select("s_name", "l_orderkey").kept(reuse).depends_on(others, ["l_orderkey"]),
        keys=("s_name",),
        aggregates={"numwait": F.count(F.lit(1))},
        outputs=("s_name", "numwait"),
        order=(c("numwait").desc(), c("s_name")),
        limit=100,
    )


def q22(t: Tables, p: Params, reuse: bool = True) -> Lineage:
    code = F.substring("c_phone", 1, 2)
    coded = scan(t.customer).where(code.isin(p["codes"]))
    solvent = coded.where(c("c_acctbal") > 0.0)
    balance = cents("c_acctbal")
    average = solvent.df.agg(ExactSum(balance).column().alias("total"), F.count(F.lit(1)).alias("n"))
    average = average.select((real("total", 2) / c("n")).alias("average"))
    placed = t.orders if p["priority"] is None else t.orders.filter(c("o_orderpriority") == p["priority"])
    rows = coded.where(c("c_acctbal") > average.scalar()).not_exists(placed, [("c_custkey", "o_custkey")])
    return Lineage(
        core=rows.select(code.alias("cntrycode"), balance.alias("balance")).kept(reuse).depends_on(solvent.prefixed("sub_")),
        keys=("cntrycode",),
        aggregates={"numcust": F.count(F.lit(1)), "total": ExactSum(c("balance"))},
        finish={"totacctbal": real("total", 2)},
        outputs=("cntrycode", "numcust", "totacctbal"),
        order=(c("cntrycode"),),
    )


QUERIES: dict[str, Callable[[Tables, Params, bool], Lineage]] = {
    "q01": q01, "q02": q02, "q03": q03, "q04": q04, "q05": q05, "q06": q06, "q07": q07, "q08": q08,
    "q09": q09, "q10": q10, "q11": q11, "q12": q12, "q13": q13, "q14": q14, "q15": q15, "q16": q16,
    "q17": q17, "q18": q18, "q19": q19, "q20": q20, "q21": q21, "q22": q22,
}


def query(name: str, tables: Tables, params: Params | None = None, reuse: bool = True) -> Lineage:
    """`reuse=False` when only the plain result is wanted: nothing is kept for its lineage."""
    return QUERIES[name](tables, GIVEN[name] if params is None else params, reuse)
