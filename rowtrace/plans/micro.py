"""Single-operator lineage workloads, generators, edge tables, lookups and layouts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrace.operators import bitmaps as B
from rowtrace.operators import edges as E
from rowtrace.operators import generators as G
from rowtrace.operators.attach import Branch, attach, over_groups
from rowtrace.operators.layout import store_grouped, store_plain, store_zoned
from rowtrace.operators.lineage import Traced
from rowtrace.operators.store import EdgeStore
from rowtrace.plans.tpch import query
from rowtrace.session import Limits, fresh_path, keep
from rowtrace.sources.runs import read_micro
from rowtrace.sources.sinks import store_table, write_csv
from rowtrace.sources.tables import Tables, money

Job = Callable[[Tables], DataFrame]
scan = Traced.scan
c = F.col
SEGMENT = Limits(list_rows=5_000)
LOOKUPS = (1, 10, 100, 1000)


# -- generators -----------------------------------------------------------------


def ids(t: Tables) -> DataFrame:
    """idx = 0 .. n-1 from the event ids."""
    return t.raw("events").select(c("event_id").alias("idx"))


def zipf(t: Tables, groups: int = 1000, theta: float = 1.0) -> DataFrame:
    return G.zipf_groups(ids(t), groups, theta)


def selectivity(t: Tables, share: float = 0.2) -> DataFrame:
    source = ids(t)
    return G.selective(source, source.count(), share)


def mcopies(t: Tables, times: int = 3) -> DataFrame:
    source = ids(t)
    return G.copies(source, source.count(), times)


def theta_pair(t: Tables, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    left = t.raw("supplier").select(c("s_suppkey").alias("idx"))
    right = ids(t)
    return G.below_pair(left, left.count(), right, right.count(), share)


def gen_theta_pair(t: Tables) -> DataFrame:
    one, two = theta_pair(t)
    return one.select(F.lit("t1").alias("side"), "id", "v").unionByName(two.select(F.lit("t2").alias("side"), "id", "v"))


def primary(t: Tables) -> DataFrame:
    return G.keyed(t.raw("part").select(c("p_partkey").alias("idx")))


# -- scans, sources and sinks ---------------------------------------------------


def src_parquet(t: Tables) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    counts = [t.raw(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts)


def src_csv_micro(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "micro")
    write_csv(G.widened(G.uniform_groups(ids(t), 100), 2), path)
    return read_micro(t.spark, path, columns=2)


def sink_csv_pipe(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "pipe")
    write_csv(G.uniform_groups(ids(t), 100), path, separator="|")
    return t.spark.read.schema("idx long, z long, v double").option("header", True).option("sep", "|").csv(path)


def sink_csv_append(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "append")
    for append in (False, True):
        write_csv(G.uniform_groups(ids(t), 100), path, append=append)
    return read_micro(t.spark, path)


# -- single operators -----------------------------------------------------------


def lines_by(t: Tables, key: str) -> Traced:
    return scan(t.lineitem).select(key)


def group_join(t: Tables, key: str) -> DataFrame:
    rows = lines_by(t, key).df
    return attach(rows, rows.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")), [key])


def group_window(t: Tables, key: str) -> DataFrame:
    return over_groups(lines_by(t, key).df, [key], {"cnt": F.count(F.lit(1))})


def group_list(t: Tables, key: str, as_text: bool = False) -> DataFrame:
    return E.segments(lines_by(t, key).df, [key], "l_rid", SEGMENT, as_text)


def nested_group(t: Tables) -> DataFrame:
    rows = scan(t.part).select("p_brand", "p_retailprice").df
    total = rows.groupBy("p_brand").agg(F.sum(money("p_retailprice")).alias("total"))
    return attach(rows.select("p_brand", "p_rid"), total, ["p_brand"])


def order_by(t: Tables) -> DataFrame:
    return scan(t.orders).select("o_orderpriority", "o_orderkey").df.orderBy("o_orderpriority", "o_orderkey")


def filtered(t: Tables, late: bool = False) -> DataFrame:
    """`late` filters on an expression, which no scan can evaluate."""
    quantity = c("l_quantity") + F.lit(0.0) if late else c("l_quantity")
    rows = scan(t.lineitem).where(quantity < 10).select("l_orderkey", "l_quantity", "l_returnflag")
    return rows.df


def below(t: Tables, or_equal: bool = False) -> Traced:
    """Suppliers with the nations numbered above (or from) their own."""
    left = scan(t.supplier).select("s_suppkey", "s_nationkey")
    return left.join_below(scan(t.nation).select("n_nationkey"), "s_nationkey", "n_nationkey", or_equal)


def below_by_expression(t: Tables) -> Traced:
    """The same pairs as `below(or_equal=True)`, asked for by a disjunction."""
    left = scan(t.supplier).select("s_suppkey", "s_nationkey")
    either = Branch(equal=(("s_nationkey", "n_nationkey"),)), Branch(low="s_nationkey", high="n_nationkey")
    return left.join_any(scan(t.nation).select("n_nationkey"), *either)


def cross(t: Tables) -> Traced:
    return scan(t.supplier).select("s_suppkey").product(scan(t.region).select("r_regionkey"))


def pkfk(t: Tables) -> Traced:
    orders = scan(t.orders).select("o_custkey", "o_totalprice")
    return orders.join(scan(t.customer).select("c_custkey"), [("o_custkey", "c_custkey")])


def many_to_many(t: Tables) -> Traced:
    """Customers with all nations of their region: neither side is unique on the region."""
    home = scan(t.nation).df.select(c("n_nationkey").alias("home"), c("n_regionkey").alias("region"))
    left = scan(t.customer)
    left = Traced(left.df.join(home, c("c_nationkey") == c("home")), left.rids).select("region", "c_acctbal")
    return left.join(scan(t.nation).select("n_regionkey", "n_name"), [("region", "n_regionkey")])


def out_cardinality(t: Tables) -> DataFrame:
    """Rows of each operator's lineage, and their share of all input pairs."""
    size = {n: t.raw(n).agg(F.count(F.lit(1))).scalar() for n in ("lineitem", "supplier", "nation", "customer", "orders", "region")}
    one = F.lit(1).cast("long")
    plans: list[tuple[str, DataFrame, Column, Column]] = [
        ("filter", filtered(t), size["lineitem"], one),
        ("order_by", order_by(t), size["orders"], one),
        ("group_join", group_join(t, "l_suppkey"), size["lineitem"], one),
        ("theta_lt", below(t).df, size["supplier"], size["nation"]),
        ("cross", cross(t).df, size["supplier"], size["region"]),
        ("pkfk", pkfk(t).df, size["orders"], size["customer"]),
        ("mtm", many_to_many(t).df, size["customer"], size["nation"]),
    ]
    rows = []
    for name, frame, n1, n2 in plans:
        counted = frame.agg(F.count(F.lit(1)).alias("n_out"))
        rows.append(counted.select(F.lit(name).alias("op"), "n_out", n1.alias("n1"), n2.alias("n2")))
    whole = reduce(DataFrame.unionByName, rows)
    pairs = c("n1").cast("double") * c("n2").cast("double")
    return whole.select("*", (c("n_out").cast("double") / pairs).alias("selectivity"))


# -- edges ----------------------------------------------------------------------


def orders_by_price(t: Tables, limit: int | None = None) -> DataFrame:
    order = [c("o_totalprice").desc(), c("o_orderkey")]
    return E.order_edges(t.orders.select("o_totalprice", "o_orderkey", "o_rid"), "o_rid", order, limit)


def filter_edges(t: Tables) -> DataFrame:
    return E.row_edges(t.lineitem.filter(c("l_quantity") < 10), "l_rid")


def group_edges(t: Tables, key: str = "l_partkey") -> DataFrame:
    return E.group_edges(t.lineitem.select(c(key).alias("out_id"), "l_rid"), ["out_id"], "l_rid")


def pkfk_edges(t: Tables) -> DataFrame:
    return E.join_edges(pkfk(t).df, "o_rid", "c_rid")


def merge_edges(t: Tables) -> DataFrame:
    """Same edges by a sort-merge join: both sides sorted on the key."""
    joined = t.orders.select("o_custkey", "o_rid").join(
        t.customer.select("c_custkey", "c_rid").hint("merge"), c("o_custkey") == c("c_custkey")
    )
    return E.join_edges(joined, "o_rid", "c_rid")


def theta_edges(t: Tables) -> DataFrame:
    return E.join_edges(below(t).df, "s_rid", "n_rid")


def outer_edges(t: Tables) -> DataFrame:
    placed = t.orders.filter(c("o_orderpriority") == "1-URGENT").select("o_custkey", "o_rid")
    joined = scan(t.customer).select("c_custkey").join(scan(placed), [("c_custkey", "o_custkey")], "left").df
    return E.join_edges(joined, "c_rid", "o_rid")


def composed_outer(t: Tables) -> DataFrame:
    """Customer -> its urgent orders -> their lines, keeping customers without any."""
    upper = outer_edges(t).select(c("lhs_id").alias("out_id"), c("rhs_id").alias("in_id"))
    lower = t.lineitem.select(c("l_orderkey").alias("out_id"), c("l_rid").alias("l_rid"))
    return E.compose(upper, lower, how="left")


def composed(t: Tables) -> DataFrame:
    """Group-by over a join over a filter, one edge table each, followed end to end."""
    placed = t.orders.filter(c("o_orderdate") < F.to_date(F.lit("1996-01-01")))
    joined = placed.select("o_custkey", "o_rid", "o_orderpriority").join(
        t.customer.select("c_custkey", "c_rid"), c("o_custkey") == c("c_custkey")
    )
    joins = E.join_edges(joined, "o_rid", "c_rid")
    named = joined.select("o_orderpriority", F.concat_ws("|", c("o_rid").cast("string"), c("c_rid").cast("string")).alias("j"))
    groups = E.group_edges(named, ["o_orderpriority"], "j")
    filters = E.row_edges(placed, "o_rid")
    upper = E.compose(groups, joins)
    return E.compose(upper, filters.withColumnRenamed("in_id", "o_rid"), via="lhs_id").withColumnRenamed("rhs_id", "c_rid")


def scalar_concat(t: Tables) -> DataFrame:
    """Ids behind a scalar subquery, packed as text."""
    sub = query("q22", t).core.subs[0]
    packed = E.segments(sub.frame, [], sub.rids[0], SEGMENT, as_text=True)
    return packed.select(F.lit(0).cast("long").alias("out_id"), "segment", c("rids").alias("ids"))


def join_addresses(t: Tables) -> DataFrame:
    """Orders and customers: the hash join's two edge tables."""
    return E.address_edges(t.orders, t.customer, [("o_custkey", "c_custkey")], "o_rid", "c_rid")


def region_addresses(t: Tables) -> DataFrame:
    """Customers and all nations of their region, a many-to-many join, by address."""
    home = t.nation.select(c("n_nationkey").alias("home"), c("n_regionkey").alias("region"))
    left = t.customer.join(home, c("c_nationkey") == c("home")).select("region", "c_rid")
    return E.address_edges(left, t.nation, [("region", "n_regionkey")], "c_rid", "n_rid")


def skewed_pairs(t: Tables) -> DataFrame:
    """Many-to-many joins of Zipf tables: edges by address grow with the rows, pairs with the square of the groups."""
    parts = []
    for theta in (0.0, 0.5, 0.8, 1.0):
        rows = zipf(t, 100, theta)
        addressed = E.address_edges(rows, rows.toDF(*[f"r_{x}" for x in rows.columns]), [("z", "r_z")], "idx", "r_idx")
        totals = E.pair_counts(addressed).agg(F.sum(c("n_probe") + c("n_build")).alias("n_edges"), F.sum("n_pairs").alias("n_pairs"))
        parts.append(totals.select(F.lit(theta).alias("theta"), "n_edges", "n_pairs"))
    return reduce(DataFrame.unionByName, parts)


def chosen_pairs(t: Tables) -> DataFrame:
    """The joined form for chosen left rows only: the suppliers' customers' pairs are never built as a whole."""
    addressed = region_addresses(t)
    wanted = t.customer.orderBy("c_custkey").limit(10).select(c("c_rid").cast("string").alias("_w"))
    probe = addressed.filter("side = 'probe'").join(F.broadcast(wanted), c("id") == c("_w"), "left_semi")
    return E.pairs_of(probe.unionByName(addressed.filter("side = 'build'")))


def flag_phases(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_rid")
    return E.phase_edges(rows, ["l_returnflag", "l_linestatus"], "l_rid", [c("cnt").desc(), c("l_returnflag"), c("l_linestatus")])


def full_outer(t: Tables) -> DataFrame:
    """Customer -> urgent orders -> large lines; whoever has no partner stays, on either side."""
    upper = outer_edges(t).select(c("lhs_id").alias("out_id"), c("rhs_id").alias("in_id"))
    lower = t.lineitem.filter(c("l_quantity") > 40).select(c("l_orderkey").alias("out_id"), "l_rid")
    return E.full_compose(upper, lower).select(c("out_id").cast("string").alias("out_id"), "l_rid")


def numbered_lines(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return B.dense(t.lineitem.select(*order, "l_rid"), order, bound=t.raw("lineitem").count())


def line_bitmaps(t: Tables) -> DataFrame:
    return B.group_bitmaps(numbered_lines(t), ["l_suppkey"])


def bitmap_sizes(t: Tables) -> DataFrame:
    """Bits set and bytes held for each supplier and bucket."""
    held = B.pieces(line_bitmaps(t), ["l_suppkey"])
    return held.select("l_suppkey", "bucket", F.bitmap_count("bits").alias("cnt"), F.length("bits").cast("long").alias("bytes"))


def bitmap_rows(t: Tables) -> DataFrame:
    """The lines of each supplier, read back from its bitmaps."""
    numbered = numbered_lines(t)
    rows = numbered.select(c("id").alias("_id"), "l_rid")
    found = B.members(B.group_bitmaps(numbered, ["l_suppkey"]))
    return found.join(rows, c("id") == c("_id")).select("l_suppkey", "l_rid")


def bitmap_union(t: Tables) -> DataFrame:
    """Lines of each nation, as unions of the bitmaps of its suppliers, and the lines that its first order status shares."""
    homes = t.supplier.select(c("s_suppkey").alias("_s"), "s_nationkey")
    numbered = numbered_lines(t)
    placed = B.group_bitmaps(numbered, ["l_suppkey"]).join(homes, c("l_suppkey") == c("_s"))
    nations = keep(B.union(placed, ["s_nationkey"]))
    returned = B.group_bitmaps(numbered.join(t.lineitem.filter("l_returnflag = 'R'").select(c("l_rid").alias("_r")), c("l_rid") == c("_r")), [])
    # of the returned lines, each nation is offered the words that it has as well
    words = returned.select(c("bucket").alias("_b"), c("word").alias("_w"), c("bits").alias("_bits"))
    offered = nations.join(words, (c("bucket") == c("_b")) & (c("word") == c("_w"))).select("s_nationkey", "bucket", "word", c("_bits").alias("bits"))
    common = B.sizes(B.intersection(nations.unionByName(offered), ["s_nationkey"], 2), ["s_nationkey"])
    common = common.withColumnsRenamed({"cnt": "returned", "s_nationkey": "_n"})
    found = B.sizes(nations, ["s_nationkey"]).join(common, c("s_nationkey") == c("_n"), "left")
    return found.select("s_nationkey", "cnt", F.coalesce("returned", F.lit(0).cast("long")).alias("returned"))


# -- lookups --------------------------------------------------------------------


EDGES: dict[str, Callable[[Tables], DataFrame]] = {
    "filter": filter_edges,
    "orderby": orders_by_price,
    "simpleagg": lambda t: E.whole_edges(query("q06", t).core.df, "l_rid"),
    "groupby": group_edges,
    "perfgroupby": lambda t: group_edges(t, "l_linenumber"),
    "hashjoin": pkfk_edges,
    "mergejoin": merge_edges,
    "nljoin": theta_edges,
}


def store_of(t: Tables, name: str) -> EdgeStore:
    """The stored edges of an operator, written when they are first asked for."""
    if name not in t.stores:
        t.stores[name] = EdgeStore.write(EDGES[name](t))
    return t.stores[name]


def first_ids(edges: DataFrame) -> DataFrame:
    """The first output ids and their rank from 0 on."""
    wanted = edges.select("out_id").distinct().orderBy("out_id").limit(max(LOOKUPS))
    # at most `max(LOOKUPS)` rows from here on
    return E.ordinal(wanted, [c("out_id")], "rank", bound=max(LOOKUPS))


def lookup_counts(store: EdgeStore) -> DataFrame:
    """Edges found for the first 1, 10, 100, 1000 output ids, in one pass over the buckets that hold them."""
    ranked = first_ids(store.edges())
    found = store.lookup(ranked, max(LOOKUPS)).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.explode(F.array(*[F.lit(n).cast("long") for n in LOOKUPS]))
    per_size = found.select("n", "rank", sizes.alias("n_ids")).filter(c("rank") < c("n_ids"))
    return per_size.groupBy("n_ids").agg(F.sum("n").alias("n_rows"))


# -- layouts --------------------------------------------------------------------


def first_parts(t: Tables) -> DataFrame:
    return t.raw("part").select(c("p_partkey").alias("out_id")).orderBy("out_id").limit(max(LOOKUPS))


def layout_of(t: Tables, name: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges of the group-by in a layout, written when it is first asked for."""
    if name not in t.stores:
        t.stores[name] = store(group_edges(t))
    return t.stores[name]


def index_none(t: Tables) -> DataFrame:
    return E.lookup(layout_of(t, "plain", store_plain), first_parts(t), bound=max(LOOKUPS))


def index_zone(t: Tables) -> DataFrame:
    """The range of wanted ids is known, so the scan can skip row groups by it."""
    stored, wanted = layout_of(t, "zoned", store_zoned), first_parts(t)
    low, high = wanted.agg(F.min("out_id"), F.max("out_id")).first()
    if low is not None:
        stored = stored.filter(c("out_id").between(low, high))
    return E.lookup(stored, wanted, bound=max(LOOKUPS))


def index_group(t: Tables) -> DataFrame:
    stored = layout_of(t, "grouped", lambda edges: store_grouped(edges, limits=SEGMENT))
    return E.lookup(stored, first_parts(t), bound=max(LOOKUPS)).select("out_id", F.explode("rids").alias("in_id"))


def index_bucket(t: Tables) -> DataFrame:
    """Buckets by output id: only those of the wanted ids are read."""
    return store_of(t, "groupby").lookup(first_parts(t), max(LOOKUPS)).select("out_id", "in_id")


def jobs() -> dict[str, Job]:
    return {
        "src_parquet": src_parquet,
        "src_csv_micro": src_csv_micro,
        "sink_ctas": lambda t: store_table(query("q03", t).frame()),
        "sink_csv_pipe": sink_csv_pipe,
        "sink_csv_append": sink_csv_append,
        "gen_zipf": zipf,
        "gen_uniform_group": lambda t: G.uniform_groups(ids(t), 1000),
        "gen_selectivity": selectivity,
        "gen_mcopies": mcopies,
        "gen_theta_pair": gen_theta_pair,
        "gen_pk": primary,
        "gen_extra_cols": lambda t: G.widened(G.uniform_groups(ids(t), 100), 8),
        "gen_profile": lambda t: G.profile(zipf(t, 100, 0.8)),
        "rid_scan": lambda t: scan(t.orders).df,
        "rid_scan_wide": lambda t: G.widened(t.events.withColumn("idx", c("event_id")), 4).drop("idx", "ts"),
        "rid_orderby": order_by,
        "rid_filter": filtered,
        "rid_filter_late": lambda t: filtered(t, late=True),
        "rid_filter_micro": lambda t: selectivity(t).filter(c("z") == 0).select(c("idx").alias("t_rid"), "z", "v"),
        "rid_group_join": lambda t: group_join(t, "l_suppkey"),
        "rid_group_list": lambda t: group_list(t, "l_suppkey"),
        "rid_group_concat": lambda t: group_list(t, "l_suppkey", as_text=True),
        "rid_group_window": lambda t: group_window(t, "l_suppkey"),
        "rid_group_str": lambda t: group_join(t, "l_returnflag"),
        "rid_group_str_list": lambda t: group_list(t, "l_returnflag"),
        "rid_group_str_concat": lambda t: group_list(t, "l_returnflag", as_text=True),
        "rid_nested_group": nested_group,
        "rid_distinct": lambda t: scan(t.lineitem).traced_distinct(["l_shipmode", "l_returnflag"]).frame(),
        "rid_theta_lt": lambda t: below(t).df,
        "rid_theta_or": lambda t: below_by_expression(t).df,
        "rid_theta_le": lambda t: below(t, or_equal=True).df,
        "rid_cross": lambda t: cross(t).df,
        "rid_pkfk": lambda t: pkfk(t).df,
        "rid_pkfk_one_side": lambda t: pkfk(t).df.select("o_rid", "o_totalprice"),
        "rid_pkfk_both": lambda t: pkfk(t).df.select("o_rid", "c_rid", "o_totalprice", "c_custkey"),
        "rid_mtm": lambda t: many_to_many(t).df,
        "rid_mtm_one_side": lambda t: many_to_many(t).df.select("c_rid", "c_acctbal"),
        "out_cardinality": out_cardinality,
        "edge_scan": lambda t: E.row_edges(t.orders, "o_rid"),
        "edge_filter": filter_edges,
        "edge_order": orders_by_price,
        "edge_limit": lambda t: orders_by_price(t, 100),
        "edge_group": group_edges,
        "edge_hash_join": pkfk_edges,
        "edge_theta_join": theta_edges,
        "edge_outer": outer_edges,
        "edge_outer_composed": composed_outer,
        "edge_composed": composed,
        "edge_global_agg": lambda t: E.whole_edges(query("q06", t).core.df, "l_rid"),
        "edge_scalar_concat": scalar_concat,
        "edge_hash_join_address": join_addresses,
        "edge_hash_join_pairs": lambda t: E.pairs_of(join_addresses(t)),
        "edge_mtm_counts": lambda t: E.pair_counts(region_addresses(t)),
        "edge_group_phases": flag_phases,
        "edge_group_through": lambda t: E.through_phases(flag_phases(t)),
        "edge_full_outer": full_outer,
        "rid_mtm_skewed": skewed_pairs,
        "rid_mtm_chosen": chosen_pairs,
        "rid_group_bitmap": bitmap_sizes,
        "rid_group_bitmap_rows": bitmap_rows,
        "rid_group_bitmap_union": bitmap_union,
        **{f"lookup_{name}": lambda t, name=name: lookup_counts(store_of(t, name)) for name in EDGES},
        "index_bucket": index_bucket,
        "index_none": index_none,
        "index_zone": index_zone,
        "index_group": index_group,
    }


