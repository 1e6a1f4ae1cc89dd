"""Analysis of benchmark run tables: overheads of lineage capture against a baseline.

The jobs take any run table with the columns of `runs`. Here it is a view over
the events table, as the given data holds no benchmark runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrace.operators.attach import matching
from rowtrace.operators.trace import agreement, id_counts, originals, row_counts, sizes
from rowtrace.plans.params import DECORRELATED, FACTORISED, TRACE_KEYS
from rowtrace.plans.tpch import QUERIES, query
from rowtrace.session import fresh_path, passing, pruned
from rowtrace.sources.runs import FAMILIES, read_runs, union_families
from rowtrace.sources.sinks import write_csv
from rowtrace.sources.tables import Tables

Job = Callable[[Tables], DataFrame]
c = F.col

# Query classes, and the labels that drifting run files use for one system.
JOINS_AND_AGGREGATES = [1, 3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 19]
UNCORRELATED = [11, 15, 16, 18]
CLASSES = ("1. Joins-Aggregations", "2. Uncorrelated subQs", "3. Correlated subQs")
LABELS = {
    "Perm": "Logical-RID", "Logical": "Logical-RID", "Logical-RID": "Logical-RID", "Logical_RID": "Logical-RID",
    "Logical-OPT": "Logical-OPT", "Logical-window": "Logical-window", "Logical_window": "Logical-window",
    "Logical_list": "Logical-list", "Logical_group_concat": "Logical-concat",
    "SD_Capture": "SD_full", "SD_full": "SD_full", "SD_copy": "SD_copy", "SD_stats": "SD_stats",
    "SD_Persist": "SD_copy", "SD_Query": "SD_query", "LIN": "SD_query", "Baseline": "Baseline",
}
# Operators of the lookup runs, how they are shown, and their kind; parsing is timed as one more.
LOOKED_UP = {
    "parse": ("Parse", "misc"), "filter": ("Filter", "misc"), "orderby": ("Order By", "misc"), "simpleagg": ("Simple Agg", "agg"),
    "groupby": ("Group By", "agg"), "perfgroupby": ("Perfect GrpBy", "agg"), "nljoin": ("NL Join", "Join"),
    "mergejoin": ("Merge Join", "Join"), "hashjoin": ("Hash Join", "Join"),
}
OPERATORS = ("SEQ_SCAN", "FILTER", "ORDER_BY", "HASH_GROUP_BY", "HASH_JOIN", "INDEX_JOIN_mtm")
LOGICAL = ("Logical-RID", "Logical-OPT", "Logical-window", "Logical-list", "Logical-concat")
MIB = 1024.0 * 1024.0


def r6(column: Column) -> Column:
    return F.round(column, 6)


def _choice(position: Column, values: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)


def raw_runs(t: Tables) -> DataFrame:
    """One run per event: labels as drifting files spell them, plan as nested JSON text."""
    kind, ident, value = c("event_type"), c("event_id"), c("value")
    number = c("user_id") % 22 + 1
    has_variant = number.isin([int(q[1:]) for q in DECORRELATED]) & (ident % 2 == 0)
    label = (
        F.when(kind == "view", "Baseline")
        .when((kind == "click") & has_variant, "Logical-OPT")
        .when(kind == "click", F.when(ident % 3 == 0, "Perm").otherwise("Logical-RID"))
        .when(kind == "signup", F.when(ident % 2 == 0, "SD_Capture").otherwise("SD_full"))
        .when(kind == "error", "SD_copy")
        .otherwise("SD_stats")
    )
    size = F.concat_ws(",", (ident % 500).cast("string"), (ident % 700).cast("string"), (ident % 9).cast("string"))
    stats = F.when(
        kind == "purchase", F.when(ident % 2 == 0, F.concat_ws(",", size, (ident % 40).cast("string"))).otherwise(size)
    )

    def node(name: Column, share: float, below: Column) -> Column:
        parts = [F.concat(F.lit('"name": "'), name, F.lit('"')), F.concat(F.lit('"timing": '), (value * share).cast("string"))]
        parts.append(F.concat(F.lit('"children": ['), below, F.lit("]")))
        # the keys of a node come in any order
        orders = [F.concat_ws(", ", *parts), F.concat_ws(", ", *parts[::-1]), F.concat_ws(", ", parts[1], parts[2], parts[0])]
        chosen = F.when(ident % 3 == 0, orders[0]).when(ident % 3 == 1, orders[1]).otherwise(orders[2])
        return F.concat(F.lit("{"), chosen, F.lit("}"))

    op = _choice(c("user_id") % 6, OPERATORS)
    plan = node(F.lit("CREATE_TABLE_AS"), 0.1, node(stem(op), 0.6, node(F.lit("SEQ_SCAN"), 0.3, F.lit(""))))
    return t.raw("events").select(
        number.alias("query"),
        op.alias("op"),
        ident.alias("r"),
        value.alias("runtime"),
        label.alias("lineage_type"),
        (ident % 1000 + 1).alias("output"),
        stats.alias("stats"),
        F.when(ident % 2 == 0, "True").otherwise("False").alias("index_scan"),
        F.when(ident % 5 > 0, (ident % 5 / 5.0)).alias("sel"),
        F.concat(F.lit('{"name": "ROOT", "children": ['), plan, F.lit("]}")).alias("plan"),
        (1000 * (ident % 3 + 1)).alias("n1"),
        (100 * (ident % 2 + 1)).alias("n2"),
        ((ident % 3) * 0.5).alias("skew"),
        (ident % 2 + 1).alias("ncol"),
        (ident % 7 + 1).alias("groups"),
        (ident % 2 + 1).cast("double").alias("sf"),
        (ident % 4 + 1).alias("n_threads"),
    )


# -- columns of a single run ------------------------------------------------------


def normal_label(column: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(labels[column], column)


def query_class(number: Column) -> Column:
    return (
        F.when(number.isin(JOINS_AND_AGGREGATES), CLASSES[0])
        .when(number.isin(UNCORRELATED), CLASSES[1])
        .otherwise(CLASSES[2])
    )


def stem(op: Column) -> Column:
    """Name of a plan's node for an operator: the many-to-many form of a join runs as the join."""
    return F.regexp_replace(op, "_mtm$", "")


PLAN_DEPTH = 10  # levels of a nested plan; deeper ones are an error, not cut


def _plan_type(depth: int) -> T.StructType:
    fields = [T.StructField("name", T.StringType()), T.StructField("timing", T.DoubleType())]
    below: T.DataType = _plan_type(depth - 1) if depth else T.StringType()
    return T.StructType([*fields, T.StructField("children", T.ArrayType(below))])


def _nodes(node: Column, depth: int) -> Column:
    """The node and all below it, depth first, as an array of (name, timing)."""
    own = F.array(F.struct(node["name"].alias("name"), node["timing"].alias("timing")))
    children = node["children"]
    if not depth:
        deeper = F.raise_error(F.lit(f"a plan has more than {PLAN_DEPTH} levels")).cast(own_type())
        return F.when(F.size(children) > 0, deeper).otherwise(own)
    below = F.flatten(F.transform(children, lambda child: _nodes(child, depth - 1)))
    return F.concat(own, F.coalesce(below, F.array().cast(own_type())))


def own_type() -> str:
    return "array<struct<name:string,timing:double>>"


def flat_plan(plan: Column) -> Column:
    """Plan text -> map from operator name + position to its time, depth first; keys in any order, names with any
    character, nodes without a time left out.

    A flat text has names (numbered already) and times.
    """
    tree = _nodes(F.from_json(plan, _plan_type(PLAN_DEPTH - 1)), PLAN_DEPTH - 1)
    timed = F.filter(tree, lambda node: node["timing"].isNotNull())
    named = F.transform(timed, lambda node, i: F.concat(node["name"], i.cast("string")))
    nested = F.map_from_arrays(named, F.transform(timed, lambda node: node["timing"]))
    flat = F.from_json(plan, T.MapType(T.StringType(), T.DoubleType()))
    return F.when(F.get_json_object(plan, "$.children").isNotNull(), nested).otherwise(flat)


def plan_prefix(op: Column, lineage_type: Column) -> Column:
    """Whose time counts as the operator's: lineage by window functions is spent in the window."""
    return F.when(lineage_type.isin("Logical_window", "Logical-window"), F.lit("WINDOW")).otherwise(op)


def plan_total(plan: Column) -> Column:
    return F.aggregate(F.map_values(plan), F.lit(0.0), lambda total, x: total + x)


def plan_op(plan: Column, prefix: Column) -> Column:
    """Time of the first operator whose name starts with `prefix` (a trailing _mtm is ignored)."""
    return F.get(F.filter(F.map_entries(plan), lambda e: F.startswith(e["key"], stem(prefix))), F.lit(0))["value"]


def plan_mat(plan: Column) -> Column:
    return F.coalesce(plan_op(plan, F.lit("CREATE_TABLE_AS")), F.lit(0.0))


def with_stats(runs: DataFrame) -> DataFrame:
    """size, count, chunks and post-processing time out of the text column; 0 where absent."""
    parts = F.split("stats", ",")
    names = ("lineage_size", "lineage_count", "nchunks", "postprocess")
    values = [F.when(c("lineage_type") == "SD_stats", F.get(parts, F.lit(i)).cast("double")) for i in range(4)]
    return runs.select("*", *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(names, values, strict=True)])


def with_index_label(runs: DataFrame) -> DataFrame:
    """Index joins say which sides they project; only joins keep the flag; joins have no selectivity."""
    is_join = c("op").isin("INDEX_JOIN", "INDEX_JOIN_mtm", "HASH_JOIN", "HASH_JOIN_mtm")
    flag = is_join & (F.lower("index_scan") == "true")
    label = F.when(c("op").startswith("INDEX_JOIN"), F.when(flag, "Q_P").otherwise("Q_P,F")).otherwise("-")
    sel = F.when(is_join, -1.0).otherwise(F.coalesce(c("sel"), F.lit(-1.0)))
    return runs.select(
        *[x for x in runs.columns if x not in ("index_scan", "sel")],
        flag.cast("long").alias("index_scan"), label.alias("index_join"), sel.alias("sel"),
    )


def runs(t: Tables) -> DataFrame:
    """Run table with normal labels, query classes, plan times and statistics."""
    labelled = raw_runs(t).withColumn("lineage_type", normal_label(c("lineage_type")))
    flat = labelled.withColumn("flat", flat_plan(c("plan"))).drop("plan")
    timed = flat.select(
        "*",
        plan_total(c("flat")).alias("plan_runtime"),
        plan_op(c("flat"), plan_prefix(c("op"), c("lineage_type"))).alias("op_runtime"),
        plan_mat(c("flat")).alias("mat_time"),
        query_class(c("query")).alias("qtype"),
    ).drop("flat")
    return with_index_label(with_stats(timed))


# -- averages and baselines -------------------------------------------------------

MEANS = ("runtime", "plan_runtime", "op_runtime", "mat_time")
MAXIMA = ("output", "nchunks", "lineage_size", "lineage_count", "postprocess")
TPCH = ("query", "qtype")
MICRO = ("op", "index_join", "sel")
#: All that a run of a single operator is told apart by.
SETTINGS = ("op", "n1", "n2", "skew", "ncol", "sel", "groups", "index_join", "sf", "n_threads")


def mean(name: str) -> Column:
    """Average of times to the microsecond: the exact sum does not depend on the order of rows."""
    return F.sum(c(name).cast("decimal(20,6)")).cast("double") / F.count(name)


def averaged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "lineage_type").agg(
        *[mean(m).alias(m) for m in MEANS], *[F.max(m).cast("double").alias(m) for m in MAXIMA]
    )


def fill_missing_variant(rows: DataFrame) -> DataFrame:
    """Queries without a decorrelated run reuse their plain run for it."""
    variant = rows.filter(c("lineage_type") == "Logical-OPT").select("query").distinct()
    plain = rows.filter(c("lineage_type") == "Logical-RID").join(variant, "query", "left_anti")
    return rows.unionByName(plain.withColumn("lineage_type", F.lit("Logical-OPT")))


def no_create(prefix: str = "") -> Column:
    return c(f"{prefix}plan_runtime") - c(f"{prefix}mat_time")


def with_baseline(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row next to the baseline row of the same keys."""
    taken = ("plan_runtime", "runtime", "output", "op_runtime", "mat_time")
    base = means.filter(c("lineage_type") == "Baseline").select(
        *[c(k).alias(f"_{k}") for k in keys], *[c(m).alias(f"base_{m}") for m in taken]
    )
    joined = means.join(base, matching([c(k) for k in keys], [c(f"_{k}") for k in keys]))
    return joined.drop(*[f"_{k}" for k in keys]).select(
        "*", no_create("base_").alias("base_plan_no_create"), no_create().alias("plan_no_create")
    )


def per(part: Column, whole: Column) -> Column:
    """part / whole; null where the baseline took no time."""
    return F.when(whole != 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    return per(part, whole) * 100


def overheads(frame: DataFrame, keys: Sequence[str], system: Column, parts: dict[str, tuple[Column, Column]], post: Column) -> DataFrame:
    """Absolute (ms) and relative (%) overheads for each named part."""
    columns = []
    for name, (extra, base) in parts.items():
        columns += [(extra * 1000).alias(f"{name}_overhead"), percent(extra, base).alias(f"{name}_roverhead")]
    return frame.select(
        *keys, system.alias("system"), c("output"), *MAXIMA[1:], post.alias("postprocess_roverhead"), *columns,
        F.coalesce(per(c("output"), c("base_output")), F.lit(0.0)).alias("fanout"),
    )


def overhead_logical(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    plan = c("plan_no_create") - c("base_plan_no_create")
    mat = c("mat_time") - c("base_mat_time")
    whole = c("plan_runtime") - c("base_plan_runtime")
    base, op = c("base_plan_no_create"), c("base_op_runtime")
    parts = {
        "plan_execution": (plan, base), "plan_mat": (mat, base), "plan_all": (whole, base),
        "op_execution": (plan, op), "op_mat": (mat, op), "op_all": (whole, op),
    }
    rows = joined.filter(c("lineage_type").isin(*LOGICAL))
    return overheads(rows, keys, c("lineage_type"), parts, F.lit(0.0))


def overhead_native(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Native capture: time with copying only, with everything, and statistics, side by side."""
    full = joined.filter(c("lineage_type") == "SD_full").drop("nchunks", "lineage_size", "lineage_count", "postprocess")
    copy = joined.filter(c("lineage_type") == "SD_copy").select(
        *[c(k).alias(f"_c_{k}") for k in keys], c("plan_no_create").alias("copy_plan"), c("op_runtime").alias("copy_op")
    )
    stats = joined.filter(c("lineage_type") == "SD_stats").select(*[c(k).alias(f"_s_{k}") for k in keys], *MAXIMA[1:])
    own = [c(k) for k in keys]
    rows = full.join(copy, matching(own, [c(f"_c_{k}") for k in keys])).join(
        stats, matching(own, [c(f"_s_{k}") for k in keys])
    )
    base, op = c("base_plan_no_create"), c("base_op_runtime")
    parts = {
        "plan_execution": (c("copy_plan") - base, base),
        "plan_mat": (c("plan_no_create") - c("copy_plan"), c("copy_plan")),
        "plan_all": (c("plan_no_create") - base, base),
        "op_execution": (c("copy_op") - op, op),
        "op_mat": (c("op_runtime") - c("copy_op"), op),
        "op_all": (c("op_runtime") - op, op),
    }
    return overheads(rows, keys, F.lit("SD"), parts, percent(c("postprocess"), base * 1000))


def overhead_clamped(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    extra = c("runtime") - c("base_runtime")
    return joined.filter(c("lineage_type") != "Baseline").select(
        *keys,
        "lineage_type",
        F.greatest(extra * 1000, F.lit(0.0)).alias("overhead"),
        F.greatest(percent(extra, c("base_runtime")), F.lit(0.0)).alias("roverhead"),
    )


def both_families(t: Tables, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    rows = runs(t)
    if "query" in keys:
        rows = fill_missing_variant(rows)
    joined = with_baseline(averaged(rows, keys), keys)
    return overhead_logical(joined, keys), overhead_native(joined, keys)


def wide_union(t: Tables, keys: Sequence[str]) -> DataFrame:
    logical, native = both_families(t, keys)
    return native.unionByName(logical)


def overhead_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per kind of overhead, none below zero."""
    kinds = (("Total", "plan_all"), ("Materialize", "plan_mat"), ("Execute", "plan_execution"))
    picks = F.array(
        *[
            F.struct(
                F.lit(kind).alias("overhead_type"),
                F.greatest(F.lit(0.0), c(f"{part}_overhead")).alias("overhead"),
                F.greatest(F.lit(0.0), c(f"{part}_roverhead")).alias("roverhead"),
            )
            for kind, part in kinds
        ]
    )
    return wide.select(*keys, "system", "output", F.explode(picks).alias("o")).select(
        *keys, "system", "output", "o.overhead_type", "o.overhead", "o.roverhead"
    )


def class_summary(wide: DataFrame) -> DataFrame:
    names = ("plan_execution", "plan_mat", "plan_all")
    return wide.groupBy("system", "qtype").agg(
        *[F.avg(f"{n}_roverhead").alias(f"{n}_roverhead") for n in names],
        *[F.avg(f"{n}_overhead").alias(f"{n}_overhead") for n in names],
    )


def op_summary(wide: DataFrame) -> DataFrame:
    columns = []
    for name in ("plan_execution", "plan_mat"):
        column = f"{name}_roverhead"
        columns += [
            F.avg(f"{name}_overhead").alias(f"avg_{name}"),
            F.avg(column).alias(f"avg_{column}"),
            F.stddev_pop(column).alias(f"sd_{column}"),
            F.min(column).alias(f"min_{column}"),
            F.max(column).alias(f"max_{column}"),
        ]
    return wide.groupBy("op", "index_join", "system").agg(*columns, F.avg("nchunks").alias("nchunks"))


def op_detail(t: Tables, op: str) -> DataFrame:
    logical, native = both_families(t, MICRO)
    columns = ["system", "index_join", "sel", "plan_all_overhead", "plan_all_roverhead", "fanout"]
    return native.filter(c("op") == op).select(*columns).union(logical.filter(c("op") == op).select(*columns)).distinct()


def speedup(t: Tables) -> DataFrame:
    """How much more logical capture costs than native capture, by operator."""
    logical, native = both_families(t, MICRO)
    kept = ("plan_all_roverhead", "plan_all_overhead")
    other = native.select(*[c(k).alias(f"_{k}") for k in MICRO], *[c(m).alias(f"sd_{m}") for m in kept])
    joined = logical.join(other, matching([c(k) for k in MICRO], [c(f"_{k}") for k in MICRO]))
    means = joined.groupBy("op", "system").agg(
        *[F.avg(f"sd_{m}").alias(f"sd_{m}") for m in kept], *[F.avg(m).alias(m) for m in kept]
    )
    return means.select(
        "*",
        per(c("plan_all_roverhead"), c("sd_plan_all_roverhead")).alias("speedup"),
        per(c("plan_all_overhead"), c("sd_plan_all_overhead")).alias("ospeedup"),
    )


def pairwise_systems(t: Tables) -> DataFrame:
    """Mean run time of native capture next to every other system, query by query."""
    means = averaged(runs(t), TPCH).select("query", "lineage_type", "runtime")
    native = means.filter(c("lineage_type") == "SD_full").select("query", c("runtime").alias("sd"))
    others = means.filter(c("lineage_type") != "SD_full").select(
        c("query").alias("_q"), c("lineage_type").alias("other"), c("runtime").alias("logical")
    )
    return native.join(others, c("query") == c("_q")).drop("_q")


def ablation_union(t: Tables) -> DataFrame:
    """Lookup time without index, with zone maps, with group indexes, and of index building (the mean of five times), in ms."""
    rows = runs(t).filter(c("query").isin(1, 4, 14, 15, 17))
    sources = [("SD_full", "No Indexes"), ("SD_copy", "+Zone Maps"), ("SD_stats", "+Group By Idxs")]
    parts = [
        rows.filter(c("lineage_type") == kind).select(c("query").cast("string").alias("query"), F.lit(name).alias("ablation"), c("runtime").alias("s"))
        for kind, name in sources
    ]
    built = family_rows(t, "postprocess").filter((c("ablation") == -1) & (c("sf") == 1) & c("query_id").isin("1", "4", "14", "15", "17"))
    mean_time = reduce(Column.__add__, [c(f"time_in_sec{k}") for k in range(1, 6)]) / 5.0
    parts.append(built.select("query_id", F.lit("Postprocess").alias("ablation"), mean_time.alias("s")))
    whole = reduce(DataFrame.union, parts)
    return whole.select(F.concat(F.lit("Q"), c("query")).alias("query_id"), "ablation", (c("s") * 1000).alias("ms"))


def net_of_parse(t: Tables) -> DataFrame:
    """Lookups of 1000 ids by operator, without the time that parsing took, in ms."""
    rows = family_rows(t, "per_operator").filter((c("avg_parse_time") != 0) & (c("oids") == 1000))
    names = F.create_map(*[F.lit(x) for op, (name, _) in LOOKED_UP.items() for x in (op, name)])
    kinds = F.create_map(*[F.lit(x) for op, (_, kind) in LOOKED_UP.items() for x in (op, kind)])
    known = rows.filter(c("op") != "parse")
    return known.select(
        names[c("op")].alias("op"), kinds[c("op")].alias("category"), ((c("avg_duration") - c("avg_parse_time")) * 1000).alias("ms")
    )


def phase_costs(t: Tables) -> DataFrame:
    """Per query: cost of capture, post-processing and one lineage question, native and logical."""
    means = averaged(runs(t), ["query"])

    def of(kind: str) -> Column:
        return F.max(F.when(c("lineage_type") == kind, c("runtime")))

    post = F.max(F.when(c("lineage_type") == "SD_stats", c("postprocess")))
    return means.groupBy("query").agg(
        of("SD_full").alias("native_capture"), post.alias("native_post"), of("SD_copy").alias("native_query"),
        of("Logical-RID").alias("logical_capture"), of("Baseline").alias("logical_query"),
    )


def cumulative_cost(t: Tables, questions: int = 5) -> DataFrame:
    """Running total over the queries and their phases (capture, post-process, questions)."""
    steps = [
        ("native", 1, c("native_capture")), ("native", 2, c("native_post")), ("native", 3, c("native_query") * questions),
        ("logical", 1, c("logical_capture")), ("logical", 2, F.lit(0.0)), ("logical", 3, c("logical_query") * questions),
    ]
    listed = F.explode(
        F.array(*[F.struct(F.lit(s).alias("system"), F.lit(p).alias("phase"), v.alias("cost")) for s, p, v in steps])
    )
    rows = phase_costs(t).select("query", listed.alias("x")).select("query", "x.*")
    # three rows per system and query of the workload, far from one task's limit
    running = Window.partitionBy("system").orderBy("query", "phase").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("system", "query", "phase", r6(F.sum("cost").over(running)).alias("total"))


def break_even(t: Tables) -> DataFrame:
    costs = phase_costs(t)
    native = c("native_capture") + c("native_post")
    return costs.select(
        "query", r6(native).alias("native"), r6(c("logical_capture")).alias("logical"), (native > c("logical_capture")).alias("dearer")
    )


def family_rows(t: Tables, family: str) -> DataFrame:
    """The runs as a file of the family has them."""
    ident, value = c("r"), c("runtime")
    text, whole = c("query").cast("string"), c("output")
    values = {
        "queryId": text, "query_id": text, "repeat": ident, "cardinality": whole, "rowCount": whole, "row_count": whole,
        "size": ident % 500, "lineage_size": ident % 500, "base_size": ident % 400, "notes": F.lit("run"), "mode": F.lit("mode"),
        "plan_timings": c("op"), "avg_duration": value, "min": value * 0.5, "max": value * 2, "zipf_a": c("skew"), "num_records": c("n1"),
        "sel": (ident % 5).cast("string"), "oids": _choice(ident % 4, [1, 10, 100, 1000]),
        "avg_parse_time": F.when(ident % 5 > 0, value * 0.1).otherwise(0.0),
        "ablation": F.when(ident % 2 == 0, -1).otherwise(1), **{f"time_in_sec{k}": value + 0.25 * k for k in range(1, 6)},
    }
    if family in ("per_operator", "filter_scaling"):
        values["op"] = _choice(ident % len(LOOKED_UP), list(LOOKED_UP))
    columns = [x.strip().split(" ") for x in FAMILIES[family].split(",")]
    return raw_runs(t).select(*[values.get(name, c(name)).cast(kind).alias(name) for name, kind in columns])


def csv_families(t: Tables) -> DataFrame:
    """Run files of all families with their different headers, one of them appended to, read as one table.

    Every run goes into a file of one family. Whole numbers are text in the result, as families lack columns.
    """
    frames = []
    for number, family in enumerate(FAMILIES):
        path = fresh_path(t.spark, family)
        # families without a run number are dealt by the same rule, before the projection
        mine = family_rows(DealtTables(t, number, len(FAMILIES)), family)
        halves = [mine] if family != "capture_v3" else [mine.filter(c("repeat") % 2 == 0), mine.filter(c("repeat") % 2 == 1)]
        for k, half in enumerate(halves):
            write_csv(half, path, append=k > 0)
        read = read_runs(t.spark, path, family)
        plain = [c(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "long" else c(f.name) for f in read.schema.fields]
        frames.append(read.select(F.lit(family).alias("family"), *plain))
    return union_families(frames)


class DealtTables:
    """The run table's source, one part of `parts` of it."""

    def __init__(self, tables: Tables, part: int, parts: int) -> None:
        self.tables, self.part, self.parts = tables, part, parts

    def raw(self, name: str) -> DataFrame:
        return self.tables.raw(name).filter(c("event_id") % self.parts == self.part)


# -- measures of the captured lineage itself ---------------------------------------

def one_by_one(t: Tables, ask: Callable[[str], DataFrame]) -> DataFrame:
    """The answers to `ask` for all queries, a few rows each: every one is computed and left before the next begins.

    The disks then hold the shuffled and kept rows of one query at a time. In one union of all plans those of every
    query stay until the last has ended.
    """
    rows: list[Row] = []
    kinds: dict[str, T.DataType] = {}
    for q in QUERIES:
        with passing(t.spark), pruned(t.spark):
            found, kinds = answer(ask(q))
            rows += found
    return t.spark.createDataFrame(rows, T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))


def answer(asked: DataFrame) -> tuple[list[Row], dict[str, T.DataType]]:
    return asked.collect(), {f.name: f.dataType for f in asked.schema.fields}


def lineage_stats(t: Tables) -> DataFrame:
    def ask(q: str) -> DataFrame:
        return id_counts(query(q, t).frame()).select(
            F.lit(q).alias("query"), "relation", "rows", "bytes", "distinct_ids",
            (c("bytes").cast("double") / MIB).alias("mib"), F.ceil(c("rows") / 1024).cast("long").alias("chunks"),
        )

    return one_by_one(t, ask)


def fanout(t: Tables) -> DataFrame:
    """Joined lineage rows per output row; 0 for an empty result."""
    parts = []
    unnamed = t.unnamed()
    for q in QUERIES:
        lineage = query(q, unnamed).pinned()
        total = lineage.backward(())
        known = lineage.base_rows
        base = F.lit(known).cast("long") if known is not None else lineage.result().agg(F.count(F.lit(1))).scalar()
        parts.append(total.select(F.lit(q).alias("query"), F.coalesce("n", F.lit(0)).alias("n"), base.alias("base")))
    whole = reduce(DataFrame.unionByName, parts)
    ratio = F.when(c("base") > 0, c("n").cast("double") / c("base")).otherwise(0.0)
    return whole.select("*", ratio.alias("fanout"))


def avg_lineage_size(t: Tables) -> DataFrame:
    largest = one_by_one(t, lambda q: row_counts(query(q, t).frame()).agg(F.max("rows").alias("rows")))
    return largest.agg((F.coalesce(F.sum("rows"), F.lit(0)).cast("double") / len(QUERIES)).alias("avg_rows"))


def trace_by_key(t: Tables) -> DataFrame:
    """Base rows behind the first output of every query, asked for by its key columns: (query, relation, n, last).

    The outputs are found without ids. These are made for the rows of the first output only, and nothing is kept for
    that; factorised lineage reads the same rows in several branches, and keeps them.
    """
    unnamed = t.unnamed()

    def ask(q: str) -> DataFrame:
        keys, several = TRACE_KEYS[q], q in FACTORISED
        lineage = query(q, t, reuse=several)
        found = query(q, unnamed).pinned() if keys and not several else lineage.pinned()
        lineage, wanted = lineage.answered(found), found.wanted(1, keys) if keys else None
        return lineage.traced(keys, wanted, bound=1).select(F.lit(q).alias("query"), "relation", "n", "last")

    return one_by_one(t, ask)


def trace_sample(t: Tables, rows: int | None = 10) -> DataFrame:
    parts = []
    unnamed = t.unnamed()
    for q in QUERIES:
        parts.append(sizes(query(q, unnamed), TRACE_KEYS[q], rows).select(F.lit(q).alias("query"), "*"))
    return reduce(DataFrame.unionByName, parts)


def trace_all(t: Tables) -> DataFrame:
    return trace_sample(t, None)


BASES = {"l": "lineitem", "o": "orders", "c": "customer", "p": "part", "s": "supplier", "ps": "partsupp", "n": "nation", "r": "region"}
#: What must hold between the base rows of a lineage row, by query and branch. Columns of the frame itself are `out_...`.
FETCH = {
    "q03": {"main": "l_orderkey = o_orderkey and o_custkey = c_custkey and out_l_orderkey = l_orderkey"},
    "q04": {"main": "o_orderkey = l_orderkey and l_commitdate < l_receiptdate and out_o_orderpriority = o_orderpriority"},
    "q09": {
        "main": "l_partkey = p_partkey and ps_partkey = l_partkey and ps_suppkey = l_suppkey and s_suppkey = l_suppkey "
        "and s_nationkey = n_nationkey and o_orderkey = l_orderkey and out_nation = n_name"
    },
    "q10": {"main": "l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and out_c_custkey = c_custkey"},
    "q12": {"main": "l_orderkey = o_orderkey and out_l_shipmode = l_shipmode"},
    "q13": {"main": "o_rid is null or c_custkey = o_custkey"},
    "q14": {"main": "l_partkey = p_partkey"},
    "q15": {
        "main": "l_suppkey = s_suppkey and out_s_name = s_name",
        "sub": "sub_l_shipdate >= date '1996-01-01' and sub_l_shipdate < date '1996-04-01'",
    },
    "q16": {
        "main": "ps_partkey = p_partkey and out_p_brand = p_brand",
        "sub": "sub_s_comment like '%Customer%Complaints%'",
    },
    "q17": {"main": "l_partkey = p_partkey and p_brand = 'Brand#23'", "sub": "sub_l_partkey = out_l_partkey"},
    "q18": {
        "main": "l_orderkey = o_orderkey and o_custkey = c_custkey and out_o_orderkey = o_orderkey and out_c_name = c_name",
        "sub": "sub_l_orderkey = out_o_orderkey",
    },
    "q19": {"main": "l_partkey = p_partkey"},
    "q20": {
        "main": "s_suppkey = ps_suppkey and l_suppkey = ps_suppkey and l_partkey = ps_partkey and p_partkey = ps_partkey "
        "and s_nationkey = n_nationkey and out_s_name = s_name"
    },
    "q21": {
        "main": "l_suppkey = s_suppkey and s_nationkey = n_nationkey and l_orderkey = o_orderkey and l_receiptdate > l_commitdate "
        "and out_s_name = s_name",
        "sub": "sub_l_orderkey = out_l_orderkey",
    },
}


def fetched(t: Tables, frame: DataFrame, rids: Sequence[str]) -> DataFrame:
    """Lineage rows with all columns of the base rows that the ids in `rids` name: those of `sub_l_rid` are `sub_l_...`.

    Other columns of the frame are renamed `out_...`.
    """
    rows = frame.select(*[c(x).alias(x if x in rids else f"out_{x}") for x in frame.columns])
    for rid in rids:
        prefix = "sub_" if rid.startswith("sub_") else ""
        short = rid.removeprefix("sub_").removesuffix("_rid")
        base: DataFrame = getattr(t, BASES[short])
        renamed = base.select(*[c(x).alias("_id" if x == f"{short}_rid" else prefix + x) for x in base.columns])
        rows = originals(rows, [(rid, renamed.select("_id", *[x for x in renamed.columns if x != "_id"]), [x for x in renamed.columns if x != "_id"])])
    return rows


def fetch(name: str) -> Job:
    """Traced ids joined back to their base rows: the query's own conditions must hold between them."""

    def job(t: Tables) -> DataFrame:
        lineage = query(name, t)
        frame = lineage.frame()
        subs = [r for sub in lineage.core.subs if not sub.single for r in sub.rids]
        parts = []
        for branch, holds in FETCH[name].items():
            rows = frame.filter(c("branch") == branch) if "branch" in frame.columns else frame
            rids = [x for x in frame.columns if x.endswith("_rid") and (x in subs) == (branch == "sub")]
            checked = agreement(fetched(t, rows, rids), F.expr(holds))
            parts.append(checked.select(F.lit(branch).alias("part"), "*"))
        return reduce(DataFrame.unionByName, parts)

    return job


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c(f.name)).alias(f.name) if f.dataType.typeName() == "double" else c(f.name) for f in df.schema.fields])


def jobs() -> dict[str, Job]:
    def joined(t: Tables, keys: Sequence[str]) -> DataFrame:
        rows = fill_missing_variant(runs(t)) if "query" in keys else runs(t)
        return with_baseline(averaged(rows, keys), keys)

    plain: dict[str, Job] = {
        "runs_label_norm": lambda t: raw_runs(t).select("r", normal_label(c("lineage_type")).alias("lineage_type")),
        "runs_stats_split": lambda t: with_stats(raw_runs(t)).select(
            "r", "lineage_size", "lineage_count", "nchunks", "postprocess"
        ),
        "runs_index_label": lambda t: with_index_label(raw_runs(t)).select("r", "op", "index_scan", "index_join", "sel"),
        "plan_flatten": lambda t: raw_runs(t).select("r", F.explode(flat_plan(c("plan"))).alias("name", "timing")),
        "plan_total": lambda t: raw_runs(t).select("r", plan_total(flat_plan(c("plan"))).alias("total")),
        "plan_op": lambda t: raw_runs(t).select("r", plan_op(flat_plan(c("plan")), plan_prefix(c("op"), c("lineage_type"))).alias("timing")),
        "plan_mat": lambda t: raw_runs(t).select("r", plan_mat(flat_plan(c("plan"))).alias("timing")),
        "query_class": lambda t: raw_runs(t).select("r", "query", query_class(c("query")).alias("qtype")),
        "net_of_parse": net_of_parse,
        "chunk_count": lambda t: raw_runs(t).select("r", (c("output") / 1024).alias("chunks")),
        "fill_missing_variant": lambda t: fill_missing_variant(runs(t)).select("query", "r", "lineage_type", "runtime"),
        "src_csv_runs": csv_families,
        "ablation_union": ablation_union,
        "cumulative_cost": cumulative_cost,
        "break_even": break_even,
        "lineage_stats": lineage_stats,
        "fanout": fanout,
        "avg_lineage_size": avg_lineage_size,
        "trace_by_key": trace_by_key,
        "trace_sample": trace_sample,
        "trace_all": trace_all,
    }
    rounded: dict[str, Job] = {
        "runs_avg": lambda t: averaged(runs(t), SETTINGS),
        "runs_avg_query": lambda t: averaged(runs(t), TPCH),
        "runs_with_baseline": lambda t: joined(t, TPCH),
        "overhead_logical": lambda t: overhead_logical(joined(t, MICRO), MICRO),
        "overhead_native": lambda t: overhead_native(joined(t, MICRO), MICRO),
        "overhead_clamped": lambda t: overhead_clamped(joined(t, TPCH), TPCH),
        "overhead_long": lambda t: overhead_long(wide_union(t, TPCH), TPCH),
        "overhead_wide_union": lambda t: wide_union(t, TPCH),
        "class_summary": lambda t: class_summary(wide_union(t, TPCH)),
        "op_summary": lambda t: op_summary(wide_union(t, MICRO)),
        "op_detail": lambda t: op_detail(t, "HASH_GROUP_BY"),
        "speedup": speedup,
        "pairwise_systems": pairwise_systems,
    }
    found = dict(plain)
    for name, job in rounded.items():
        found[name] = lambda t, job=job: _rounded(job(t))
    for name in FETCH:
        found[f"fetch_{name}"] = fetch(name)
    return found
