"""SQL for the analysis of run tables and for measures of captured lineage."""

from __future__ import annotations

from collections.abc import Sequence

from oracles.views import ctes
from oracles.tpch_sql import SPECS, _joined, _with, backward_sql, lineage_sql

RAW = """raw as (
  select user_id % 22 + 1 as query,
         ['SEQ_SCAN', 'FILTER', 'ORDER_BY', 'HASH_GROUP_BY', 'HASH_JOIN', 'INDEX_JOIN_mtm'][user_id % 6 + 1] as op,
         event_id as r, value as runtime,
         case event_type when 'view' then 'Baseline' when 'signup' then 'SD_full' when 'error' then 'SD_copy'
           when 'purchase' then 'SD_stats'
           else case when event_id % 2 = 0 and user_id % 22 + 1 in (2, 4, 15, 16, 17, 20, 21, 22)
                     then 'Logical-OPT' else 'Logical-RID' end end as lineage_type,
         event_id % 1000 + 1 as output,
         case when event_type = 'purchase' then event_id % 500 else 0 end as lineage_size,
         case when event_type = 'purchase' then event_id % 700 else 0 end as lineage_count,
         case when event_type = 'purchase' then event_id % 9 else 0 end as nchunks,
         case when event_type = 'purchase' and event_id % 2 = 0 then event_id % 40 else 0 end as postprocess,
         event_id % 2 = 0 as flag,
         case when event_id % 5 > 0 then (event_id % 5) / 5.0::double end as share,
         ((value * 0.1::double) + value * 0.6::double) + value * 0.3::double as plan_runtime,
         value * 0.6::double as op_runtime, value * 0.1::double as mat_time,
         1000 * (event_id % 3 + 1) as n1, 100 * (event_id % 2 + 1) as n2, (event_id % 3) * 0.5::double as skew,
         event_id % 2 + 1 as ncol, event_id % 7 + 1 as groups, cast(event_id % 2 + 1 as double) as sf, event_id % 4 + 1 as n_threads
  from events),
labelled as (
  select * exclude (flag, share),
         op in ('HASH_JOIN', 'INDEX_JOIN_mtm') as is_join,
         cast(is_join and flag as bigint) as index_scan,
         case when op = 'INDEX_JOIN_mtm' then case when flag then 'Q_P' else 'Q_P,F' end else '-' end as index_join,
         case when is_join then -1.0::double else coalesce(share, -1.0::double) end as sel,
         case when query in (1, 3, 5, 6, 7, 8, 9, 10, 12, 13, 14, 19) then '1. Joins-Aggregations'
              when query in (11, 15, 16, 18) then '2. Uncorrelated subQs' else '3. Correlated subQs' end as qtype
  from raw)"""
FILLED = """filled as (
  select * from labelled union all
  select * replace ('Logical-OPT' as lineage_type) from labelled
  where lineage_type = 'Logical-RID' and query not in (select query from labelled where lineage_type = 'Logical-OPT'))"""

MAXIMA = ("output", "nchunks", "lineage_size", "lineage_count", "postprocess")
MEANS = ("runtime", "plan_runtime", "op_runtime", "mat_time")
TPCH = ("query", "qtype")
MICRO = ("op", "index_join", "sel")
SETTINGS = ("op", "n1", "n2", "skew", "ncol", "sel", "groups", "index_join", "sf", "n_threads")
# name -> (how it is shown, its kind)
LOOKED_UP = [
    ("parse", "Parse", "misc"), ("filter", "Filter", "misc"), ("orderby", "Order By", "misc"), ("simpleagg", "Simple Agg", "agg"),
    ("groupby", "Group By", "agg"), ("perfgroupby", "Perfect GrpBy", "agg"), ("nljoin", "NL Join", "Join"),
    ("mergejoin", "Merge Join", "Join"), ("hashjoin", "Hash Join", "Join"),
]
OIDS = "[1, 10, 100, 1000][r % 4 + 1]"
PARSE = "case when r % 5 > 0 then runtime * 0.1::double else 0.0::double end"
LOOKED_OP = f"[{', '.join(repr(op) for op, _, _ in LOOKED_UP)}][r % 9 + 1]"
# The spelling of labels and statistics in the files.
SPELLED = """case e.event_type when 'view' then 'Baseline' when 'signup' then case when r % 2 = 0 then 'SD_Capture' else 'SD_full' end
  when 'error' then 'SD_copy' when 'purchase' then 'SD_stats'
  else case when lineage_type = 'Logical-OPT' then 'Logical-OPT' when r % 3 = 0 then 'Perm' else 'Logical-RID' end end"""
STATS = """case when e.event_type = 'purchase' then concat_ws(',', (r % 500)::varchar, (r % 700)::varchar, (r % 9)::varchar,
  case when r % 2 = 0 then (r % 40)::varchar end) end"""
# Columns of each family of run files: whole numbers as text, times as numbers.
WHOLE = {
    "r": "r", "repeat": "r", "cardinality": "output", "output": "output", "rowCount": "output", "n1": "n1", "n2": "n2", "ncol": "ncol",
    "n_threads": "n_threads", "size": "r % 500", "lineage_size": "r % 500", "base_size": "r % 400", "num_records": "n1", "oids": OIDS,
    "ablation": "case when r % 2 = 0 then -1 else 1 end", "groups": "groups", "query": "query", "queryId": "query", "query_id": "query",
    "sel": "r % 5",
}
OTHER = {
    "runtime": "runtime", "sf": "sf", "skew": "skew", "min": "runtime * 0.5::double", "max": "runtime * 2::double", "avg_duration": "runtime",
    "row_count": "output::double", "zipf_a": "skew", "avg_parse_time": PARSE, "stats": STATS, "lineage_type": SPELLED, "notes": "'run'",
    "mode": "'mode'", "plan_timings": "op", "index_scan": "case when flag then 'True' else 'False' end",
    **{f"time_in_sec{k}": f"runtime + {0.25 * k}::double" for k in range(1, 6)},
}
FAMILIES = {
    "micro_old": "query runtime cardinality groups output stats lineage_type notes",
    "micro": "r query runtime n1 n2 sel skew ncol groups index_scan output stats lineage_type notes plan_timings",
    "capture_v1": "query runtime sf repeat lineage_type n_threads size notes",
    "capture_v2": "query runtime sf repeat lineage_type n_threads output stats notes",
    "capture_v3": "query runtime sf repeat lineage_type n_threads output stats notes plan_timings",
    "backward": "query runtime min max sf repeat lineage_type n_threads lineage_size base_size",
    "per_query": "queryId sf mode avg_duration rowCount",
    "per_operator": "op avg_duration row_count zipf_a num_records groups oids avg_parse_time",
    "filter_scaling": "op avg_duration row_count zipf_a num_records groups oids",
    "postprocess": "query_id sf ablation time_in_sec1 time_in_sec2 time_in_sec3 time_in_sec4 time_in_sec5",
}


def family_sql(number: int, family: str) -> str:
    columns = []
    for name in FAMILIES[family].split():
        value = f"cast({WHOLE[name]} as varchar)" if name in WHOLE else LOOKED_OP if name == "op" else OTHER[name]
        columns.append(f'{value} as "{name}"')
    return f"select '{family}' as family, {', '.join(columns)} from raw join events e on e.event_id = r where r % 10 = {number}"


def r6(expression: str, name: str = "") -> str:
    return f"round({expression}, 6)" + (f" as {name}" if name else "")


def means(keys: Sequence[str], source: str) -> str:
    columns = [f"cast(sum(cast({m} as decimal(20,6))) as double) / count({m}) as {m}" for m in MEANS] + [f"cast(max({m}) as double) as {m}" for m in MAXIMA]
    return f"means as (select {', '.join(keys)}, lineage_type, {', '.join(columns)} from {source} group by all)"


def based(keys: Sequence[str]) -> str:
    on = " and ".join(f"m.{k} = b.{k}" for k in keys)
    return f"""based as (
      select m.*, b.plan_runtime as base_plan_runtime, b.runtime as base_runtime, b.output as base_output,
             b.op_runtime as base_op_runtime, b.mat_time as base_mat_time,
             b.plan_runtime - b.mat_time as base_plan_no_create, m.plan_runtime - m.mat_time as plan_no_create
      from means m join (select * from means where lineage_type = 'Baseline') b on {on})"""


def chain(keys: Sequence[str]) -> str:
    if "query" in keys:
        return ",\n".join([RAW, FILLED, means(keys, "filled"), based(keys)])
    return ",\n".join([RAW, means(keys, "labelled"), based(keys)])


def pct(part: str, whole: str) -> str:
    return f"case when {whole} <> 0 then ({part}) / ({whole}) end * 100"


def metrics(parts: dict[str, tuple[str, str]]) -> str:
    return ", ".join(
        f"({extra}) * 1000 as {name}_overhead, {pct(extra, base)} as {name}_roverhead"
        for name, (extra, base) in parts.items()
    )


def logical(keys: Sequence[str]) -> str:
    run, mat, whole = "plan_no_create - base_plan_no_create", "mat_time - base_mat_time", "plan_runtime - base_plan_runtime"
    base, op = "base_plan_no_create", "base_op_runtime"
    parts = {
        "plan_execution": (run, base), "plan_mat": (mat, base), "plan_all": (whole, base),
        "op_execution": (run, op), "op_mat": (mat, op), "op_all": (whole, op),
    }
    return f"""logical as (select {', '.join(keys)}, lineage_type as system, {', '.join(MAXIMA)},
      0.0::double as postprocess_roverhead, {metrics(parts)},
      case when base_output <> 0 then output / base_output else 0.0 end as fanout
      from based where lineage_type like 'Logical-%')"""


def native(keys: Sequence[str]) -> str:
    def on(other: str) -> str:
        return " and ".join(f"f.{k} = {other}.{k}" for k in keys)

    full, copy = "f.plan_no_create", "k.plan_no_create"
    base, op = "f.base_plan_no_create", "f.base_op_runtime"
    parts = {
        "plan_execution": (f"{copy} - {base}", base), "plan_mat": (f"{full} - {copy}", copy),
        "plan_all": (f"{full} - {base}", base), "op_execution": (f"k.op_runtime - {op}", op),
        "op_mat": ("f.op_runtime - k.op_runtime", op), "op_all": (f"f.op_runtime - {op}", op),
    }
    return f"""native as (select {', '.join('f.' + k for k in keys)}, 'SD' as system, f.output,
      {', '.join('s.' + m for m in MAXIMA[1:])},
      {pct('s.postprocess', f'{base} * 1000')} as postprocess_roverhead, {metrics(parts)},
      case when f.base_output <> 0 then f.output / f.base_output else 0.0 end as fanout
      from (select * from based where lineage_type = 'SD_full') f
      join (select * from based where lineage_type = 'SD_copy') k on {on('k')}
      join (select * from based where lineage_type = 'SD_stats') s on {on('s')})"""


KINDS = ("plan_execution", "plan_mat", "plan_all", "op_execution", "op_mat", "op_all")
VALUES = [*MAXIMA, "postprocess_roverhead", *[f"{k}_{o}" for k in KINDS for o in ("overhead", "roverhead")], "fanout"]


def rounded(keys: Sequence[str], names: Sequence[str], source: str) -> str:
    """`sel` is a rounded measure too; other keys stay as they are."""
    columns = [r6(k, k) if k == "sel" else k for k in keys] + [r6(n, n) for n in names]
    return f"select {', '.join(columns)} from {source}"


def stats_sql(names: Sequence[str]) -> str:
    """Rows, bytes and distinct ids of each id column of each query's lineage."""
    parts = []
    for name in names:
        for rid in [*SPECS[name].rids, *SPECS[name].sub_rids]:
            parts.append(
                f"select '{name}' as query, '{rid}' as relation, count({rid}) as rows, cast(sum(length({rid})) as bigint) as bytes, "
                f"count(distinct {rid}) as distinct_ids from ({lineage_sql(name)})"
            )
    return " union all ".join(parts)


def counts_sql(name: str) -> str:
    spec = SPECS[name]
    return f"""select '{name}' as query, count(*) as n, (select count(*) from ({_with(spec)} select * from ranked)) as base
      from ({_with(spec)} select 1 as one from {_joined(spec)})"""


def sample_sql(name: str, rows: int) -> str:
    return f"""select '{name}' as query, count(*) as outputs, coalesce(min(n), 0) as min_n, coalesce(max(n), 0) as max_n,
      coalesce(cast(sum(n) as double) / count(*), 0.0) as avg_n from ({backward_sql(name, rows)})"""


def traced_sql(name: str) -> str:
    """Distinct base rows of each relation behind the first output in key order (without keys: behind all)."""
    spec = SPECS[name]
    keys = ", ".join(spec.trace)
    chosen = f"main semi join (select {keys} from ranked order by {keys} limit 1) w using ({keys})" if spec.trace else "main"
    parts = [(r, chosen) for r in spec.rids]
    if spec.sub:
        link = ", ".join(spec.link)
        parts += [(r, f"sub where ({link}) in (select ({link}) from {chosen})" if spec.link else "sub") for r in spec.sub_rids]
    rows = " union all ".join(
        f"select '{name}' as query, '{r}' as relation, count(distinct {r}) as n, cast(max({r}) as varchar) as last from {source}"
        for r, source in parts
    )
    return f"select * from ({_with(spec)} {rows})"


TABLE_OF = {"l": "lineitem_x", "o": "orders_x", "c": "customer_x", "p": "part_x", "s": "supplier_x", "ps": "partsupp_x", "n": "nation_x", "r": "region_x"}
FETCHED = {
    "q03": {"main": "l_orderkey = o_orderkey and o_custkey = c_custkey and out_l_orderkey = l_orderkey"},
    "q04": {"main": "o_orderkey = l_orderkey and l_receiptdate > l_commitdate and o_orderpriority = out_o_orderpriority"},
    "q09": {"main": "p_partkey = l_partkey and (ps_partkey, ps_suppkey) = (l_partkey, l_suppkey) and s_suppkey = l_suppkey "
            "and n_nationkey = s_nationkey and o_orderkey = l_orderkey and n_name = out_nation"},
    "q10": {"main": "l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and c_custkey = out_c_custkey"},
    "q12": {"main": "l_orderkey = o_orderkey and l_shipmode = out_l_shipmode"},
    "q13": {"main": "f.o_rid is null or c_custkey = o_custkey"},
    "q14": {"main": "p_partkey = l_partkey"},
    "q15": {"main": "l_suppkey = s_suppkey and s_name = out_s_name", "sub": "sub_l_shipdate between date '1996-01-01' and date '1996-03-31'"},
    "q16": {"main": "ps_partkey = p_partkey and p_brand = out_p_brand", "sub": "sub_s_comment like '%Customer%Complaints%'"},
    "q17": {"main": "p_partkey = l_partkey and p_brand = 'Brand#23'", "sub": "sub_l_partkey = out_l_partkey::bigint"},
    "q18": {"main": "l_orderkey = o_orderkey and o_custkey = c_custkey and o_orderkey = out_o_orderkey::bigint and c_name = out_c_name",
            "sub": "sub_l_orderkey = out_o_orderkey::bigint"},
    "q19": {"main": "p_partkey = l_partkey"},
    "q20": {"main": "s_suppkey = ps_suppkey and l_suppkey = s_suppkey and l_partkey = ps_partkey and p_partkey = l_partkey "
            "and s_nationkey = n_nationkey and s_name = out_s_name"},
    "q21": {"main": "l_suppkey = s_suppkey and s_nationkey = n_nationkey and l_orderkey = o_orderkey and l_receiptdate > l_commitdate "
            "and s_name = out_s_name", "sub": "sub_l_orderkey = out_l_orderkey::bigint"},
}


def fetch_sql(name: str) -> str:
    """Lineage rows joined to the base rows that their ids name, and how often the conditions hold between these."""
    spec = SPECS[name]
    parts = []
    for branch, holds in FETCHED[name].items():
        rids = spec.rids if branch == "main" else spec.sub_rids
        others = [x for x in dict.fromkeys([*spec.outputs, *spec.link]) if branch == "main" or x in spec.link]
        where = f" where branch = '{branch}'" if spec.sub else ""
        source = f"(select {', '.join([*rids, *[f'{x} as out_{x}' for x in others]])} from frame{where}) f"
        for rid in rids:
            short = rid.removeprefix("sub_").removesuffix("_rid")
            prefix = "sub_" if rid.startswith("sub_") else ""
            base = f"(select cast({short}_rid as varchar) as {rid}_key, columns('(.*)') as '{prefix}\\1' from {TABLE_OF[short]})"
            source += f" left join {base} b_{rid} on f.{rid} = b_{rid}.{rid}_key"
        parts.append(f"select '{branch}' as part, count(*) as n_rows, count(*) filter (where coalesce({holds}, false)) as n_agree from {source}")
    body = " union all ".join(parts)
    return f"with {ctes(body)}, frame as ({lineage_sql(name)}) {body}"


def sql() -> dict[str, str]:
    raw, both = f"with {RAW}", {}
    for label, keys in (("tpch", TPCH), ("micro", MICRO)):
        both[label] = f"with {chain(keys)},\n{logical(keys)},\n{native(keys)},\nwide as (select * from native union all by name select * from logical)\n"
    measured = tuple(SPECS)
    phases = f"""with {RAW}, {means(["query"], "labelled")},
      costs as (select query, max(runtime) filter (where lineage_type = 'SD_full') as native_capture,
        max(postprocess) filter (where lineage_type = 'SD_stats') as native_post,
        max(runtime) filter (where lineage_type = 'SD_copy') as native_query,
        max(runtime) filter (where lineage_type = 'Logical-RID') as logical_capture,
        max(runtime) filter (where lineage_type = 'Baseline') as logical_query from means group by all)"""
    long = ", ".join(
        f"('{kind}', greatest(0.0, {part}_overhead), greatest(0.0, {part}_roverhead))"
        for kind, part in (("Total", "plan_all"), ("Materialize", "plan_mat"), ("Execute", "plan_execution"))
    )
    summary = ", ".join(
        f"{r6(f'avg({n}_{o})', f'{n}_{o}')}" for n in ("plan_execution", "plan_mat", "plan_all") for o in ("roverhead", "overhead")
    )
    operators = ", ".join(
        f"{r6(f'avg({n}_overhead)', f'avg_{n}')}, {r6(f'avg({n}_roverhead)', f'avg_{n}_roverhead')}, "
        f"{r6(f'stddev_pop({n}_roverhead)', f'sd_{n}_roverhead')}, {r6(f'min({n}_roverhead)', f'min_{n}_roverhead')}, "
        f"{r6(f'max({n}_roverhead)', f'max_{n}_roverhead')}"
        for n in ("plan_execution", "plan_mat")
    )
    detail = "system, index_join, sel, plan_all_overhead, plan_all_roverhead, fanout".split(", ")
    base_columns = ["base_plan_runtime", "base_runtime", "base_output", "base_op_runtime", "base_mat_time", "base_plan_no_create", "plan_no_create"]
    found = {
        "runs_label_norm": f"{raw} select r, lineage_type from raw",
        "runs_stats_split": f"""{raw} select r, lineage_size::double as lineage_size, lineage_count::double as lineage_count,
            nchunks::double as nchunks, postprocess::double as postprocess from raw""",
        "runs_index_label": f"{raw} select r, op, index_scan, index_join, sel from labelled",
        "plan_flatten": f"""{raw} select r, 'CREATE_TABLE_AS0' as name, mat_time as timing from raw union all
            select r, replace(op, '_mtm', '') || '1', op_runtime from raw union all
            select r, 'SEQ_SCAN2', runtime * 0.3::double from raw""",
        "plan_total": f"{raw} select r, plan_runtime as total from raw",
        "plan_op": f"{raw} select r, op_runtime as timing from raw",
        "plan_mat": f"{raw} select r, mat_time as timing from raw",
        "query_class": f"{raw} select r, query, qtype from labelled",
        "net_of_parse": f"""{raw} select n.shown as op, n.kind as category, (runtime - {PARSE}) * 1000 as ms
            from raw join (values {", ".join(map(str, LOOKED_UP))}) n(name, shown, kind) on n.name = {LOOKED_OP}
            where {PARSE} <> 0 and {OIDS} = 1000 and n.name <> 'parse'""",
        "chunk_count": f"{raw} select r, output / 1024 as chunks from raw",
        "fill_missing_variant": f"{raw}, {FILLED} select query, r, lineage_type, runtime from filled",
        "src_csv_runs": f"{raw} " + " union all by name ".join(family_sql(k, family) for k, family in enumerate(FAMILIES)),
        "ablation_union": f"""{raw} select 'Q' || query as query_id,
            case lineage_type when 'SD_full' then 'No Indexes' when 'SD_copy' then '+Zone Maps' else '+Group By Idxs' end as ablation,
            runtime * 1000 as ms from raw where query in (1, 4, 14, 15, 17) and lineage_type in ('SD_full', 'SD_copy', 'SD_stats')
            union all select 'Q' || query, 'Postprocess',
              ({" + ".join(f"(runtime + {0.25 * k}::double)" for k in range(1, 6))}) / 5.0::double * 1000
            from raw where query in (1, 4, 14, 15, 17) and r % 2 = 0 and sf = 1""",
        "cumulative_cost": f"""{phases}, steps as (
              select query, 'native' as system, 1 as phase, native_capture as cost from costs union all
              select query, 'native', 2, native_post from costs union all
              select query, 'native', 3, native_query * 5 from costs union all
              select query, 'logical', 1, logical_capture from costs union all
              select query, 'logical', 2, 0 from costs union all
              select query, 'logical', 3, logical_query * 5 from costs)
            select system, query, phase, {r6("sum(cost) over (partition by system order by query, phase)", "total")} from steps""",
        "break_even": f"""{phases} select query, {r6("native_capture + native_post", "native")},
            {r6("logical_capture", "logical")}, cast(native_capture + native_post > logical_capture as bigint) as dearer from costs""",
        "lineage_stats": f"""select *, bytes::double / 1048576.0::double as mib, cast(ceil(rows / 1024.0) as bigint) as chunks
            from ({stats_sql(measured)}) where rows > 0""",
        "fanout": f"""select *, case when base > 0 then n::double / base else 0.0 end as fanout from
            ({" union all ".join(counts_sql(q) for q in measured)})""",
        "avg_lineage_size": f"""select sum(rows)::double / count(*) as avg_rows from
            (select query, max(rows) as rows from ({stats_sql(measured)}) group by all)""",
        "trace_by_key": " union all ".join(traced_sql(q) for q in measured),
        "trace_sample": " union all ".join(sample_sql(q, 10) for q in measured),
        "trace_all": " union all ".join(sample_sql(q, 1_000_000) for q in measured),
        "runs_avg": f"with {RAW}, {means(SETTINGS, 'labelled')} "
        + rounded([*SETTINGS, "lineage_type"], [*MEANS, *MAXIMA], "means"),
        "runs_avg_query": f"with {RAW}, {means(TPCH, 'labelled')} "
        + rounded([*TPCH, "lineage_type"], [*MEANS, *MAXIMA], "means"),
        "runs_with_baseline": f"with {chain(TPCH)} "
        + rounded([*TPCH, "lineage_type"], [*MEANS, *MAXIMA, *base_columns], "based"),
        "overhead_logical": both["micro"] + rounded([*MICRO, "system"], VALUES, "logical"),
        "overhead_native": both["micro"] + rounded([*MICRO, "system"], VALUES, "native"),
        "overhead_clamped": f"""with {chain(TPCH)} select query, qtype, lineage_type,
            {r6("greatest((runtime - base_runtime) * 1000, 0.0)", "overhead")},
            {r6(f"greatest({pct('runtime - base_runtime', 'base_runtime')}, 0.0)", "roverhead")}
            from based where lineage_type <> 'Baseline'""",
        "overhead_long": both["tpch"] + f"""select query, qtype, system, {r6("output", "output")}, x.t as overhead_type,
            {r6("x.o", "overhead")}, {r6("x.p", "roverhead")} from wide, lateral (select * from (values {long}) v(t, o, p)) x""",
        "overhead_wide_union": both["tpch"] + rounded([*TPCH, "system"], VALUES, "wide"),
        "class_summary": both["tpch"] + f"select system, qtype, {summary} from wide group by all",
        "op_summary": both["micro"]
        + f"select op, index_join, system, {operators}, {r6('avg(nchunks)', 'nchunks')} from wide group by all",
        "op_detail": both["micro"] + rounded(detail[:2], detail[2:], f"(select distinct {', '.join(detail)} from wide where op = 'HASH_GROUP_BY')"),
        "speedup": both["micro"] + f"""select op, system, {r6("sr", "sd_plan_all_roverhead")}, {r6("so", "sd_plan_all_overhead")},
            {r6("lr", "plan_all_roverhead")}, {r6("lo", "plan_all_overhead")},
            {r6("case when sr <> 0 then lr / sr end", "speedup")}, {r6("case when so <> 0 then lo / so end", "ospeedup")}
            from (select op, l.system, avg(n.plan_all_roverhead) as sr, avg(n.plan_all_overhead) as so,
                    avg(l.plan_all_roverhead) as lr, avg(l.plan_all_overhead) as lo
                  from logical l join native n using (op, index_join, sel) group by all)""",
        "pairwise_systems": f"""with {RAW}, {means(TPCH, 'labelled')}
            select a.query, {r6("a.runtime", "sd")}, b.lineage_type as other, {r6("b.runtime", "logical")}
            from means a join means b on a.query = b.query and a.lineage_type <> b.lineage_type
            where a.lineage_type = 'SD_full'""",
    }
    for name in FETCHED:
        found[f"fetch_{name}"] = fetch_sql(name)
    return found
