"""SQL for the single-operator workloads, generators, edges, lookups and layouts."""

from __future__ import annotations

from oracles.tpch_sql import lineage_sql
from oracles.views import ctes

# Multiplier and increment of each congruential step.
STEPS = ((1103515245, 12345), (1140671485, 12820163), (1103495837, 7919), (1140690005, 104729))
M = 2147483648
SEGMENT = 5000


def u(ident: str, stream: int) -> str:
    (a, b), (p, q) = STEPS[stream % 4], STEPS[(stream + 1) % 4]
    folded = f"((({ident}) % {M} + (({ident}) // {M}) * 69069) % {M})"
    return f"(cast(((({folded} * {a} + {b}) % {M}) * {p} + {q}) % {M} as double) / cast({M} as double))"


def place(ident: str, n: str) -> str:
    return f"((({ident}) * 1000003 + 7919) % {n})"


IDS = "ids as (select event_id as idx from events), n as (select count(*) as n from ids)"
UNIFORM = "select idx, cast(floor({z} * {groups}) as bigint) as z, {v} * 100.0::double as v from ids"


def uniform(groups: int) -> str:
    return UNIFORM.format(z=u("idx", 0), groups=groups, v=u("idx", 2))


def zipf(groups: int, theta: float) -> str:
    return f"""weights as (select range as z, cast(1 as double) / pow(range + 1, {theta}::double) as w from range({groups})),
      upto as (select z, sum(w) over (order by z rows unbounded preceding) / (select sum(w) from weights) as high
               from weights),
      shares as (select z, lag(high, 1, 0.0) over (order by z) as low,
                   case when z = {groups - 1} then 1.0 else high end as high from upto),
      zipf as (select idx, z, {u("idx", 2)} * 100.0::double as v from ids
               join shares on {u("idx", 0)} >= low and {u("idx", 0)} < high)"""


def extra(columns: int, ident: str = "idx") -> str:
    return ", ".join(
        f"cast(floor({u(f'{ident} * 31 + {1009 * (i + 1)}', i)} * 100) as bigint) as col{i}" for i in range(columns)
    )


SELECTIVE = f"""select idx, case when {place("idx", "n")} < cast(floor(n * 0.2) as bigint) then 0
      else cast(floor({u("idx", 1)} * n) as bigint) + 1 end as z, {u("idx", 2)} * 100.0::double as v from ids, n"""


def pieces(key: str, form: str, rid: str = "l_rid", source: str = "lineitem_x") -> str:
    """Ids per group in segments of about SEGMENT ids."""
    part = f"partition by {key}" if key else ""
    keys = f"{key}, " if key else ""
    packed = f"list(i order by i)" if form == "list" else "string_agg(i, ',' order by i)"
    if form == "list":
        packed = f"cast(to_json({packed}) as varchar)"
    return f"""sized as (select {keys}cast({rid} as varchar) as i, count(*) over ({part}) as cnt from {source}),
      cut as (select *, case when cnt > {SEGMENT}
                then cast(('0x' || md5(i)[1:8]) as bigint) % cast(ceil(cnt / {SEGMENT}.0) as bigint) else 0 end as segment
              from sized),
      packed as (select {keys}cnt, segment, {packed} as rids from cut group by all)"""


def w(body: str, tail: str) -> str:
    """WITH clause of the views used, the given expressions, and the final select."""
    views = ctes(body + tail)
    parts = ",\n".join(x for x in (views, body) if x)
    return f"with {parts}\n{tail}" if parts else tail


THETA = "select *, s_nationkey, n_nationkey from supplier_x join nation_x on s_nationkey {op} n_nationkey"
PAIR = "cast(s_rid as varchar) as s_rid, cast(n_rid as varchar) as n_rid, s_suppkey, s_nationkey, n_nationkey"
PKFK = "orders_x join customer_x on o_custkey = c_custkey"
MTM = """customer_x cu join nation_x home on home.n_nationkey = c_nationkey
    join nation_x n on n.n_regionkey = home.n_regionkey"""
SORTED = "select row_number() over (order by o_totalprice desc, o_orderkey) - 1 as out_id, o_rid from orders_x"


def lookups(edges: str) -> str:
    body = f"""edges as ({edges}),
      ranked as (select out_id, row_number() over (order by out_id) as r from (select distinct out_id from edges))"""
    tail = """select s.n as n_ids, count(*) as n_rows from edges join ranked using (out_id)
      join (values (1), (10), (100), (1000)) s(n) on r <= s.n group by all"""
    return w(body, tail)


GROUPED = "select l_partkey as out_id, l_rid as in_id from lineitem_x"
INDEXED = w("", GROUPED + " where l_partkey in (select p_partkey from part order by 1 limit 1000)")
FILTERED = "select l_rid as out_id, l_rid as in_id from lineitem_x where l_quantity < 10"
PKFK_EDGES = f"select o_rid || '|' || c_rid as out_id, o_rid::varchar as lhs_id, c_rid::varchar as rhs_id from {PKFK}"
THETA_EDGES = f"select s_rid || '|' || n_rid as out_id, s_rid::varchar as lhs_id, n_rid::varchar as rhs_id from ({THETA.format(op='<')})"
Q06 = """select 0 as out_id, l_rid as in_id from lineitem_x where year(l_shipdate) = 1996
    and l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24"""
OUTER = "customer_x left join orders_x on o_custkey = c_custkey and o_orderpriority = '1-URGENT'"


def sql() -> dict[str, str]:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    counted = {
        "filter": ("(select count(*) from lineitem where l_quantity < 10)", "lineitem", ""),
        "order_by": ("(select count(*) from orders)", "orders", ""),
        "group_join": ("(select count(*) from lineitem)", "lineitem", ""),
        "theta_lt": ("(select count(*) from supplier, nation where s_nationkey < n_nationkey)", "supplier", "nation"),
        "cross": ("(select count(*) from supplier, region)", "supplier", "region"),
        "pkfk": ("(select count(*) from orders join customer on c_custkey = o_custkey)", "orders", "customer"),
        "mtm": (
            "(select count(*) from customer join nation a on a.n_nationkey = c_nationkey "
            "join nation b on b.n_regionkey = a.n_regionkey)", "customer", "nation",
        ),
    }
    cardinality = " union all ".join(
        f"select '{op}' as op, {n} as n_out, (select count(*) from {a}) as n1, "
        + (f"(select count(*) from {b}) as n2" if b else "1 as n2")
        for op, (n, a, b) in counted.items()
    )
    found = {
        "src_parquet": " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in names),
        "src_csv_micro": w(IDS, f"select *, {extra(2)} from ({uniform(100)})"),
        "sink_ctas": lineage_sql("q03"),
        "sink_csv_pipe": w(IDS, uniform(100)),
        "sink_csv_append": w(IDS, f"{uniform(100)} union all {uniform(100)}"),
        "gen_zipf": w(f"{IDS}, {zipf(1000, 1.0)}", "select * from zipf"),
        "gen_uniform_group": w(IDS, uniform(1000)),
        "gen_selectivity": w(IDS, SELECTIVE),
        "gen_mcopies": w(
            f"{IDS}, twice as (select range * n + idx as i, idx as z from ids, n, range(3))",
            f"select i as idx, z, {u('i', 2)} * 100.0::double as v from twice",
        ),
        "gen_theta_pair": w(
            f"{IDS}, s as (select s_suppkey as idx from supplier), m as (select count(*) as m from s)",
            f"""select 't1' as side, idx as id, case when {place("idx", "m")} < cast(floor(m * 0.2) as bigint)
                  then 2.0::double * m else 10.0::double * m + {u("idx", 1)} * (10.0::double * m) end as v from s, m
                union all
                select 't2', idx, case when {place("idx", "n")} < cast(floor(n * 0.2) as bigint)
                  then 3.0::double * m else {u("idx", 2)} * m end from ids, n, m""",
        ),
        "gen_pk": f"select p_partkey as id, {u('p_partkey', 3)} * 100.0::double as v from part",
        "gen_extra_cols": w(IDS, f"select *, {extra(8)} from ({uniform(100)})"),
        "gen_profile": w(f"{IDS}, {zipf(100, 0.8)}", "select z, count(*) as n from zipf group by all"),
        "rid_scan": w("", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
            cast(o_rid as varchar) as o_rid, cast(o_orderdate as varchar) as o_orderdate,
            cast(o_shippriority as bigint) as o_shippriority, o_comment from orders_x"""),
        "rid_scan_wide": f"""select event_id, user_id, event_type, value, props, cast(event_id as varchar) as e_rid,
            {extra(4, "event_id")} from events""",
        "rid_orderby": w("", "select cast(o_rid as varchar) as o_rid, o_orderpriority, o_orderkey from orders_x"),
        "rid_filter": w("", "select l_rid, l_orderkey, l_quantity, l_returnflag from lineitem_x where l_quantity < 10"),
        "rid_filter_micro": w(
            f"{IDS}, sel as ({SELECTIVE})", "select cast(idx as varchar) as t_rid, z, v from sel where z = 0"
        ),
        "rid_group_join": w("", "select l_suppkey, l_rid, count(*) over (partition by l_suppkey) as cnt from lineitem_x"),
        "rid_group_list": w(pieces("l_suppkey", "list"), "select * from packed"),
        "rid_group_concat": w(pieces("l_suppkey", "text"), "select * from packed"),
        "rid_group_str": w(
            "", "select l_returnflag, l_rid, count(*) over (partition by l_returnflag) as cnt from lineitem_x"
        ),
        "rid_group_str_list": w(pieces("l_returnflag", "list"), "select * from packed"),
        "rid_group_str_concat": w(pieces("l_returnflag", "text"), "select * from packed"),
        "rid_nested_group": w("", """select p_brand, cast(p_rid as varchar) as p_rid, cast(sum(cast(p_retailprice
            as decimal(12,2))) over (partition by p_brand) as double) as total from part_x"""),
        "rid_theta_lt": w("", f"select {PAIR} from ({THETA.format(op='<')})"),
        "rid_theta_or": w("", f"select {PAIR} from ({THETA.format(op='<=')})"),
        "rid_theta_le": w("", f"select {PAIR} from ({THETA.format(op='<=')})"),
        "rid_cross": w("", """select s_suppkey, cast(s_rid as varchar) as s_rid, cast(r_regionkey as bigint) as
            r_regionkey, cast(r_rid as varchar) as r_rid from supplier_x, region_x"""),
        "rid_pkfk": w("", f"""select o_custkey, o_totalprice, cast(o_rid as varchar) as o_rid, c_custkey,
            cast(c_rid as varchar) as c_rid from {PKFK}"""),
        "rid_pkfk_one_side": w("", f"select cast(o_rid as varchar) as o_rid, o_totalprice from {PKFK}"),
        "rid_pkfk_both": w("", f"""select cast(o_rid as varchar) as o_rid, cast(c_rid as varchar) as c_rid,
            o_totalprice, c_custkey from {PKFK}"""),
        "rid_mtm": w("", f"""select cast(home.n_regionkey as bigint) as region, c_acctbal,
            cast(c_rid as varchar) as c_rid, cast(n.n_regionkey as bigint) as n_regionkey, n.n_name,
            cast(n.n_rid as varchar) as n_rid from {MTM}"""),
        "rid_mtm_one_side": w("", f"select cast(c_rid as varchar) as c_rid, c_acctbal from {MTM}"),
        "out_cardinality": "select *, cast(n_out as double) / (cast(n1 as double) * cast(n2 as double)) as selectivity "
        f"from ({cardinality})",
        "edge_scan": w("", "select o_rid as out_id, o_rid as in_id from orders_x"),
        "edge_filter": w("", FILTERED),
        "edge_order": w("", f"select out_id, o_rid as in_id from ({SORTED})"),
        "edge_limit": w("", f"select out_id, o_rid as in_id from ({SORTED}) where out_id < 100"),
        "edge_group": w("", GROUPED),
        "edge_hash_join": w("", PKFK_EDGES),
        "edge_theta_join": w("", THETA_EDGES),
        "edge_outer": w("", f"""select concat_ws('|', cast(c_rid as varchar), cast(o_rid as varchar)) as out_id,
            c_rid::varchar as lhs_id, o_rid::varchar as rhs_id from {OUTER}"""),
        "edge_outer_composed": w("", f"select c_rid as out_id, l_rid from {OUTER} left join lineitem_x on l_orderkey = o_rid"),
        "edge_composed": w("", f"""select o_orderpriority, cast(o_rid as varchar) as o_rid,
            cast(c_rid as varchar) as c_rid from {PKFK} where o_orderdate < date '1996-01-01'"""),
        "edge_global_agg": w("", Q06),
        "edge_scalar_concat": w(
            "sub as (select c_rid from customer_x where c_acctbal > 0 and c_phone[1:2] in "
            "('13', '17', '18', '23', '29', '30', '31')), " + pieces("", "text", "c_rid", "sub"),
            "select 0 as out_id, segment, rids as ids from packed",
        ),
        "lookup_filter": lookups(FILTERED),
        "lookup_orderby": lookups(SORTED),
        "lookup_simpleagg": lookups(Q06),
        "lookup_groupby": lookups(GROUPED),
        "lookup_perfgroupby": lookups(GROUPED.replace("l_partkey", "l_linenumber")),
        "lookup_hashjoin": lookups(PKFK_EDGES),
        "lookup_mergejoin": lookups(PKFK_EDGES),
        "lookup_nljoin": lookups(THETA_EDGES),
        "index_none": INDEXED,
        "index_zone": INDEXED,
        "index_group": INDEXED,
    }
    address = "a as (select c_custkey, dense_rank() over (order by c_custkey) - 1 as address from (select distinct c_custkey from customer))"
    flags = """grouped as (select l_returnflag, l_linestatus, count(*) as cnt from lineitem group by all),
        placed as (select *, row_number() over (order by l_returnflag, l_linestatus) - 1 as address,
          row_number() over (order by cnt desc, l_returnflag, l_linestatus) - 1 as place from grouped)"""
    dense = """lined as (select l_rid, l_suppkey, l_returnflag,
        row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as id from lineitem_x)"""
    found["edge_hash_join_address"] = w(address, """select 'build' as side, address, cast(c_rid as varchar) as id from customer_x join a using (c_custkey)
        union all select 'probe', address, cast(o_rid as varchar) from orders_x join a on o_custkey = c_custkey""")
    found["edge_hash_join_pairs"] = found["edge_hash_join"]
    found["edge_mtm_counts"] = w("", """select n.n_regionkey - (select min(n_regionkey) from nation) as address,
        count(distinct c_rid) as n_probe, count(distinct n.n_rid) as n_build, count(c_rid) as n_pairs
        from nation_x n left join (customer_x join nation_x home on home.n_nationkey = c_nationkey) on home.n_regionkey = n.n_regionkey group by n.n_regionkey""")
    found["edge_group_phases"] = w(flags, """select 0 as phase, address as out_id, l_rid as in_id from lineitem_x join placed using (l_returnflag, l_linestatus)
        union all select 1, place, cast(address as varchar) from placed""")
    found["edge_group_through"] = w(flags, "select place as out_id, l_rid as in_id from lineitem_x join placed using (l_returnflag, l_linestatus)")
    found["edge_full_outer"] = w("", f"""select u.out_id, x.l_rid from (select c_rid::varchar as out_id, o_rid from {OUTER}) u
        full join (select l_orderkey, l_rid from lineitem_x where l_quantity > 40) x on u.o_rid = x.l_orderkey""")
    thetas = []
    for theta in (0.0, 0.5, 0.8, 1.0):
        rows = w(f"{IDS}, {zipf(100, theta)}", "select z, count(*) as n from zipf group by z")
        thetas.append(f"select cast({theta} as double) as theta, cast(sum(2 * n) as bigint) as n_edges, cast(sum(n * n) as bigint) as n_pairs from ({rows})")
    found["rid_mtm_skewed"] = " union all ".join(thetas)
    found["rid_mtm_chosen"] = w("", f"""select c_rid || '|' || n.n_rid as out_id, c_rid::varchar as lhs_id, n.n_rid::varchar as rhs_id from {MTM}
        where c_custkey in (select c_custkey from customer order by 1 limit 10)""")
    found["rid_group_bitmap"] = w(dense, "select l_suppkey, id // 32768 + 1 as bucket, count(*) as cnt, 4096 as bytes from lined group by all")
    found["rid_group_bitmap_rows"] = w("", "select l_suppkey, l_rid from lineitem_x")
    found["rid_group_bitmap_union"] = """select s_nationkey, count(*) as cnt, count(*) filter (where l_returnflag = 'R') as returned
        from lineitem join supplier on l_suppkey = s_suppkey group by all"""
    found["index_bucket"] = INDEXED
    found["rid_distinct"] = w("", "select l_shipmode, l_returnflag, l_rid from lineitem_x")
    found["rid_filter_late"] = found["rid_filter"]
    found["rid_group_window"] = found["rid_group_join"]
    return found
