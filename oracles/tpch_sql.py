"""The 22 queries and their lineage in plain SQL, written apart from the Spark plans.

Each entry gives `core` (the joined rows with ids and group keys), `base` (the
outputs, before the limit) and, for subqueries, `sub` (the rows the subquery
looked at). All further oracles are put together from these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from oracles.views import ctes


@dataclass(frozen=True)
class Spec:
    outputs: dict[str, str]  # name -> s(tring) i(nteger) f(loat) d(ate)
    core: str
    base: str
    rids: list[str]
    keys: list[str] = field(default_factory=list)
    order: str = ""
    limit: int | None = None
    extra: str = ""
    sub: str = ""
    link: list[str] = field(default_factory=list)
    sub_rids: list[str] = field(default_factory=list)
    trace: list[str] = field(default_factory=list)


SPECS: dict[str, Spec] = {}

SPECS["q01"] = Spec(
    outputs={
        "l_returnflag": "s", "l_linestatus": "s", "sum_qty": "f", "sum_base_price": "f", "sum_disc_price": "f",
        "sum_charge": "f", "avg_qty": "f", "avg_price": "f", "avg_disc": "f", "count_order": "i",
    },
    core="select * from lineitem_x where l_shipdate < date '1998-09-03'",
    base="""
        select l_returnflag, l_linestatus, sum(qty) as sum_qty, sum(price) as sum_base_price,
               sum(net) as sum_disc_price, sum(net * (1 + cast(l_tax as decimal(4,2)))) as sum_charge,
               cast(sum(qty) as double) / count(*) as avg_qty, cast(sum(price) as double) / count(*) as avg_price,
               cast(sum(disc) as double) / count(*) as avg_disc, count(*) as count_order
        from core group by all""",
    rids=["l_rid"], keys=["l_returnflag", "l_linestatus"], order="l_returnflag, l_linestatus",
    trace=["l_returnflag", "l_linestatus"],
)

SPECS["q02"] = Spec(
    outputs={
        "s_acctbal": "f", "s_name": "s", "n_name": "s", "p_partkey": "i", "p_mfgr": "s", "s_address": "s",
        "s_phone": "s", "s_comment": "s",
    },
    extra="""offers as (
        select * from part_x
        join partsupp_x on ps_partkey = p_partkey
        join supplier_x on s_suppkey = ps_suppkey
        join nation_x on n_nationkey = s_nationkey
        join region_x on r_regionkey = n_regionkey
        where r_name = 'EUROPE' and p_size = 15 and p_type like '%Y')""",
    core="""select * from offers o
        where ps_supplycost = (select min(i.ps_supplycost) from offers i where i.p_partkey = o.p_partkey)""",
    base="select * from core",
    rids=["p_rid", "s_rid", "ps_rid", "n_rid", "r_rid"], keys=["p_partkey", "s_name"],
    order="s_acctbal desc, n_name, s_name, p_partkey", limit=100,
    sub="select p_partkey, ps_rid as sub_ps_rid, s_rid as sub_s_rid, n_rid as sub_n_rid, r_rid as sub_r_rid from offers",
    link=["p_partkey"], sub_rids=["sub_ps_rid", "sub_s_rid", "sub_n_rid", "sub_r_rid"],
    trace=["s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment"],
)

SPECS["q03"] = Spec(
    outputs={"l_orderkey": "i", "revenue": "f", "o_orderdate": "d", "o_shippriority": "i"},
    core="""select * from lineitem_x join orders_x on o_orderkey = l_orderkey
        join customer_x on c_custkey = o_custkey
        where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'""",
    base="select l_orderkey, o_orderdate, o_shippriority, sum(net) as revenue from core group by all",
    rids=["l_rid", "o_rid", "c_rid"], keys=["l_orderkey"], order="revenue desc, o_orderdate, l_orderkey", limit=10,
    trace=["l_orderkey", "o_orderdate", "o_shippriority"],
)

SPECS["q04"] = Spec(
    outputs={"o_orderpriority": "s", "order_count": "i"},
    extra="""quarter as (select * from orders_x
        where o_orderdate >= date '1997-07-01' and o_orderdate < date '1997-10-01')""",
    core="select * from quarter join lineitem_x on l_orderkey = o_orderkey where l_receiptdate > l_commitdate",
    base="""select o_orderpriority, count(*) as order_count from quarter
        where exists (select 1 from lineitem_x where l_orderkey = o_orderkey and l_commitdate < l_receiptdate)
        group by all""",
    rids=["o_rid", "l_rid"], keys=["o_orderpriority"], order="o_orderpriority", trace=["o_orderpriority"],
)

SPECS["q05"] = Spec(
    outputs={"n_name": "s", "revenue": "f"},
    core="""select * from region_x join nation_x on n_regionkey = r_regionkey
        join supplier_x on s_nationkey = n_nationkey
        join lineitem_x on l_suppkey = s_suppkey
        join orders_x on o_orderkey = l_orderkey
        join customer_x on c_custkey = o_custkey and c_nationkey = s_nationkey
        where r_name = 'ASIA' and year(o_orderdate) = 1996""",
    base="select n_name, sum(net) as revenue from core group by all",
    rids=["l_rid", "s_rid", "n_rid", "r_rid", "o_rid", "c_rid"], keys=["n_name"],
    order="revenue desc, n_name", trace=["n_name"],
)

SPECS["q06"] = Spec(
    outputs={"revenue": "f"},
    core="""select * from lineitem_x where year(l_shipdate) = 1996
        and l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24""",
    base="select sum(price * disc) as revenue from core",
    rids=["l_rid"],
)

SPECS["q07"] = Spec(
    outputs={"supp_nation": "s", "cust_nation": "s", "l_year": "i", "revenue": "f"},
    core="""select *, a.n_name as supp_nation, b.n_name as cust_nation, year(l_shipdate) as l_year,
               a.n_rid as n1_rid, b.n_rid as n2_rid
        from lineitem_x join supplier_x on s_suppkey = l_suppkey join nation_x a on a.n_nationkey = s_nationkey
        join orders_x on o_orderkey = l_orderkey join customer_x on c_custkey = o_custkey
        join nation_x b on b.n_nationkey = c_nationkey
        where (a.n_name, b.n_name) in (('NATION_3', 'NATION_7'), ('NATION_7', 'NATION_3'))
          and year(l_shipdate) in (1995, 1996)""",
    base="select supp_nation, cust_nation, l_year, sum(net) as revenue from core group by all",
    rids=["l_rid", "s_rid", "n1_rid", "o_rid", "c_rid", "n2_rid"], keys=["supp_nation", "cust_nation", "l_year"],
    order="supp_nation, cust_nation, l_year", trace=["supp_nation", "cust_nation", "l_year"],
)

SPECS["q08"] = Spec(
    outputs={"o_year": "i", "mkt_share": "f"},
    core="""select *, year(o_orderdate) as o_year, sn.n_name as nation, cn.n_rid as n1_rid, sn.n_rid as n2_rid
        from lineitem_x join part_x on p_partkey = l_partkey
        join supplier_x on s_suppkey = l_suppkey join nation_x sn on sn.n_nationkey = s_nationkey
        join orders_x on o_orderkey = l_orderkey join customer_x on c_custkey = o_custkey
        join nation_x cn on cn.n_nationkey = c_nationkey join region_x on r_regionkey = cn.n_regionkey
        where p_type = 'ECONOMY' and r_name = 'AMERICA' and year(o_orderdate) in (1995, 1996)""",
    base="""select o_year, cast(sum(case when nation = 'NATION_3' then net else 0 end) as double)
               / cast(sum(net) as double) as mkt_share
        from core group by all""",
    rids=["l_rid", "p_rid", "o_rid", "c_rid", "n1_rid", "r_rid", "s_rid", "n2_rid"], keys=["o_year"],
    order="o_year", trace=["o_year"],
)

SPECS["q09"] = Spec(
    outputs={"nation": "s", "o_year": "i", "sum_profit": "f"},
    core="""select *, n_name as nation, year(o_orderdate) as o_year
        from lineitem_x join part_x on p_partkey = l_partkey
        join partsupp_x on ps_partkey = l_partkey and ps_suppkey = l_suppkey
        join supplier_x on s_suppkey = l_suppkey join nation_x on n_nationkey = s_nationkey
        join orders_x on o_orderkey = l_orderkey
        where p_name like '%ring%'""",
    base="select nation, o_year, sum(net - ps_supplycost * qty) as sum_profit from core group by all",
    rids=["l_rid", "p_rid", "ps_rid", "s_rid", "n_rid", "o_rid"], keys=["nation", "o_year"],
    order="nation, o_year desc", trace=["nation", "o_year"],
)

SPECS["q10"] = Spec(
    outputs={
        "c_custkey": "i", "c_name": "s", "revenue": "f", "c_acctbal": "f", "n_name": "s", "c_address": "s",
        "c_phone": "s", "c_comment": "s",
    },
    core="""select * from lineitem_x join orders_x on o_orderkey = l_orderkey
        join customer_x on c_custkey = o_custkey join nation_x on n_nationkey = c_nationkey
        where l_returnflag = 'R' and o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01'""",
    base="""select c_custkey, c_name, c_acctbal, n_name, c_address, c_phone, c_comment, sum(net) as revenue
        from core group by all""",
    rids=["l_rid", "o_rid", "c_rid", "n_rid"], keys=["c_custkey"], order="revenue desc, c_custkey", limit=20,
    trace=["c_custkey", "c_name", "c_acctbal", "c_address", "c_phone", "c_comment"],
)

SPECS["q11"] = Spec(
    outputs={"ps_partkey": "i", "value": "f"},
    core="""select *, ps_supplycost * cast(ps_availqty as decimal(12,0)) as worth
        from partsupp_x join supplier_x on s_suppkey = ps_suppkey join nation_x on n_nationkey = s_nationkey
        where n_name = 'NATION_3'""",
    base="""select ps_partkey, cast(sum(worth) as double) as value from core group by all
        having cast(sum(worth) as double) > (select cast(sum(worth) as double) * cast(0.002 as double) from core)""",
    rids=["ps_rid", "s_rid", "n_rid"], keys=["ps_partkey"], order="value desc, ps_partkey", trace=["ps_partkey"],
    sub="select ps_rid as sub_ps_rid, s_rid as sub_s_rid, n_rid as sub_n_rid from core",
    sub_rids=["sub_ps_rid", "sub_s_rid", "sub_n_rid"],
)

SPECS["q12"] = Spec(
    outputs={"l_shipmode": "s", "high_line_count": "i", "low_line_count": "i"},
    core="""select * from orders_x join lineitem_x on l_orderkey = o_orderkey
        where l_shipmode in ('MAIL', 'SHIP') and l_shipdate < l_commitdate and l_commitdate < l_receiptdate
          and year(l_receiptdate) = 1996""",
    base="""select l_shipmode, count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as high_line_count,
               count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH')) as low_line_count
        from core group by all""",
    rids=["l_rid", "o_rid"], keys=["l_shipmode"], order="l_shipmode", trace=["l_shipmode"],
)

SPECS["q13"] = Spec(
    outputs={"c_count": "i", "custdist": "i"},
    core="""select c_custkey, c_rid, o_rid, count(o_orderkey) over (partition by c_custkey) as c_count
        from customer_x left join orders_x
          on o_custkey = c_custkey and o_comment not like '%special%requests%'""",
    base="select c_count, count(distinct c_custkey) as custdist from core group by all",
    rids=["c_rid", "o_rid"], keys=["c_count"], order="custdist desc, c_count desc", trace=["c_count"],
)

SPECS["q14"] = Spec(
    outputs={"promo_revenue": "f"},
    core="""select * from lineitem_x join part_x on p_partkey = l_partkey
        where l_shipdate >= date '1995-09-01' and l_shipdate < date '1995-10-01'""",
    base="""select cast(100.0 as double) * cast(sum(case when p_type like 'PROMO%' then net else 0 end) as double)
               / cast(sum(net) as double) as promo_revenue from core""",
    rids=["l_rid", "p_rid"],
)

SPECS["q15"] = Spec(
    outputs={"s_suppkey": "i", "s_name": "s", "s_address": "s", "s_phone": "s", "total_revenue": "f"},
    extra="""quarter as (select * from lineitem_x
        where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01'),
      totals as (select l_suppkey, sum(net) as total from quarter group by all)""",
    core="select * from quarter join supplier_x on s_suppkey = l_suppkey",
    base="""select s_suppkey, s_name, s_address, s_phone, total as total_revenue
        from supplier_x join totals on l_suppkey = s_suppkey
        where total = (select max(total) from totals)""",
    rids=["s_rid", "l_rid"], keys=["s_suppkey"], order="s_suppkey",
    sub="select l_rid as sub_l_rid from quarter", sub_rids=["sub_l_rid"],
)

SPECS["q16"] = Spec(
    outputs={"p_brand": "s", "p_type": "s", "p_size": "i", "supplier_cnt": "i"},
    extra="unhappy as (select * from supplier_x where s_comment like '%Customer%Complaints%')",
    core="""select * from partsupp_x join part_x on p_partkey = ps_partkey
        where p_brand <> 'Brand#12' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
          and ps_suppkey not in (select s_suppkey from unhappy)""",
    base="select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from core group by all",
    rids=["ps_rid", "p_rid"], keys=["p_brand", "p_type", "p_size"],
    order="supplier_cnt desc, p_brand, p_type, p_size", trace=["p_brand", "p_type", "p_size"],
    sub="select s_rid as sub_s_rid from unhappy", sub_rids=["sub_s_rid"],
)

SPECS["q17"] = Spec(
    outputs={"avg_yearly": "f"},
    extra="""candidates as (select * from lineitem_x join part_x on p_partkey = l_partkey
        where p_brand = 'Brand#23' and p_container = 'MED BOX')""",
    core="""select * from candidates o where l_quantity <
        (select cast(0.2 as double) * avg(l.l_quantity) from lineitem l where l.l_partkey = o.p_partkey)""",
    base="select cast(sum(price) as double) / cast(7.0 as double) as avg_yearly from core",
    rids=["l_rid", "p_rid"],
    sub="select l_partkey, l_rid as sub_l_rid from lineitem_x", link=["l_partkey"], sub_rids=["sub_l_rid"],
)

SPECS["q18"] = Spec(
    outputs={
        "c_name": "s", "c_custkey": "i", "o_orderkey": "i", "o_orderdate": "d", "o_totalprice": "f",
        "sum_l_quantity": "f",
    },
    core="""select * from lineitem_x join orders_x on o_orderkey = l_orderkey join customer_x on c_custkey = o_custkey
        where l_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 300)""",
    base="""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(qty) as sum_l_quantity
        from core group by all""",
    rids=["l_rid", "o_rid", "c_rid"], keys=["o_orderkey"], order="o_totalprice desc, o_orderdate, o_orderkey",
    limit=100, trace=["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"],
    sub="select l_orderkey as o_orderkey, l_rid as sub_l_rid from lineitem_x",
    link=["o_orderkey"], sub_rids=["sub_l_rid"],
)

SPECS["q19"] = Spec(
    outputs={"revenue": "f"},
    core="""select * from lineitem_x join part_x on p_partkey = l_partkey
        where l_shipinstruct = 'DELIVER IN PERSON' and l_shipmode in ('AIR', 'AIR REG') and p_size >= 1
          and case p_brand
                when 'Brand#12' then l_quantity between 1 and 11 and p_size <= 15
                  and p_container in ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG')
                when 'Brand#23' then l_quantity between 10 and 20 and p_size <= 25
                  and p_container in ('MED CASE', 'MED BOX', 'MED PKG', 'MED PACK')
                when 'Brand#4' then l_quantity between 20 and 30 and p_size <= 35
                  and p_container in ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG')
                else false end""",
    base="select sum(net) as revenue from core",
    rids=["l_rid", "p_rid"],
)

SPECS["q20"] = Spec(
    outputs={"s_name": "s", "s_address": "s"},
    extra="""shipped as (select * from lineitem_x where year(l_shipdate) = 1996),
      ample as (select * from partsupp_x ps
        where ps_partkey in (select p_partkey from part where p_name like 'small%')
          and ps_availqty > (select cast(0.5 as double) * sum(l_quantity) from shipped
                             where l_partkey = ps.ps_partkey and l_suppkey = ps.ps_suppkey)),
      local as (select * from supplier_x join nation_x on n_nationkey = s_nationkey where n_name = 'NATION_3')""",
    core="""select * from local join ample on ps_suppkey = s_suppkey join part_x on p_partkey = ps_partkey
        join shipped on l_partkey = ps_partkey and l_suppkey = ps_suppkey""",
    base="select s_name, s_address from local where s_suppkey in (select ps_suppkey from ample)",
    rids=["s_rid", "n_rid", "ps_rid", "p_rid", "l_rid"], keys=["s_name"], order="s_name, s_address",
    trace=["s_name", "s_address"],
)

SPECS["q21"] = Spec(
    outputs={"s_name": "s", "numwait": "i"},
    core="""select * from lineitem_x a join supplier_x on s_suppkey = l_suppkey
        join nation_x on n_nationkey = s_nationkey join orders_x on o_orderkey = l_orderkey
        where n_name = 'NATION_3' and o_orderstatus = 'F' and l_commitdate < l_receiptdate
          and exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)
          and not exists (select 1 from lineitem_x d where d.l_orderkey = a.l_orderkey
                            and d.l_suppkey <> a.l_suppkey and d.l_commitdate < d.l_receiptdate)""",
    base="select s_name, count(*) as numwait from core group by all",
    rids=["l_rid", "s_rid", "n_rid", "o_rid"], keys=["s_name"], order="numwait desc, s_name", limit=100,
    trace=["s_name"],
    sub="""select distinct o.l_orderkey, o.l_rid as sub_l_rid from lineitem_x o
        join core on core.l_orderkey = o.l_orderkey and core.l_suppkey <> o.l_suppkey""",
    link=["l_orderkey"], sub_rids=["sub_l_rid"],
)

SPECS["q22"] = Spec(
    outputs={"cntrycode": "s", "numcust": "i", "totacctbal": "f"},
    extra="""coded as (select *, c_phone[1:2] as cntrycode, cast(c_acctbal as decimal(12,2)) as balance
        from customer_x where c_phone[1:2] in ('13', '17', '18', '23', '29', '30', '31'))""",
    core="""select * from coded
        where c_acctbal > (select cast(sum(balance) as double) / count(*) from coded where c_acctbal > 0)
          and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    base="select cntrycode, count(*) as numcust, sum(balance) as totacctbal from core group by all",
    rids=["c_rid"], keys=["cntrycode"], order="cntrycode", trace=["cntrycode"],
    sub="select c_rid as sub_c_rid from coded where c_acctbal > 0", sub_rids=["sub_c_rid"],
)


def _column(name: str, kind: str, text: bool = False, source: str = "") -> str:
    ref = f"{source}{name}"
    if kind == "d":
        return f"cast({ref} as varchar) as {name}"
    if kind == "i":
        return f"cast({ref} as {'varchar' if text else 'bigint'}) as {name}"
    if kind == "f":
        return f"cast({ref} as double) as {name}"
    return f"{ref} as {name}"


def _with(spec: Spec) -> str:
    order = spec.order or "1"
    limit = f" where out_index < {spec.limit}" if spec.limit else ""
    if spec.keys:
        joined = "join ranked on " + " and ".join(f"core.{k} is not distinct from ranked.{k}" for k in spec.keys)
    else:
        joined = "cross join ranked"
    carried = [f"ranked.{c}" for c in [*spec.outputs, "out_index"]]
    carried += [f"core.{c}" for c in [*spec.link, *spec.rids] if c not in spec.outputs]
    parts = [
        spec.extra,
        f"core as ({spec.core})",
        f"base as ({spec.base})",
        f"""ranked as (select * from (select *, row_number() over (order by {order}) - 1 as out_index from base){limit})""",
        f"main as (select {', '.join(carried)} from core {joined})",
    ]
    if spec.sub:
        keep = ""
        if spec.link:
            key = ", ".join(spec.link)
            keep = f" where ({key}) in (select ({key}) from main)"
        parts.append(f"sub as (select * from ({spec.sub}){keep})")
    body = ",\n".join(p for p in parts if p)
    return f"with {ctes(body)},\n{body}\n"


def base_sql(name: str) -> str:
    spec = SPECS[name]
    columns = ", ".join(_column(c, kind) for c, kind in spec.outputs.items())
    return _with(spec) + f"select {columns} from ranked"


def lineage_sql(name: str, indexed: bool = False) -> str:
    spec = SPECS[name]
    text = bool(spec.sub)
    kinds = {"out_index": "i"} if indexed else dict(spec.outputs)
    types = {"l_partkey": "i", "l_orderkey": "i", "p_partkey": "i", "o_orderkey": "i"}
    for column in spec.link:
        kinds.setdefault(column, types[column])
    main = [_column(c, kind, text) for c, kind in kinds.items()]
    main += [f"cast({r} as varchar) as {r}" for r in spec.rids]
    if not spec.sub:
        return _with(spec) + f"select {', '.join(main)} from main"
    sub = [_column(c, "i", text) for c in spec.link] + [f"cast({r} as varchar) as {r}" for r in spec.sub_rids]
    return _with(spec) + (
        f"select 'main' as branch, {', '.join(main)} from main\n"
        f"union all by name\nselect 'sub' as branch, {', '.join(sub)} from sub"
    )


def long_sql(name: str) -> str:
    """(out_id, branch, relation, rid), one row per id."""
    spec = SPECS[name]

    def ident(columns: list[str]) -> str:
        return "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in columns) + ")" if columns else "'*'"

    parts = [f"select {ident(spec.keys)} as out_id, 'main' as branch, '{r}' as relation, cast({r} as varchar) as rid from main"
             for r in spec.rids]
    parts += [f"select {ident(spec.link)}, 'sub', '{r}', cast({r} as varchar) from sub" for r in spec.sub_rids]
    return _with(spec) + " union all ".join(parts)


def _joined(spec: Spec) -> str:
    """Every main row with every sub row it depends on."""
    if not spec.sub:
        return "main"
    if spec.link:
        return f"main join sub using ({', '.join(spec.link)})"
    return "main cross join sub"


def flat_sql(name: str, rows: int = 10) -> str:
    """Main rows with every sub row they depend on, for the first outputs."""
    spec = SPECS[name]
    columns = [_column(c, kind) for c, kind in spec.outputs.items()]
    columns += [f"cast({r} as varchar) as {r}" for r in [*spec.rids, *spec.sub_rids]]
    keys = ", ".join(spec.trace)
    chosen = f"select {keys} from ranked order by {keys} limit {rows}"
    return _with(spec) + f"select {', '.join(columns)} from {_joined(spec)} semi join ({chosen}) w using ({keys})"


def backward_sql(name: str, rows: int = 10) -> str:
    spec = SPECS[name]
    rids = [*spec.rids, *spec.sub_rids]
    totals = ["count(*) as n", *[f"cast(max({r}) as varchar) as {r}" for r in rids]]
    if not spec.trace:
        return _with(spec) + f"select {', '.join(totals)} from {_joined(spec)}"
    keys = ", ".join(spec.trace)
    columns = [_column(c, spec.outputs[c]) for c in spec.trace]
    chosen = f"select {keys} from ranked order by {keys} limit {rows}"
    return _with(spec) + (
        f"select {', '.join(columns + totals)} from {_joined(spec)} semi join ({chosen}) w using ({keys}) group by {keys}"
    )


#: Filtered inputs of the queries whose operators are compared one by one.
INPUTS = {
    "q03": """lines as (select * from lineitem_x where l_shipdate > date '1998-03-15'),
        placed as (select * from orders_x where o_orderdate < date '1998-03-15'),
        buyers as (select * from customer_x where c_mktsegment = 'BUILDING')""",
    "q06": """lines as (select * from lineitem_x where year(l_shipdate) = 1996
        and l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24)""",
    "q13": "plain as (select * from orders_x where o_comment not like '%special%requests%')",
}
#: (operator, side, source, out_id, in_id); `ranked` has the outputs, `core` the rows below the group-by.
STEPS = {
    "q03": [
        ("scan_0", "in", "lineitem_x", "l_rid", "l_rid"),
        ("filter_1", "in", "lines", "l_rid", "l_rid"),
        ("scan_2", "in", "orders_x", "o_rid", "o_rid"),
        ("filter_3", "in", "placed", "o_rid", "o_rid"),
        ("scan_4", "in", "customer_x", "c_rid", "c_rid"),
        ("filter_5", "in", "buyers", "c_rid", "c_rid"),
        ("join_6", "build", "buyers", "c_custkey", "c_rid"),
        ("join_6", "probe", "placed", "o_rid", "o_custkey"),
        ("join_7", "build", "placed join buyers on o_custkey = c_custkey", "o_orderkey", "o_rid"),
        ("join_7", "probe", "lines", "l_rid", "l_orderkey"),
        ("group", "0", "core", "concat_ws('|', l_orderkey, o_orderdate, o_shippriority)", "l_rid"),
        ("group", "1", "ranked", "out_index", "concat_ws('|', l_orderkey, o_orderdate, o_shippriority)"),
    ],
    "q06": [
        ("scan_0", "in", "lineitem_x", "l_rid", "l_rid"),
        ("filter_1", "in", "lines", "l_rid", "l_rid"),
        ("group", "0", "lines", "''", "l_rid"),
        ("group", "1", "ranked", "out_index", "''"),
    ],
    "q13": [
        ("scan_0", "in", "customer_x", "c_rid", "c_rid"),
        ("scan_1", "in", "orders_x", "o_rid", "o_rid"),
        ("filter_2", "in", "plain", "o_rid", "o_rid"),
        ("left_join_3", "build", "plain", "o_custkey", "o_rid"),
        ("left_join_3", "probe", "customer_x", "c_rid", "c_custkey"),
        ("group", "0", "core", "c_count", "concat(c_rid, '|', coalesce(cast(o_rid as varchar), ''))"),
        ("group", "1", "ranked", "out_index", "c_count"),
    ],
}


def operators_sql(name: str) -> str:
    """The edges of every operator of a query: (op_id, side, out_id, in_id), ids as text."""
    rows = " union all ".join(
        f"select '{op}' as op_id, '{side}' as side, cast({out} as varchar) as out_id, cast({into} as varchar) as in_id from {source}"
        for op, side, source, out, into in STEPS[name]
    )
    start = _with(SPECS[name])
    return f"with {ctes(INPUTS[name] + start + rows)},\n{INPUTS[name]},\nall_parts as ({start} {rows}) select * from all_parts"
