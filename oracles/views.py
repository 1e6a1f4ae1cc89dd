"""Derived tables of the workload as SQL common table expressions."""

VIEWS = {
    "region_x": "select *, r_regionkey as r_rid from region",
    "nation_x": "select *, n_nationkey as n_rid from nation",
    "supplier_x": """
        select *, s_suppkey as s_rid,
               concat('saddr-', cast(s_suppkey as varchar)) as s_address,
               concat(cast(s_nationkey + 10 as varchar), '-', cast(s_suppkey as varchar)) as s_phone,
               case when s_acctbal < 0 then 'Customer has Complaints' else 'quiet' end as s_comment
        from supplier""",
    "customer_x": """
        select *, c_custkey as c_rid,
               concat('caddr-', cast(c_custkey as varchar)) as c_address,
               concat(cast(c_nationkey + 10 as varchar), '-', cast(c_custkey as varchar)) as c_phone,
               concat('c', cast(c_custkey % 97 as varchar)) as c_comment
        from customer""",
    "part_x": """
        select *, p_partkey as p_rid,
               concat('Manufacturer#', cast(p_partkey % 5 + 1 as varchar)) as p_mfgr,
               concat(case p_partkey % 3 when 0 then 'SM' when 1 then 'MED' else 'LG' end, ' ',
                      case p_partkey % 4 when 0 then 'CASE' when 1 then 'BOX' when 2 then 'PACK' else 'PKG' end)
                 as p_container
        from part""",
    "orders_x": """
        select * exclude (o_orderdate), o_orderkey as o_rid, cast(o_orderdate as date) as o_orderdate,
               0 as o_shippriority,
               case when o_orderkey % 5 = 0 then 'special packages requests' else 'plain' end as o_comment
        from orders""",
    "lineitem_x": """
        select * exclude (l_shipdate),
               concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-',
                      cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as l_rid,
               cast(l_shipdate as date) as l_shipdate,
               cast(l_shipdate as date)
                 + cast((l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 61 - 30 as integer) as l_commitdate,
               cast(l_shipdate as date)
                 + cast((l_orderkey * 5 + l_linenumber * 11 + l_suppkey) % 30 + 1 as integer) as l_receiptdate,
               case (l_orderkey + l_linenumber) % 7 when 0 then 'MAIL' when 1 then 'SHIP' when 2 then 'AIR'
                 when 3 then 'AIR REG' when 4 then 'RAIL' when 5 then 'TRUCK' else 'FOB' end as l_shipmode,
               case (l_partkey + l_linenumber) % 4 when 0 then 'DELIVER IN PERSON' when 1 then 'COLLECT COD'
                 when 2 then 'NONE' else 'TAKE BACK RETURN' end as l_shipinstruct,
               cast(l_quantity as decimal(12,2)) as qty,
               cast(l_extendedprice as decimal(12,2)) as price,
               cast(l_discount as decimal(4,2)) as disc,
               cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as net
        from lineitem""",
    "partsupp_x": """
        select concat(cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as ps_rid,
               l_partkey as ps_partkey, l_suppkey as ps_suppkey,
               min(cast(l_extendedprice as decimal(12,2))) as ps_supplycost,
               cast(sum(cast(l_quantity as int)) as bigint) as ps_availqty
        from lineitem group by l_partkey, l_suppkey""",
}


def ctes(body: str) -> str:
    """The views that `body` mentions, as the start of a WITH clause."""
    used = [f"{name} as ({sql})" for name, sql in VIEWS.items() if name in body]
    return ",\n".join(used)
