"""Literals of the 22 queries: for the given tables, and for the public benchmark's own data."""

from __future__ import annotations

from typing import Any

Params = dict[str, Any]

# The query literals that select rows in the given tables.
GIVEN: dict[str, Params] = {
    "q01": {"until": "1998-09-02"},
    "q02": {"size": 15, "type": "%Y", "region": "EUROPE"},
    "q03": {"segment": "BUILDING", "ordered_before": "1998-03-15", "shipped_after": "1998-03-15"},
    "q04": {"start": "1997-07-01", "end": "1997-10-01"},
    "q05": {"region": "ASIA", "start": "1996-01-01", "end": "1997-01-01"},
    "q06": {"start": "1996-01-01", "end": "1997-01-01", "low": 0.05, "high": 0.07, "quantity": 24},
    "q07": {"one": "NATION_3", "other": "NATION_7", "start": "1995-01-01", "end": "1996-12-31"},
    "q08": {"type": "ECONOMY", "region": "AMERICA", "nation": "NATION_3", "start": "1995-01-01", "end": "1996-12-31"},
    "q09": {"name": "%ring%"},
    "q10": {"start": "1996-10-01", "end": "1997-01-01", "flag": "R"},
    "q11": {"nation": "NATION_3", "fraction": 0.002},
    "q12": {"modes": ["MAIL", "SHIP"], "start": "1996-01-01", "end": "1997-01-01"},
    "q13": {"comment": "%special%requests%"},
    "q14": {"start": "1995-09-01", "end": "1995-10-01", "type": "PROMO%"},
    "q15": {"start": "1996-01-01", "months": 3},
    "q16": {
        "brand": "Brand#12",
        "type": "MEDIUM%",
        "sizes": [49, 14, 23, 45, 19, 3, 36, 9],
        "comment": "%Customer%Complaints%",
    },
    "q17": {"brand": "Brand#23", "container": "MED BOX"},
    "q18": {"quantity": 300},
    "q19": {
        "modes": ["AIR", "AIR REG"],
        "instruct": "DELIVER IN PERSON",
        "cases": [
            ("Brand#12", ["SM CASE", "SM BOX", "SM PACK", "SM PKG"], 1, 15),
            ("Brand#23", ["MED CASE", "MED BOX", "MED PKG", "MED PACK"], 10, 25),
            ("Brand#4", ["LG CASE", "LG BOX", "LG PACK", "LG PKG"], 20, 35),
        ],
    },
    "q20": {"name": "small%", "nation": "NATION_3", "start": "1996-01-01", "end": "1997-01-01"},
    "q21": {"nation": "NATION_3", "status": "F"},
    "q22": {"codes": ["13", "31", "23", "29", "30", "18", "17"], "priority": "1-URGENT"},
}

# Where the public benchmark's literals differ.
BENCHMARK: dict[str, Params] = {
    **GIVEN,
    "q02": {"size": 15, "type": "%BRASS", "region": "EUROPE"},
    "q03": {"segment": "BUILDING", "ordered_before": "1995-03-15", "shipped_after": "1995-03-15"},
    "q04": {"start": "1993-07-01", "end": "1993-10-01"},
    "q05": {"region": "ASIA", "start": "1994-01-01", "end": "1995-01-01"},
    "q06": {"start": "1994-01-01", "end": "1995-01-01", "low": 0.05, "high": 0.07, "quantity": 24},
    "q07": {"one": "FRANCE", "other": "GERMANY", "start": "1995-01-01", "end": "1996-12-31"},
    "q08": {
        "type": "ECONOMY ANODIZED STEEL",
        "region": "AMERICA",
        "nation": "BRAZIL",
        "start": "1995-01-01",
        "end": "1996-12-31",
    },
    "q09": {"name": "%green%"},
    "q10": {"start": "1993-10-01", "end": "1994-01-01", "flag": "R"},
    "q11": {"nation": "GERMANY", "fraction": 0.0001},
    "q12": {"modes": ["MAIL", "SHIP"], "start": "1994-01-01", "end": "1995-01-01"},
    "q16": {
        "brand": "Brand#45",
        "type": "MEDIUM POLISHED%",
        "sizes": [49, 14, 23, 45, 19, 3, 36, 9],
        "comment": "%Customer%Complaints%",
    },
    "q19": {
        "modes": ["AIR", "AIR REG"],
        "instruct": "DELIVER IN PERSON",
        "cases": [
            ("Brand#12", ["SM CASE", "SM BOX", "SM PACK", "SM PKG"], 1, 5),
            ("Brand#23", ["MED BAG", "MED BOX", "MED PKG", "MED PACK"], 10, 10),
            ("Brand#34", ["LG CASE", "LG BOX", "LG PACK", "LG PKG"], 20, 15),
        ],
    },
    "q20": {"name": "forest%", "nation": "CANADA", "start": "1994-01-01", "end": "1995-01-01"},
    "q21": {"nation": "SAUDI ARABIA", "status": "F"},
    "q22": {"codes": ["13", "31", "23", "29", "30", "18", "17"], "priority": None},
}

# Output columns that identify an output row when asking for its lineage; () asks for all of it.
TRACE_KEYS: dict[str, tuple[str, ...]] = {
    "q01": ("l_returnflag", "l_linestatus"),
    "q02": ("s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone", "s_comment"),
    "q03": ("l_orderkey", "o_orderdate", "o_shippriority"),
    "q04": ("o_orderpriority",),
    "q05": ("n_name",),
    "q06": (),
    "q07": ("supp_nation", "cust_nation", "l_year"),
    "q08": ("o_year",),
    "q09": ("nation", "o_year"),
    "q10": ("c_custkey", "c_name", "c_acctbal", "c_address", "c_phone", "c_comment"),
    "q11": ("ps_partkey",),
    "q12": ("l_shipmode",),
    "q13": ("c_count",),
    "q14": (),
    "q15": (),
    "q16": ("p_brand", "p_type", "p_size"),
    "q17": (),
    "q18": ("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
    "q19": (),
    "q20": ("s_name", "s_address"),
    "q21": ("s_name",),
    "q22": ("cntrycode",),
}

# Queries whose joined lineage is a product, and the columns that name their outputs.
FACTORISED: dict[str, tuple[str, ...]] = {
    "q02": ("p_partkey", "s_name"),
    "q11": ("ps_partkey",),
    "q15": ("s_suppkey",),
    "q16": ("p_brand", "p_type", "p_size"),
    "q17": (),
    "q18": ("o_orderkey",),
    "q21": ("s_name",),
    "q22": ("cntrycode",),
}

# Which rewrites exist, and the one to use by default.
DECORRELATED = ("q02", "q04", "q15", "q16", "q17", "q20", "q21", "q22")
WINDOWED = ("q01", "q02", "q04", "q05", "q07", "q09", "q11", "q12", "q13", "q15", "q22")
BEST: dict[str, str] = {q: "decorrelated" if q in DECORRELATED else "join" for q in GIVEN}
