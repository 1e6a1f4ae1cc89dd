"""SQL for every query that SQL can express."""

from __future__ import annotations

from oracles import micro_sql, runs_sql
from oracles.tpch_sql import SPECS, STEPS, backward_sql, base_sql, flat_sql, lineage_sql, long_sql, operators_sql

DECORRELATED = ("q02", "q04", "q15", "q16", "q17", "q20", "q21", "q22")
WINDOWED = ("q01", "q02", "q04", "q05", "q07", "q09", "q11", "q12", "q13", "q15", "q22")


def sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in SPECS:
        found[name] = base_sql(name)
        found[f"rid_{name}"] = lineage_sql(name)
        found[f"back_{name}"] = backward_sql(name)
        found[f"recover_{name}"] = base_sql(name)
        found[f"edges_{name}"] = lineage_sql(name, indexed=True)
        found[f"best_{name}"] = lineage_sql(name)
        if SPECS[name].sub:
            found[f"fact_{name}"] = long_sql(name)
    for name in STEPS:
        found[f"op_edges_{name}"] = operators_sql(name)
    for name in ("q02", "q18", "q21"):
        found[f"flat_{name}"] = flat_sql(name)
    for name in DECORRELATED:
        found[f"opt_{name}"] = lineage_sql(name)
    for name in WINDOWED:
        found[f"win_{name}"] = lineage_sql(name)
    found.update(micro_sql.sql())
    found.update(runs_sql.sql())
    return found
