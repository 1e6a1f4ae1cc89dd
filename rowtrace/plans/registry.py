"""Every query by name: a function from tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rowtrace.plans import micro, overhead
from rowtrace.plans.params import BEST, DECORRELATED, FACTORISED, TRACE_KEYS, WINDOWED
from rowtrace.plans.tpch import QUERIES, query
from rowtrace.sources.tables import Tables

Job = Callable[[Tables], DataFrame]
SAMPLE = 10
#: Factorised queries whose joined form is compared as well.
FLAT = ("q02", "q18", "q21")
#: Queries whose edge tables are compared operator by operator.
OPERATORS = ("q03", "q06", "q13")


def _result(name: str) -> Job:
    return lambda t: query(name, t, reuse=False).result()


def _lineage(name: str, strategy: str) -> Job:
    return lambda t: query(name, t).frame(strategy)


def _best(name: str) -> Job:
    """The default rewrite; the decorrelated ones are joins on the correlation key."""
    return _lineage(name, {"decorrelated": "join"}.get(BEST[name], BEST[name]))


def _factorised(name: str, keys: tuple[str, ...]) -> Job:
    return lambda t: query(name, t).long(keys)


def _recover(name: str) -> Job:
    return lambda t: query(name, t).recover()


def _edges(name: str) -> Job:
    return lambda t: query(name, t).composed()


def _operators(name: str) -> Job:
    return lambda t: query(name, t).edges()


def _backward(name: str) -> Job:
    return lambda t: query(name, t).backward(TRACE_KEYS[name], SAMPLE)


def _flat(name: str) -> Job:
    """The joined form for the first outputs, whose size the factorised one avoids."""

    def job(t: Tables) -> DataFrame:
        lineage, keys = query(name, t).pinned(), TRACE_KEYS[name]
        return lineage.flat(keys, lineage.wanted(SAMPLE, keys), bound=SAMPLE)

    return job


def jobs() -> dict[str, Job]:
    found: dict[str, Job] = {}
    for name in QUERIES:
        found[name] = _result(name)
        found[f"rid_{name}"] = _lineage(name, "join")
        found[f"back_{name}"] = _backward(name)
        found[f"recover_{name}"] = _recover(name)
        found[f"edges_{name}"] = _edges(name)
        found[f"best_{name}"] = _best(name)
    for name, keys in FACTORISED.items():
        found[f"fact_{name}"] = _factorised(name, keys)
    for name in OPERATORS:
        found[f"op_edges_{name}"] = _operators(name)
    for name in FLAT:
        found[f"flat_{name}"] = _flat(name)
    for name in DECORRELATED:
        found[f"opt_{name}"] = _lineage(name, "join")
    for name in WINDOWED:
        found[f"win_{name}"] = _lineage(name, "window")
    found.update(micro.jobs())
    found.update(overhead.jobs())
    return found
