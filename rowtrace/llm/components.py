"""Connected components of a graph given as edges, by alternating large and small stars.

A large star links each node's larger neighbours to the smallest of them all, a
small star its smaller neighbours and itself; both keep the components, and after
a logarithmic number of rounds every node hangs on the smallest of its component.
Each star is an aggregation and a join on the node, so a node with very many
neighbours is pre-aggregated, and its side of the join can be split: the join is
null-safe, which makes it shuffle both sides anew instead of building on the
exchange of the aggregation.

Edges become few within some rounds. They are counted after each, and a table that
is small by count is worked on by as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtrace.llm.common import cut

TASK_ROWS = 50_000
LEAST_TASKS = 8


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Edges (u, v) with u > v in, the same out; a large star may repeat some."""
    both = edges.coalesce(tasks)
    if large:
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.select(F.inline(ways))
    lowest = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("least")).coalesce(tasks)
    low = F.least("least", "_u").alias("low")
    near = both.join(lowest.select("_u", low), F.col("u").eqNullSafe(F.col("_u")))
    # large: neighbours above the node; small: those below, which all are, and the node itself
    if large:
        return near.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").coalesce(tasks)
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct(F.col("u").alias("u"), F.col("low").alias("v")))
    return near.select(F.inline(moved)).filter("u > v").distinct().coalesce(tasks)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node with an edge, root the smallest node of its component; edges are (a, b), any order."""
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen, count = None, now.count()
    for _ in range(rounds):
        tasks = max(LEAST_TASKS, -(-count // TASK_ROWS))
        now = cut(_star(cut(_star(now, True, tasks)), False, tasks))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        seen, count = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
