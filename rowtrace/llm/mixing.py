"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates in [0, ceiling] that
meet the targets, the one nearest to rate 1 for every document in relative
entropy is r = min(ceiling, exp(l_s * z)), z a document's tokens over its
source's mean. The multiplier l_s of a source solves the convex dual, whose
gradient is the token total at these rates minus the target. Newton steps, kept
inside a bracket, run over the table of (source, size, documents), so hot
sources are pre-aggregated: a pass moves one row for each distinct size.

Rates become whole copies: each document has the whole part of its rate, and
within a source one more copy goes to the documents with the smallest
(hash - fraction), as long as the tokens stay below the target, and then to the
shortest of the others; both places are found by distributed prefix sums. So a
source misses its target by half a short document, provided its target lies within what whole copies can give.

Defined cases: null texts have size 0; documents of size 0 are given no copies;
null sources are a source of their own, last in order; repeated rows are mixed
each, and may have different numbers of copies; sources whose rates do not settle
within the steps are reported by a warning; ties in the hash go by id and place; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtrace.llm.common import boxed, cut, prefix_sums, table, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
STEPS = 60
TOLERANCE = 1e-6
BROADCAST_ROWS = 100_000  # rows of numbers and ids that may be sent to all tasks


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING
) -> DataFrame:
    """Target of each source (one row of `source`, `source_size`): its weight's part of share * all sizes, at most
    ceiling times its size, what is above being given to the others by weight."""
    ranked = sizes.select(
        "*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_rank")
    )
    weighed = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ).withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
    # sources fill up in the order of cap over weight; taking the first k as full gives a level that is never too high,
    # and the right one for the right k, so the highest is it
    filled = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.withColumn("_all", F.sum("source_size").over(everything) * F.lit(share)).withColumn(
        "_level",
        (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    water = F.max("_level").over(everything)
    return leveled.select(
        "source", "source_size", F.least(water * F.col("weight"), F.col("_cap")).alias("target")
    )


def rate(multiplier: Column, relative: Column, ceiling: int = CEILING) -> Column:
    """exp(multiplier * relative), at most the ceiling; the exponent is bounded first, so nothing overflows."""
    top = F.lit(float(ceiling))
    return F.when(multiplier * relative >= F.log(top), top).otherwise(F.exp(F.greatest(multiplier * relative, F.lit(-700.0))))


def balance(histogram: DataFrame, targets: DataFrame, ceiling: int = CEILING, steps: int = STEPS) -> DataFrame:
    """Multiplier of each source: Newton iterations on the dual, each one aggregation over (source, size, n)."""
    sized = histogram.filter("size > 0")
    means = sized.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    top = F.col("source_size") * F.lit(float(ceiling))
    open_targets = targets.filter((F.col("target") > 0) & (F.col("target") < top))  # at the ceiling all rates equal it
    start = open_targets.withColumnRenamed("source", "_s").join(means, F.col("_s").eqNullSafe(F.col("source")))
    state = cut(
        start.select(
            F.col("_s").alias("source"),
            "source_size",
            "target",
            F.col("_mean").alias("mean"),
            F.lit(0.0).alias("multiplier"),
            F.lit(-1e6).alias("low"),
            F.lit(1e6).alias("high"),
        )
    )
    tokens = F.col("size") * F.col("n")
    z = F.col("size") / F.col("mean")
    for _ in range(steps):
        seen = sized.withColumnRenamed("source", "_s").join(state, F.col("_s").eqNullSafe(F.col("source")))
        r = rate(F.col("multiplier"), z, ceiling)
        slope = F.when(r < float(ceiling), r * z * tokens).otherwise(0.0)
        kept = ["source", "source_size", "target", "mean", "multiplier", "low", "high"]
        summed = seen.groupBy(*kept).agg(F.sum(r * tokens).alias("_got"), F.sum(slope).alias("_slope"))
        excess = F.col("_got") - F.col("target")
        narrowed = summed.withColumn("low", F.when(excess < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn(
            "high", F.when(excess > 0, F.col("multiplier")).otherwise(F.col("high"))
        )
        newton = F.col("multiplier") - excess / F.col("_slope")
        inside = (F.col("_slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        # outside the bracket: halve it, from a wide one by growing or shrinking the step
        middle = (
            F.when(F.col("high") >= 1e6, F.greatest(F.col("low") * 2, F.col("low") + 1))
            .when(F.col("low") <= -1e6, F.least(F.col("high") * 2, F.col("high") - 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        settled = F.abs(excess) <= F.col("target") * TOLERANCE
        stepped = narrowed.withColumn(
            "_next", F.when(settled, F.col("multiplier")).when(inside, newton).otherwise(middle)
        ).withColumn("_open", (~settled).cast("int"))
        ended = cut(stepped)
        state = ended.select(
            "source", "source_size", "target", "mean", F.col("_next").alias("multiplier"), "low", "high"
        )
        if not ended.agg(F.max("_open")).first()[0]:
            break
    else:
        gap = ended.agg(F.sum("_open"), F.max(F.abs(excess) / F.col("target"))).first()
        warnings.warn(f"{gap[0]} sources are not balanced after {steps} steps, by up to {gap[1]} of their target", stacklevel=2)
    return state


def mix(docs: DataFrame, ceiling: int = CEILING, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and hash of id and text of every document (columns doc_id, source, text)."""
    text = F.col("text")
    light = cut(
        docs.select(
            "doc_id", "source", word_count(text).alias("size"), F.xxhash64("doc_id", "text").alias("_hash")
        )
    )
    histogram = cut(light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, share, ceiling)
    solved = balance(histogram, targets, ceiling)
    known = cut(
        targets.withColumnRenamed("source", "_s")
        .join(solved.select("source", "mean", "multiplier"), F.col("_s").eqNullSafe(F.col("source")), "left")
        .select(F.col("_s").alias("_source"), "source_size", "target", "mean", "multiplier")
    )
    # rates depend on source and size only: they are attached to the histogram, then to the documents by both
    full = F.col("target") >= F.col("source_size") * F.lit(float(ceiling))
    at = histogram.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"),
        F.col("size").alias("_size"),
        "n",
        "source_size",
        "target",
        F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0)
        .when(full, float(ceiling))
        .otherwise(rate(F.col("multiplier"), F.col("size") / F.col("mean"), ceiling))
        .alias("rate"),
    )
    at = at.withColumn("whole", F.floor("rate").cast("long"))
    whole_tokens = at.groupBy(F.col("_source").alias("_w")).agg(
        F.sum(F.col("whole") * F.col("_size") * F.col("n")).alias("whole_tokens")
    )
    at = at.join(whole_tokens, F.col("_source").eqNullSafe(F.col("_w"))).drop("_w", "n")
    placed = light.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    uniform = F.shiftrightunsigned(F.col("_hash"), 11).cast("double") / F.lit(float(1 << 53))
    open_room = (F.col("whole") < ceiling) & (F.col("size") > 0)
    ready = placed.select(
        "doc_id",
        F.col("_hash").alias("hash"),
        "source",
        "size",
        "source_size",
        "target",
        "whole",
        "whole_tokens",
        F.when(open_room, F.col("size")).otherwise(F.lit(0)).cast("long").alias("room"),
        F.when(open_room, uniform - (F.col("rate") - F.col("whole"))).otherwise(F.lit(2.0)).alias("turn"),
    )
    ranked = prefix_sums(ready, ["turn", "doc_id"], ["room"], ["source"])
    first = (F.col("room") > 0) & (F.col("whole_tokens") + F.col("before_room") + F.col("room") <= F.col("target"))
    chosen = cut(ranked.withColumn("first", first).drop("before_room", "before_rows"))
    # what the document at that place leaves open goes to the shortest of the others
    given = chosen.groupBy(F.col("source").alias("_g")).agg(
        F.sum(F.when(F.col("first"), F.col("room")).otherwise(0)).alias("given")
    )
    left = chosen.join(given, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    spare = left.withColumn("short", F.when(F.col("first"), 0).otherwise(F.col("room")).cast("long"))
    filled = prefix_sums(spare, ["short", "turn", "doc_id"], ["short"], ["source"])
    reached = F.col("whole_tokens") + F.col("given") + F.col("before_short") + F.col("short") / 2
    second = (F.col("short") > 0) & (reached <= F.col("target"))
    return filled.select(
        "doc_id",
        "hash",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") + (F.col("first") | second).cast("long")).alias("copies"),
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it. Where rows equal in id, text and source have different numbers
    of copies, they are numbered and the larger number goes to as many of them as have it in the mix."""
    counts = mix(docs).groupBy("hash", F.col("doc_id").alias("id"), F.col("source").alias("from")).agg(
        F.min("copies").cast("int").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")
    )
    # copies of equal rows differ by one at most: they have the same rate
    more = (F.col("all") - F.col("least") * F.col("n")).alias("more")
    taken = written(counts.filter(F.col("all") > 0).select("hash", "id", "from", "least", more), "copies")
    rows = boxed(docs, F.xxhash64("doc_id", "text").alias("row_hash"), F.col("doc_id").alias("row_id"), F.col("source").alias("row_source"))
    same = (
        (F.col("row_hash") == F.col("hash"))
        & F.col("row_id").eqNullSafe(F.col("id"))
        & F.col("row_source").eqNullSafe(F.col("from"))
    )

    def repeated(df: DataFrame, copies: Column) -> DataFrame:
        several = df.withColumn("copies", copies).filter("copies > 0")
        return several.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")

    even = repeated(rows.join(taken.filter("more = 0"), same), F.col("least"))
    mixed = taken.filter("more > 0")  # a few groups of equal rows in each source: those at which it reaches its target
    if not mixed.limit(1).count():
        return even
    uneven = rows.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, same)
    numbered = prefix_sums(uneven.select("row", "hash", "id", "from", "least", "more"), ["least"], [], ["hash", "id", "from"])
    return even.unionAll(repeated(numbered, F.col("least") + (F.col("before_rows") < F.col("more")).cast("int")))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )
