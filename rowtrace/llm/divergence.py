"""How far the sources of a language differ in their words, priced on hash-consed segment trees.

Tasks count the terms of their documents by language and source; the counts are
aggregated, each language keeps the terms that enough of its documents have, and
gives them ids by falling count. A source of a language is a group. The counts of a
group, in the order of the ids, are cut into segments of a fixed number of terms, and
over each segment lies a binary tree. Trees are hash-consed level by level: equal
subtrees, in whatever group and at whatever place, are one node. Two groups are
compared by going down both trees at once. A pair of nodes that occurs several times
is followed once and counted, so equal pairs of count subtrees are priced once; at
the leaves a pair of counts has its price. As rare terms lie side by side and most of
their counts are zero, whole stretches fold into few pairs. Prices are sums over
terms, so segments and blocks of groups are priced apart, and their sums added up.

p of a group and term is 1 + floor(SCALE * (count + 2) / (N + 2 * V)), and the price of
two is floor((p - q)^2 / (p + q)); N is the group's count of kept terms, V their number.

Defined cases: null text, language and source read as ''; every language and source
that occurs is a group, also without terms (all its counts are 0); without kept
terms, pairs have the value 0 and there are no term rows; ties are ranked by the
item's UTF-8 bytes; repeated documents count each; very long texts are read whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, in_arrow, prefix_sums, ship, slices, table, written

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
SEGMENT = 1 << 13  # terms of a segment
BLOCK = 64  # groups of a block; blocks of a language are compared two at a time
BATCH_BYTES = 4 << 20
ENTRIES = 1_000_000  # term counts that a task holds before it hands them on
CELLS = 1 << 21  # pairs of groups times terms that are followed at once

_term = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """Maximal runs of letters and characters beyond ASCII; only A-Z are lower-cased."""
    return _term.findall(text.encode("utf-8").lower())  # bytes.lower changes A-Z only


# -- counts -----------------------------------------------------------------------


def _rows(counts: dict[tuple[str, str], Counter], docs: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """One row of each language and term: documents, count, and counts by source."""
    by_lang: dict[str, list[tuple[str, Counter]]] = {}
    for (lang, source), counted in counts.items():
        by_lang.setdefault(lang, []).append((source, counted))
    for lang, groups in by_lang.items():
        found = list(docs[lang])
        place = {term: k for k, term in enumerate(found)}
        at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in groups])
        numbers = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in groups])
        sources = pa.array([s for s, _ in groups], pa.string()).take(pa.array(np.repeat(np.arange(len(groups)), [len(c) for _, c in groups])))
        order = np.argsort(at, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(found)))))
        pairs = pa.StructArray.from_arrays([sources.take(pa.array(order)), pa.array(numbers[order])], names=["source", "n"])
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(found), pa.string()),
                pa.array([t.decode("utf-8") for t in found], pa.string()),
                pa.array(list(docs[lang].values()), pa.int64()),
                pa.array(np.add.reduceat(numbers[order], ends[:-1]) if len(found) else numbers),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
            ],
            names=["lang", "term", "docs", "n", "counts"],
        )
        for begin in range(0, len(found), 20_000):
            yield whole.slice(begin, 20_000)


def _counted(batches: Batches) -> Batches:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    held = 0
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)
            for text, lang, source in rows:
                found = Counter(terms(text or ""))
                here = counts.setdefault((lang or "", source or ""), Counter())
                before = len(here)
                here.update(found)
                held += len(here) - before
                docs.setdefault(lang or "", Counter()).update(found.keys())
            if held >= ENTRIES:
                yield from _rows(counts, docs)
                counts, docs, held = {}, {}, 0
    if counts:
        yield from _rows(counts, docs)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, n, counts by source) of parts of the documents; a term has a row for each part that holds it."""
    schema = "lang string, term string, docs long, n long, counts array<struct<source:string,n:long>>"
    return in_arrow(docs.select("text", "lang", "source"), _counted, schema)


# -- trees ------------------------------------------------------------------------


class Trees:
    """Trees over the columns of a counts matrix (groups x terms), -1 where there is no term; equal subtrees are one
    node. `levels[h]` has the two children of the nodes of height h + 1; leaves are numbers of distinct counts."""

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((counts.shape[0], width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.values, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        known = len(self.values)
        while nodes.shape[1] > 1:
            pairs, numbers = np.unique(nodes[:, 0::2] * known + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // known, pairs % known))
            nodes, known = numbers.reshape(nodes.shape[0], -1), len(pairs)
        self.roots = nodes[:, 0]


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """p of counts, exact in 64-bit integers up to 9e13 words of a group: `totals` is N + 2 * V."""
    high, low = 10**5, SCALE // 10**5
    first = (counts + 2) * high
    return 1 + (first // totals) * low + ((first % totals) * low) // totals


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def merged(pair: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal (pair, x, y) as one, their multiplicities added."""
    n = int(max(x.max(), y.max())) + 1
    key = (pair * n + x) * n + y
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[first]
    return key // (n * n), key // n % n, key % n, np.add.reduceat(times[order], first)


def prices(trees: Trees, totals: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed price of each pair of groups (left[k], right[k]) over the terms of the trees."""
    out = np.zeros(len(left), np.int64)
    step = max(1, CELLS >> len(trees.levels))
    for begin in range(0, len(left), step):
        a, b = left[begin : begin + step], right[begin : begin + step]
        pair, x, y, times = np.arange(len(a)), trees.roots[a], trees.roots[b], np.ones(len(a), np.int64)
        for one, two in reversed(trees.levels):
            pair, x, y, times = merged(
                np.concatenate([pair, pair]),
                np.concatenate([one[x], two[x]]),
                np.concatenate([one[y], two[y]]),
                np.concatenate([times, times]),
            )
        counts, others = trees.values[x], trees.values[y]
        real = np.flatnonzero(counts >= 0)  # where one group has no term, none has
        pair = pair[real]
        value = price(shares(counts[real], totals[a[pair]]), shares(others[real], totals[b[pair]])) * times[real]
        np.add.at(out, begin + pair, value)
    return out


def _priced(block: int, key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One segment and two blocks: a row (lang, one, two, value) for each pair of groups of the two blocks."""
    lang, _, low, high = (k.as_py() for k in key)
    number, total, width = (groups.column(c).to_numpy() for c in ("number", "total", "width"))
    order = np.argsort(number)
    number, total = number[order], total[order]
    matrix = np.zeros((len(number), int(width[0]) if len(width) else 0), np.int64)
    if counts.num_rows:
        row = np.searchsorted(number, counts.column("number").to_numpy())
        matrix[row, counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    one, two = np.triu_indices(len(number), 1)
    wanted = (number[one] // block == low) & (number[two] // block == high)
    one, two = one[wanted], two[wanted]
    value = prices(Trees(matrix), total, one, two)
    return pa.table(
        [pa.array([lang] * len(one), pa.string()), pa.array(number[one]), pa.array(number[two]), pa.array(value)],
        names=["lang", "one", "two", "value"],
    )


def pricing(block: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    return lambda key, counts, groups: _priced(block, key, counts, groups)


# -- the audit --------------------------------------------------------------------


def _share(count: Column, words: Column, kept: Column) -> Column:
    """p in SQL; decimals hold products that 64-bit integers do not."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.floor(F.call_function("div", wide, (words + 2 * kept).cast("decimal(20,0)"))).cast("long") + 1


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: each group's distance to the other groups of its language (part `pair`),
    and the terms that set it most apart from the language (part `term`)."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select("text", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source")])
    parts = written(term_counts(named), "terms")
    kept = parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = kept.filter(F.col("docs") >= least_docs).select("lang", "term", "total", (-F.col("total")).alias("order"))
    ranked = prefix_sums(kept, ["order", "term"], [], ["lang"])
    ranked = written(ranked.select("lang", "term", "total", F.col("before_rows").alias("id")), "ids")
    langs = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_words"))
    # the many rare terms go before the counts are taken apart; Spark sends the kept ones to all tasks if they are few
    keys = ranked.select(F.col("lang").alias("_l"), F.col("term").alias("_t"), "id")
    known = parts.join(keys, (F.col("lang") == F.col("_l")) & (F.col("term") == F.col("_t")))
    single = known.select("lang", "id", F.inline("counts"))
    counts = written(single.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "counts")

    present = named.select("lang", "source").distinct()
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    zero = F.lit(0).cast("long")
    groups = present.join(words, ["lang", "source"], "left").join(langs, "lang", "left")
    order = Window.partitionBy("lang").orderBy("source")
    groups = written(
        groups.select(
            "lang", "source",
            *[F.coalesce(c, zero).alias(c) for c in ("words", "kept", "lang_words")],
            (F.row_number().over(order) - 1).cast("long").alias("number"),
        ),
        "groups",
    )
    result = _pairs(counts, groups, segment, block).unionByName(_terms(counts, ranked, groups, top))
    return result.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(counts: DataFrame, groups: DataFrame, segment: int, size: int) -> DataFrame:
    """Every other source of each group's language, by falling distance."""
    blocks = groups.groupBy(F.col("lang").alias("_b")).agg((F.max("number") / size).cast("long").alias("last_block"))
    # a block of groups meets every block of its language, so its counts are sent once for each
    meetings = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))).alias("other")
    block = F.floor(F.col("number") / size).cast("long")
    unit = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    placed = groups.join(blocks, F.col("lang") == F.col("_b"))
    rows = counts.join(
        placed.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "number", "last_block"),
        (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")),
    )
    rows = rows.select("lang", (F.col("id") / segment).cast("long").alias("segment"), (F.col("id") % segment).alias("place"), "number", "n", block.alias("block"), meetings)
    rows = rows.select("lang", "segment", *unit, "number", "place", "n")
    last = F.col("kept") - 1
    sides = placed.filter("kept > 0").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), (last / segment).cast("long"))).alias("segment"), "number", "kept",
        (F.col("words") + 2 * F.col("kept")).alias("total"), "last_block",
    )
    sides = sides.select(
        "lang", "segment", "number", "total", F.least(F.col("kept") - F.col("segment") * segment, F.lit(segment)).cast("long").alias("width"),
        block.alias("block"), meetings,
    )
    sides = sides.select("lang", "segment", *unit, "number", "total", "width")
    sides = sides.toDF(*sides.columns)  # columns of its own: both sides come from `groups`
    keys = ["lang", "segment", "low", "high"]
    priced = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(pricing(size), "lang string, one long, two long, value long")
    priced = priced.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = priced.unionAll(priced.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "value"))
    both = both.select(F.col("lang").alias("_pl"), F.col("one").alias("_one"), F.col("two").alias("_two"), "value")
    other = groups.select(F.col("lang").alias("_ol"), F.col("source").alias("item"), F.col("number").alias("_other"))
    # the result has a row for each two sources of a language, also where no term is kept
    pairs = groups.join(other, (F.col("lang") == F.col("_ol")) & (F.col("number") != F.col("_other")))
    same = (F.col("lang") == F.col("_pl")) & (F.col("number") == F.col("_one")) & (F.col("_other") == F.col("_two"))
    valued = pairs.join(both, same, "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(ranked))


def _terms(counts: DataFrame, ranked: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a group has more of than its language, by falling price, up to rank `top`."""
    sides = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "words", "kept", "lang_words")
    rows = counts.join(sides, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).drop("_l", "_s")
    names = ranked.select(F.col("lang").alias("_l"), F.col("id").alias("_i"), "term", "total")
    rows = rows.join(names, (F.col("lang") == F.col("_l")) & (F.col("id") == F.col("_i")))
    rows = rows.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _share(F.col("n"), F.col("words"), F.col("kept")).alias("p"),
        _share(F.col("total"), F.col("lang_words"), F.col("kept")).alias("q"),
    ).filter(F.col("p") > F.col("q"))
    gap = F.col("p") - F.col("q")
    valued = rows.select("lang", "source", "part", "item", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return valued.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return audit(table(spark, folder, "documents"))


SQL = r"""
with read as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (
  select lang, source, row_number() over () as doc, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from read),
kept as (
  select lang, term, cast(count(*) as hugeint) as total from words group by lang, term having count(distinct doc) >= 10),
langs as (select lang, cast(count(*) as hugeint) as v, cast(sum(total) as hugeint) as n from kept group by lang),
found as (select lang, source, term, cast(count(*) as hugeint) as n from words join kept using (lang, term) group by all),
present as (select distinct lang, source from read),
sides as (
  select p.lang, p.source, coalesce(l.v, 0) as v, coalesce(l.n, 0) as lang_n,
         coalesce((select sum(f.n) from found f where f.lang = p.lang and f.source = p.source), 0)::hugeint as n
  from present p left join langs l on p.lang = l.lang),
priced as (
  select s.lang, s.source, k.term, coalesce(f.n, 0) as c,
         1 + (1000000000::hugeint * (coalesce(f.n, 0) + 2)) // (s.n + 2 * s.v) as p,
         1 + (1000000000::hugeint * (k.total + 2)) // (s.lang_n + 2 * s.v) as q
  from sides s join kept k on s.lang = k.lang
  left join found f on f.lang = s.lang and f.source = s.source and f.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from priced a join priced b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
valued as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from present a join present b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from priced where c > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as place from valued)
select lang, source, part, item, cast(value as bigint) as value, cast(place as integer) as rank
from ranked where part = 'pair' or place <= 10"""
