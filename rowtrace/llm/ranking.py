"""Ranked lexical search by presence-mask grouping.

One pass over the documents finds, for each, its number of terms and how often the
terms of the items occur in it; these postings are written, and the corpus counts
and document frequencies are aggregated from them. A second pass reads the postings
only. For each item, a task lays the presence of the item's terms over a run of
documents as bitmaps, and groups the documents by their mask of matched terms. A
mask's maximum score is the sum of the highest contribution that each of its terms
has in the run. Masks are evaluated in descending order of it, until it is below the
score of the task's K-th best document: no document of a further mask can enter, ties
included. Tasks return their best K documents of each item, and a window ranks these.

The items are a stated query set: they are taken in blocks of bounded size, each of
which is sent to all tasks, and every document meets every block. A run of documents
is cut so that terms times documents stay bounded.

Defined cases: null and empty texts hold no term; documents without a term count
neither in N nor in results; items without a term have no rows; every row of the
items is ranked on its own, equal ids and null ids too; repeated documents are
ranked each, equal scores by ascending doc_id, null last, and equal rows get
successive ranks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, cut, in_arrow, prefix_sums, slices, table, written

K = 20
BLOCK_BYTES = 8 << 20  # of items' text in a block
BATCH_BYTES = 4 << 20
CELLS = 1 << 22  # terms of an item times documents of a run, at most (one document at least)
FIRST = 4 * K  # documents that are scored before the first bound is known

_term = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return _term.findall(text.encode("utf-8").lower())  # bytes.lower changes A-Z only


@dataclass
class Queries:
    """A block of items: distinct terms, and each item's (term, repeats)."""

    vocabulary: dict[bytes, int]
    items: list[tuple[np.ndarray, np.ndarray]]  # term numbers, ascending, and how often the item has them

    @staticmethod
    def of(texts: list[str]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        items = []
        for text in texts:
            counted = Counter(terms(text))
            found = sorted((vocabulary.setdefault(t, len(vocabulary)), n) for t, n in counted.items())
            items.append((np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64)))
        return Queries(vocabulary, items)


def _postings(shared) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        vocabulary = shared.value.vocabulary
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows, lengths, numbers, counts, ends = [], [], [], [], [0]
                for row, text in enumerate(batch.column("text").to_pylist()):
                    found = terms(text or "")
                    if not found:
                        continue
                    for term, n in Counter(found).items():
                        number = vocabulary.get(term)
                        if number is not None:
                            numbers.append(number)
                            counts.append(n)
                    rows.append(row)
                    lengths.append(len(found))
                    ends.append(len(numbers))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


def postings(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n, terms, counts of every document with a term."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, terms array<int>, counts array<long>"
    return in_arrow(docs.select("doc_id", "text"), _postings(shared), schema)


class Best:
    """The K best documents of an item so far: (-score, id is null, id)."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: list[tuple[int, bool, object]] = []

    @property
    def bound(self) -> int:
        """A document with a lower score cannot enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """Documents `at`, of which those are looked at that reach the bound and are not K times beaten here."""
        bound = self.bound
        if len(scores) > self.k:
            bound = max(bound, int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]))
        reach = np.flatnonzero(scores >= bound)
        if len(reach):
            names = ids.take(pa.array(at[reach])).to_pylist()
            found = [(-s, i is None, i) for s, i in zip(scores[reach].tolist(), names, strict=True)]
            self.rows = sorted([*self.rows, *found], key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[: self.k]


def groups_of(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first document of each distinct mask, and the mask of each document; `masks`: words x documents."""
    first, group = np.unique(masks[0], return_index=True, return_inverse=True)[1:]
    for word in masks[1:]:
        values, narrow = np.unique(word, return_inverse=True)
        first, group = np.unique(group * len(values) + narrow, return_index=True, return_inverse=True)[1:]
    return first, group


def by_mask(lists: list[tuple[np.ndarray, np.ndarray]], repeats: np.ndarray, width: int, ids: pa.Array, offset: int, best: Best) -> int:
    """Adds the documents of a run to an item's best; returns how many were scored.

    `lists`: for each term of the item, the documents (0 to width, ascending) that have it, and its contributions.
    """
    masks = np.zeros((-(-len(lists) // 64), width), np.uint64)
    for j, (docs, _) in enumerate(lists):
        masks[j // 64, docs] |= np.uint64(1 << (j % 64))
    first, group = groups_of(masks)
    most = np.zeros(len(first), np.int64)
    for j, (_, values) in enumerate(lists):
        if len(values):
            bit = (masks[j // 64, first] >> np.uint64(j % 64)) & np.uint64(1)
            most += bit.astype(np.int64) * (int(values.max()) * int(repeats[j]))
    hopeful = np.flatnonzero(most >= best.bound)
    order = hopeful[np.argsort(-most[hopeful], kind="stable")]
    place = np.full(len(first), len(order), np.int64)
    place[order] = np.arange(len(order))
    members = np.flatnonzero(place[group] < len(order))  # documents of masks that may matter
    members = members[np.argsort(place[group[members]], kind="stable")]
    ends = np.searchsorted(place[group[members]], np.arange(len(order)), side="right")
    done = scored = 0
    step = FIRST
    while done < len(order) and most[order[done]] >= best.bound:
        safe = int(np.searchsorted(-most[order], -best.bound, side="right"))  # masks whose maximum reaches the bound
        until = min(safe, int(np.searchsorted(ends, scored + step)) + 1)
        docs = np.sort(members[scored : ends[until - 1]])
        scores = np.zeros(len(docs), np.int64)
        for (having, values), times in zip(lists, repeats.tolist(), strict=True):
            if len(having):
                at = np.minimum(np.searchsorted(having, docs), len(having) - 1)
                scores += np.where(having[at] == docs, values[at] * times, 0)
        best.add(scores, ids, offset + docs)
        scored, done = int(ends[until - 1]), until
        step *= 2
    return scored


def ranker(shared, weights, documents: int, length: int, k: int) -> Callable[[Batches], Batches]:
    """`documents`, `length`: N and L."""

    def run(batches: Batches) -> Batches:
        items = shared.value.items
        best = [Best(k) for _ in items]
        kind = None
        for batch in batches:
            ids = batch.column("doc_id")
            kind = ids.type
            lists, counts = batch.column("terms"), batch.column("counts")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = counts.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(ends))
            m = 100 - 25 + (25 * batch.column("n").to_numpy() * documents) // length
            value = weights.value[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
            order = np.argsort(term, kind="stable")
            term, owner, value = term[order], owner[order], value[order]
            for (numbers, repeats), top in zip(items, best, strict=True):
                low, high = np.searchsorted(term, numbers, "left"), np.searchsorted(term, numbers, "right")
                step = max(1, CELLS // max(1, len(numbers)))
                for begin in range(0, len(batch), step) if len(numbers) else ():
                    width = min(step, len(batch) - begin)
                    lists = []
                    for a, b in zip(low.tolist(), high.tolist(), strict=True):
                        if width < len(batch):
                            a, b = a + np.searchsorted(owner[a:b], [begin, begin + width])
                        lists.append((owner[a:b] - begin, value[a:b]))
                    by_mask(lists, repeats, width, ids, begin, top)
        if kind is not None:
            rows = [(number, i, -s) for number, top in enumerate(best) for s, _, i in top.rows]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())],
                names=["number", "doc_id", "score"],
            )

    return run


def rank_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """number, rank, doc_id, score: number is the place of the item in `texts`."""
    spark = docs.sparkSession
    queries = Queries.of(texts)
    shared = spark.sparkContext.broadcast(queries)
    found = written(postings(docs, shared), "postings")
    documents, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (F.lit(2 * documents + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")
    weights = np.zeros(max(1, len(queries.vocabulary)), np.int64)
    for row in counted.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).toLocalIterator():
        weights[row["term"]] = row["w"]  # as many rows as the block has terms
    kind = docs.schema["doc_id"].dataType.simpleString()
    job = ranker(shared, spark.sparkContext.broadcast(weights), documents, max(1, length), k)
    best = in_arrow(found, job, f"number long, doc_id {kind}, score long")
    first = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.select("number", F.row_number().over(first).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    spark = docs.sparkSession
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    known = items.filter(F.length("text") > 0).select("item_id", "text")
    sized = prefix_sums(known.withColumn("bytes", F.octet_length("text").cast("long")), ["item_id", "text"], ["bytes"])
    blocks = cut(sized.select("item_id", "text", F.floor(F.col("before_bytes") / block_bytes).alias("block")))
    last = blocks.agg(F.max("block")).first()[0]
    result = None
    for number in range(0 if last is None else last + 1):
        rows = blocks.filter(F.col("block") == number).orderBy("item_id", "text").collect()  # at most block_bytes and an item
        if not rows:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"_number long, item_id {kinds[0]}")
        ranked = rank_block(docs, [r["text"] for r in rows], k)
        found = ranked.join(F.broadcast(names), F.col("number") == F.col("_number")).select("item_id", "rank", "doc_id", "score")
        result = found if result is None else result.unionAll(found)
    return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long") if result is None else result


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best documents of every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Terms of documents and items by the same pattern; scores in 64-bit integers.
SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as found from documents),
corpus as (select count(*) as documents, cast(sum(len(found)) as bigint) as length from words where len(found) > 0),
tf as (
  select doc_id, n, term, count(*) as tf
  from (select doc_id, len(found) as n, unnest(found) as term from words) group by all),
df as (select term, count(*) as df from tf group by term),
asked as (
  select item_id, term, count(*) as repeats
  from (select item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
weighed as (
  select item_id, term, repeats, cast(floor(1000 * ln((2 * documents + 2)::double / (2 * df + 1)::double)) as bigint) as w
  from asked join df using (term), corpus),
scored as (
  select item_id, doc_id, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * documents) // length))))) as bigint) as score
  from weighed join tf using (term), corpus group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20"""
