"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits (any character beyond ASCII
counts as a letter). A mask marks the positions of a window that count; hashes of
the counting tokens of every window of a benchmark item, for each of a few fixed
masks, are joined with those of every window of every document. A hit puts the
item beside the document at one offset; there tokens are compared position by
position, and the best stretch (+1 for equal, -2 for different tokens) is the
overlap: it goes on over substituted tokens. Stretches at nearby offsets (words
inserted or left out between them) are added up. A document is contaminated by an
item if the overlap has enough equal tokens, and enough of the item's or enough in
one stretch.

The benchmark is a stated query set: it is taken in blocks of bounded size, each
of which is sent to all tasks, and every document meets every block. Documents are
not moved.

Defined cases: null and empty texts have no tokens; items with fewer tokens than
the least overlap contaminate nothing; equal items are each reported; repeated
documents are each judged, also those that share an id (or have none) and differ in
their texts; items without an id are reported with a null id; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, boxed, cut, in_arrow, prefix_sums, slices, table, written
from rowtrace.llm.hashing import mix, powers, word_hashes

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("111111", "11010111", "1100101101", "1010011011")
LEAST_TOKENS = 8
LEAST_SHARE = 0.5
LONG_STRETCH = 13  # equal tokens in one stretch that are enough of any item
LEAST_STRETCH = 6  # equal tokens of a stretch that is added to others
NEAR = 8  # tokens between the offsets of stretches that are added up
PENALTY = 2
BLOCK_BYTES = 8 << 20  # of benchmark text in a block
BATCH_BYTES = 2 << 20
FILTER_BITS = 20
HITS = 1 << 20  # that are worked out at once (or those of one place in a text)

_is_token = np.zeros(256, bool)
_is_token[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the number of the first token of each text (and the end)."""
    raw = [t.lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = _is_token[data]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return mix(word_hashes(data, starts, ends), 7), np.concatenate(([0], np.searchsorted(starts, bounds)))


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window lies in one text, and the hash of its counting tokens."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = powers(0x9E3779B97F4A7C15, span)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                total += hashes[j : j + n] * factors[j]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))  # tokens up to the text's end
    at = np.flatnonzero(left[:n] >= span)
    return at, mix(total[at], stream)


class Block:
    """Seeds of some benchmark items, sorted for lookup."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids = [k for k, _ in items]
        self.hashes, self.first = tokens([t for _, t in items])
        keys, places = [], []
        for m, mask in enumerate(MASKS):
            at, key = seeds(self.hashes, self.first, mask, m)
            keys.append(key)
            places.append(at)
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.keys, self.places = key[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def diagonals(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, offset) at which a seed of the text meets one of the item.

        Hits are worked out a bounded number at a time and told apart at once: a seed that is very common, in the text
        or among the items, costs time, not memory.
        """
        sizes, lengths = np.diff(first), np.diff(self.first)
        shift = int(lengths.max(initial=0))
        width = shift + int(sizes.max(initial=0)) + 1
        known = np.zeros(0, np.int64)
        for m, mask in enumerate(MASKS):
            at, key = seeds(hashes, first, mask, m)
            likely = np.flatnonzero(self.filter[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at, key = at[likely], key[likely]
            low = np.searchsorted(self.keys, key, side="left")
            counts = np.searchsorted(self.keys, key, side="right") - low
            found = np.flatnonzero(counts)
            at, low, counts = at[found], low[found], counts[found]
            run = (np.cumsum(counts) - counts) // HITS
            for begin, end in zip(*(np.searchsorted(run, np.unique(run), side) for side in ("left", "right")), strict=True):
                n = counts[begin:end]
                ours = np.repeat(at[begin:end], n)
                theirs = self.places[np.repeat(low[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                text = np.searchsorted(first, ours, side="right") - 1
                item = np.searchsorted(self.first, theirs, side="right") - 1
                offset = (ours - first[text]) - (theirs - self.first[item])
                known = np.union1d(known, (text * len(lengths) + item) * width + offset + shift)
        pair = known // width
        return np.column_stack((pair // max(1, len(lengths)), pair % max(1, len(lengths)), known % width - shift))

    def overlaps(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first token in the text, equal tokens, those of the best stretch) of the best overlap of each
        text and item that meet."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for t, b, offset in self.diagonals(hashes, first).tolist():
            length = int(self.first[b + 1] - self.first[b])
            low, high = max(0, offset), min(int(first[t + 1] - first[t]), offset + length)
            ours = hashes[first[t] + low : first[t] + high]
            theirs = self.hashes[self.first[b] + low - offset : self.first[b] + high - offset]
            start, equal = best_stretch(ours == theirs)
            if equal > best.get((t, b), (0, 0))[1]:
                best[t, b] = (low + start, equal)
            same = ours == theirs
            for begin_, end in stretches(same):
                found.setdefault((t, b), []).append((offset, low + begin_ + np.flatnonzero(same[begin_:end])))
        whole = []
        for (t, b), (start, equal) in best.items():
            more = joined(found.get((t, b), []))
            whole.append((t, b, *(more if more[1] > equal else (start, equal)), equal))
        return whole


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and equal tokens of the stretch with the most equal, less PENALTY for each different one."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    start = int(np.argmin(sums[: end + 1]))
    return start, int(equal[start:end].sum())


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that have LEAST_STRETCH equal tokens, each up to its best end; none overlap."""
    found: list[tuple[int, int]] = []
    parts = [(0, len(equal))]
    while parts:
        low, high = parts.pop()
        sums = np.concatenate(([0], np.cumsum(np.where(equal[low:high], 1, -PENALTY))))
        score = sums - np.minimum.accumulate(sums)
        zeros = np.flatnonzero(score == 0)
        stops = np.append(zeros[1:], len(score))
        for k in np.flatnonzero(stops - zeros > LEAST_STRETCH).tolist():
            a, b = int(zeros[k]), int(stops[k])
            end = a + int(np.argmax(score[a:b]))
            if equal[low + a : low + end].sum() >= LEAST_STRETCH:
                found.append((low + a, low + end))
            if b - end > LEAST_STRETCH:
                parts.append((low + end, low + b - 1))
    return found


def joined(found: list[tuple[int, np.ndarray]]) -> tuple[int, int]:
    """First token in the text and equal tokens of the stretches (offset, equal tokens in the text) at nearby offsets
    that have the most together; no token counts twice, in the text or in the item."""
    best = (0, 0)
    if len(found) < 2:
        return best
    found = sorted(found, key=lambda x: x[0])
    breaks = [k for k in range(1, len(found)) if found[k][0] - found[k - 1][0] > NEAR]
    for a, b in zip([0, *breaks], [*breaks, len(found)], strict=True):
        ours = np.unique(np.concatenate([at for _, at in found[a:b]]))
        theirs = np.unique(np.concatenate([at - offset for offset, at in found[a:b]]))
        if min(len(ours), len(theirs)) > best[1]:
            best = int(ours[0]), min(len(ours), len(theirs))
    return best


def matcher(shared, least_tokens: int, least_share: float, id_type: pa.DataType, item_type: pa.DataType) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        block: Block = shared.value
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                hashes, first = tokens([t or "" for t in batch.column("text").to_pylist()])
                names, keys = batch.column("doc_id"), batch.column("text_key")
                rows = []
                for t, b, start, equal, stretch in block.overlaps(hashes, first):
                    length = int(block.first[b + 1] - block.first[b])
                    if equal >= least_tokens and (equal >= least_share * length or stretch >= LONG_STRETCH):
                        rows.append((names[t].as_py(), keys[t].as_py(), block.ids[b], start, equal, equal / length))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (id_type, pa.int64(), item_type, pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "text_key", "item_id", "start", "equal_tokens", "share"],
                )

    return run


def _arrow_type(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def overlaps(
    docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS, least_share: float = LEAST_SHARE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, text_key (a hash of the text), item_id, start, equal_tokens, share of every document and item that overlap enough."""
    spark = docs.sparkSession
    items = benchmark.filter(F.length("text") > 0).select("item_id", "text")
    sized = prefix_sums(items.withColumn("bytes", F.octet_length("text").cast("long")), ["item_id", "text"], ["bytes"])
    blocks = cut(sized.select("item_id", "text", F.floor(F.col("before_bytes") / block_bytes).alias("block")))
    last = blocks.agg(F.max("block")).first()[0]
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, text_key long, item_id {kinds[1]}, start long, equal_tokens long, share double"
    result = None
    for number in range(0 if last is None else last + 1):
        rows = blocks.filter(F.col("block") == number).orderBy("item_id", "text").collect()  # at most block_bytes and an item
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in rows]))
        job = matcher(shared, least_tokens, least_share, _arrow_type(kinds[0]), _arrow_type(kinds[1]))
        found = in_arrow(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), job, schema)
        result = found if result is None else result.unionAll(found)
    return spark.createDataFrame([], schema) if result is None else result


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item overlaps. Rows are told apart by id and text, so neither other texts of the
    same id nor other rows without an id go with a contaminated one."""
    leaked = written(overlaps(docs, benchmark).select(F.col("doc_id").alias("leaked"), "text_key").distinct(), "leaked")
    rows = boxed(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    same = (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("leaked"))
    return rows.join(leaked, same, "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of doc_id and item_id that overlap, with the place and size of the overlap."""
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")
