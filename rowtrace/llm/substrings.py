"""Substring dedup by seed and extend.

Words that a window of `length` words covers are repeated if the same sequence of
words also starts earlier (in a document that comes first, or before in the same).

Seeds: in every window the smallest hash of SEED consecutive words, the rightmost
of equals, is its anchor (winnowing), so equal windows have equal anchors at equal
places. Consecutive windows of one anchor form a run; the run's text is the anchor
extended both ways as far as its windows reach. Occurrences are joined on anchors:

1. Of occurrences with equal anchor and equal run, all but the first are repeats.
2. Where one anchor has several runs, extensions agree only in part; the windows
   of the first occurrence of each run are compared one by one, by 128-bit hash.

Adjacent repeated windows add up to maximal repeats. No pairs are formed: a group
of n copies costs n records. Tasks first drop what they already know (a second
occurrence in the task is a repeat; an anchor with several runs in the task is
announced once), so a hot anchor, run or window sends one record for each task
batch. Texts are moved once; the second pass over them reuses that exchange.

Defined cases: null and empty texts have no words; ids order documents, null ids
first; rows of equal id and text are one document and get equal results, rows of
equal id and different texts are told apart by a hash of the text; texts are
processed whole; an empty table gives an empty result; other columns are left
alone. Equality is by hash (at least 112 bits), order by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.blobs import SCHEMA, Record, as_batch, deal, gather, regroup
from rowtrace.llm.common import Batches, in_arrow, shuffle_parts, slices, table, written
from rowtrace.llm.hashing import Pieces, mix, word_hashes, word_spans

LENGTH = 20
SEED = 6
BATCH_BYTES = 2 << 20
LOWEST = -(2**63)

ANCHORS, SPANS, WINDOWS = 0, 1, 2  # kinds of blobs
ANCHOR = [("high", "<u4"), ("low", "<u2"), ("run", "<u8"), ("k1", "<i8"), ("k2", "<u4"), ("start", "<u4"), ("count", "<u1")]
SPAN = [("k1", "<i8"), ("k2", "<u4"), ("start", "<u4"), ("count", "<u1"), ("open", "<u1")]
WINDOW = [("w1", "<u8"), ("w2", "<u8"), ("k1", "<i8"), ("k2", "<u4"), ("start", "<u4")]


class Words:
    """Words of a batch of texts with their hashes, and which text each belongs to."""

    def __init__(self, texts: list[bytes], streams: tuple[int, ...] = (0, 1)) -> None:
        # a separator keeps words of different texts apart
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, ends = word_spans(data)
        self.streams = [Pieces(mix(word_hashes(data, starts, ends, s), s), s) for s in streams]
        self.text = np.searchsorted(np.cumsum(lengths + 1) - 1, starts, side="left")
        self.first = np.searchsorted(self.text, np.arange(len(texts)))  # first word of each text
        self.n = len(starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, stream: int) -> np.ndarray:
        return self.streams[stream].of(starts, ends)


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run, by word number in the batch."""
    n_windows = words.n - length + 1
    none = np.zeros(0, np.int64)
    if n_windows < 1:
        return none, none, none.astype(np.uint64)
    valid = words.text[: n_windows] == words.text[length - 1 :]
    grams = np.arange(words.n - SEED + 1)
    hashed = words.hashes(grams, grams + SEED, 0)
    bits = np.uint64(26)
    low = np.uint64((1 << 26) - 1)
    key = (hashed >> bits << bits) | (low - grams.astype(np.uint64))
    # smallest of the windows' grams, by doubling
    span, best, width = length - SEED + 1, key, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    owner = (low - (best & low)).astype(np.int64)
    windows = np.flatnonzero(valid)
    if not len(windows):
        return none, none, none.astype(np.uint64)
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (owner[windows[1:]] != owner[windows[:-1]]) | (words.text[windows[1:]] != words.text[windows[:-1]])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(windows)))
    return windows[at], counts, hashed[owner[windows[at]]]


def _places(words: Words, keys: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> Record:
    text = words.text[starts]
    return {"k1": keys[0][text], "k2": keys[1][text], "start": starts - words.first[text]}


def _batch_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.asarray(batch.column("k1").to_numpy(zero_copy_only=False), np.int64),
        np.asarray(batch.column("k2").to_numpy(zero_copy_only=False), np.int64).astype(np.uint32),
    )


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _doc_part(k1: np.ndarray, parts: int) -> np.ndarray:
    return (mix(k1.astype(np.int64).view(np.uint64), 5) % np.uint64(parts)).astype(np.int64)


def _deal_spans(record: Record, open_: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    record = {c: record[c] for c in ("k1", "k2", "start", "count")} | {"open": np.full(len(record["k1"]), open_, np.uint8)}
    return deal(record, _doc_part(record["k1"], parts), SPANS, SPAN)


def _take(record: Record, which: np.ndarray) -> Record:
    return {c: v[which] for c, v in record.items()}


def find_anchors(length: int, parts: int) -> Callable[[Batches], Batches]:
    """Anchor records of each batch; what the batch already decides goes out as spans."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words = Words(_texts(batch))
                starts, counts, hashed = runs(words, length)
                if not len(starts):
                    continue
                found = _places(words, _batch_keys(batch), starts)
                found |= {
                    "count": counts,
                    "run": words.hashes(starts, starts + counts + length - 1, 1),
                    "h": hashed >> np.uint64(16),  # 48 bits
                }
                order = np.lexsort((found["start"], found["k2"], found["k1"], found["run"], found["h"]))
                found = _take(found, order)
                same_h = np.append(False, found["h"][1:] == found["h"][:-1])
                again = np.append(False, found["run"][1:] == found["run"][:-1]) & same_h
                rows = list(_deal_spans(_distinct_place(found, again), 0, parts))
                first = _take(found, ~again)
                begins = np.flatnonzero(np.append(True, first["h"][1:] != first["h"][:-1]))
                several = np.repeat(np.diff(np.append(begins, len(first["h"]))) > 1, np.diff(np.append(begins, len(first["h"]))))
                rows += _deal_spans(_take(first, several), 1, parts)
                # one announcement stands for all the runs of an anchor with several
                sent = _take(first, ~several | np.isin(np.arange(len(several)), begins))
                several = several[~several | np.isin(np.arange(len(several)), begins)]
                sent["count"] = np.where(several, 0, sent["count"])
                rows += deal(_split(sent), (sent["h"] % np.uint64(parts)).astype(np.int64), ANCHORS, ANCHOR)
                yield as_batch(rows)

    return run


def _distinct_place(found: Record, again: np.ndarray) -> Record:
    """Repeats that are not the very same place: rows of equal id and text are one document."""
    same = np.append(False, (found["k1"][1:] == found["k1"][:-1]) & (found["k2"][1:] == found["k2"][:-1]) & (found["start"][1:] == found["start"][:-1]))
    return _take(found, again & ~same)


def _split(record: Record) -> Record:
    return record | {"high": (record["h"] >> np.uint64(16)).astype(np.uint32), "low": (record["h"] & np.uint64(0xFFFF)).astype(np.uint16)}


def join_anchors(parts: int) -> Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]:
    def run(kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = gather(blobs, ANCHOR)
        found["h"] = (found["high"].astype(np.uint64) << np.uint64(16)) | found["low"]
        announced = found["h"][found["count"] == 0]
        real = _take(found, found["count"] > 0)
        order = np.lexsort((real["start"], real["k2"], real["k1"], real["run"], real["h"]))
        real = _take(real, order)
        if not len(order):
            return
        same_h = np.append(False, real["h"][1:] == real["h"][:-1])
        again = np.append(False, real["run"][1:] == real["run"][:-1]) & same_h
        rows = list(_deal_spans(_distinct_place(real, again), 0, parts))
        first = _take(real, ~again)
        begins = np.flatnonzero(np.append(True, first["h"][1:] != first["h"][:-1]))
        sizes = np.diff(np.append(begins, len(first["h"])))
        several = np.repeat(sizes > 1, sizes) | np.isin(first["h"], announced)
        rows += _deal_spans(_take(first, several), 1, parts)
        if rows:
            yield as_batch(rows)

    return run


SPAN_ROWS = "k1 long, k2 long, closed binary, open binary"


def merge_spans(kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its repeated spans, and those still to be compared, as pairs of (start, count)."""
    found = gather(blobs, SPAN)
    order = np.lexsort((found["start"], found["open"], found["k2"], found["k1"]))
    found = _take(found, order)
    if not len(order):
        return
    edges = np.flatnonzero(np.append(True, (np.diff(found["k1"]) != 0) | (np.diff(found["k2"].astype(np.int64)) != 0)))
    pairs = np.column_stack((found["start"], found["count"])).astype("<u4")
    columns: list[list] = [[], [], [], []]
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        closed = int((found["open"][a:b] == 0).sum())
        for column, value in zip(columns, (int(found["k1"][a]), int(found["k2"][a]), pairs[a : a + closed].tobytes(), pairs[a + closed : b].tobytes()), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k1", "k2", "closed", "open"])


def _pairs(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<u4").reshape(-1, 2).astype(np.int64)


def find_windows(length: int, parts: int) -> Callable[[Batches], Batches]:
    """Hashes of the windows in open spans."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                words = Words(_texts(batch))
                starts = []
                for i, blob in enumerate(batch.column("open").to_pylist()):
                    spans = _pairs(blob)
                    if len(spans):
                        offsets = np.arange(spans[:, 1].sum()) - np.repeat(np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1])
                        starts.append(words.first[i] + np.repeat(spans[:, 0], spans[:, 1]) + offsets)
                if not starts:
                    continue
                at = np.unique(np.concatenate(starts))
                found = _places(words, _batch_keys(batch), at)
                found |= {"w1": words.hashes(at, at + length, 0), "w2": words.hashes(at, at + length, 1)}
                again, found = _later(found)
                rows = list(_deal_spans(_distinct_place(found, again), 0, parts))
                first = _take(found, ~again)
                rows += deal(first, (first["w1"] % np.uint64(parts)).astype(np.int64), WINDOWS, WINDOW)
                yield as_batch(rows)

    return run


def _later(found: Record) -> tuple[np.ndarray, Record]:
    found = _take(found, np.lexsort((found["start"], found["k2"], found["k1"], found["w2"], found["w1"])))
    again = np.append(False, (found["w1"][1:] == found["w1"][:-1]) & (found["w2"][1:] == found["w2"][:-1]))[: len(found["w1"])]
    return again, found | {"count": np.ones(len(again), np.uint8)}


def join_windows(parts: int) -> Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]:
    def run(kind: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        again, found = _later(gather(blobs, WINDOW))
        rows = list(_deal_spans(_distinct_place(found, again), 0, parts))
        if rows:
            yield as_batch(rows)

    return run


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text with the order keys (k1, k2), which are never null."""
    return docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k1"),
        F.coalesce(F.pmod(F.xxhash64("text"), F.lit(2**32)), F.lit(0)).alias("k2"),
    )


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two frames of (k1, k2, closed): repeats that whole runs show, and those that single windows show."""
    if length < SEED:
        raise ValueError(f"windows of at least {SEED} words")
    parts = shuffle_parts(texts.sparkSession)
    anchors = in_arrow(texts.select("text", "k1", "k2"), find_anchors(length, parts), SCHEMA)
    joined = regroup(anchors, parts, join_anchors(parts), {SPANS}, SCHEMA)
    spans = written(regroup(joined, parts, merge_spans, set(), SPAN_ROWS), "spans")
    open_ = spans.filter(F.length("open") > 0).select("k1", "k2", "open")
    paired = texts.join(open_.hint("shuffle_hash"), ["k1", "k2"])
    windows = in_arrow(paired.select("text", "k1", "k2", "open"), find_windows(length, parts), SCHEMA)
    compared = regroup(windows, parts, join_windows(parts), {SPANS}, SCHEMA)
    single = regroup(compared, parts, merge_spans, set(), SPAN_ROWS)
    return spans.select("k1", "k2", "closed"), single.select("k1", "k2", F.col("closed").alias("single"))


def covered(n_words: int, length: int, *blobs: bytes | None) -> np.ndarray:
    """Mask of the words that repeated windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for blob in blobs:
        spans = _pairs(blob)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 0] + spans[:, 1] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(length: int, digest: bool) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts, removed, out = [], [], []
                for text, closed, single in zip(_texts(batch), batch.column("closed").to_pylist(), batch.column("single").to_pylist(), strict=True):
                    words = text.split()
                    counts.append(len(words))
                    if closed or single:
                        mask = covered(len(words), length, closed, single)
                        removed.append(int(mask.sum()))
                        words = list(compress(words, (~mask).tolist()))
                    else:
                        removed.append(0)
                    kept = b" ".join(words)
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every row, joined by spaces (or their SHA-256)."""
    texts = keyed_texts(docs)
    runs_, single = repeated_spans(texts, length)
    marked = texts.join(runs_.hint("shuffle_hash"), ["k1", "k2"], "left").join(single.hint("shuffle_hash"), ["k1", "k2"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        marked.select("doc_id", "text", "closed", "single"),
        _remove(length, digest),
        f"doc_id {kind}, n_words long, n_removed long, kept string",
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(table(spark, folder, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
