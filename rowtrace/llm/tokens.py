"""Token counts by rank-synchronous array merging.

A task finds the pre-tokens of a batch of texts by character classes, takes the
distinct ones (by 64-bit hash within a batch of some MB), lays their byte symbols out as one flat array with sequence starts (a ragged array), and repeats:
look up the merge rank of every adjacent pair, take each sequence's lowest rank,
merge all its occurrences from the left, close the gaps. Every sequence moves on
in the same round; those without a mergeable pair are done. What is left of a
sequence is its token count. Batches are bounded by their bytes, and a cache of
counts by its entries (it is emptied when full; counts do not depend on it).

The vocabulary is a `tokenizers` JSON file of a byte-level BPE: its merges, its
added tokens (matched in texts as the library does by default) and its byte
alphabet. The pattern of byte-level pre-tokenisation is a fixed value.

Defined cases: a null or empty text has 0 tokens; very long texts and pre-tokens
are processed whole; repeated rows are counted each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, in_arrow, slices, table
from rowtrace.llm.hashing import Pieces, mix

#: Fixed value: the pre-tokenisation pattern of byte-level BPE, which `pre_tokens` follows and tests compare it with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
LIMIT = 512
BATCH_BYTES = 4 << 20
CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable bytes are themselves, others follow 255."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merger:
    """Merge ranks as sorted arrays, and the counts of pre-tokens seen so far."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.symbol = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.symbol[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.base = max(ids.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(regex.escape(t) for t in added)) if added else None
        self.counts: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Counts the symbols that survive in each word, a bounded run of words at a time."""
        done = 0
        while done < len(words):
            run, held = [], 0
            while done < len(words) and (held < BATCH_BYTES or not run):
                run.append(words[done].encode("utf-8"))
                held += len(run[-1])
                done += 1
            counts = self.merge(run)
            self.counts.update(zip(words[done - len(run) : done], counts.tolist(), strict=True))

    def merge(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        none = len(self.ranks)
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == pair), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            padded = np.append(rank, none)  # the pair at a sequence's last symbol crosses its end, so it has no rank
            lowest = np.minimum.reduceat(padded, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            per_symbol = np.repeat(lowest, sizes)
            open_symbol = per_symbol < none
            hit = np.flatnonzero((padded == per_symbol) & open_symbol)
            if not len(hit):
                break
            # of overlapping hits (a run of one symbol) every second one is taken, from the left
            run_start = np.concatenate(([True], np.diff(hit) != 1))
            first = np.flatnonzero(run_start)
            place = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[padded[hit]]
            keep = open_symbol.copy()  # sequences that are done leave the array
            keep[hit + 1] = False
            counts -= np.bincount(owner[hit], minlength=len(counts))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.added.split(text) if self.added is not None else [text]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts, ends, points = pre_tokens(joined, lengths)
        if not len(starts):
            return extra.tolist()
        keys = Pieces(mix(points)).of(starts, ends)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        words = [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        fresh = [w for w in words if w not in self.counts]
        if len(self.counts) + len(fresh) > CACHE_ENTRIES:
            self.counts = {}
            fresh = words
        self.learn(fresh)
        counts = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))[which]
        part = np.searchsorted(np.cumsum(lengths), starts, side="right")
        return (extra + np.bincount(np.array(owner)[part], counts, len(texts)).astype(np.int64)).tolist()


@cache
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            points = np.frombuffer(found.group().encode("utf-32-le"), np.uint32)
            table[points] = kind
    return table


def pre_tokens(joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of joined texts, and its code points.

    The pattern, read as runs of one character class: a run of letters, numbers or
    other characters is a pre-token, with one plain space before it if there is one;
    a longer run of white space is one without its last character; an apostrophe
    that stands alone takes a contraction's letters with it.
    """
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), points
    kind = character_classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[np.concatenate(([0], np.cumsum(lengths)))] = True
    cut = text_start.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut)  # run starts, and n
    last = run[1:] - 1
    run = run[:-1]
    # white space before other characters of the same text: its last character stands apart, and joins them if a space
    before = (kind[run] == SPACE) & ~text_start[last + 1]
    apart = last[before]
    cut[apart] = True
    joins = apart[points[apart] == 0x20] + 1
    cut[joins] = False
    # contractions: an apostrophe alone in its run, not after a joined space
    alone = run[(points[run] == 0x27) & (last == run) & cut[run]]
    alone = alone[~text_start[alone + 1]]
    after = points[alone + 1]
    two = np.append(points, 0)[alone + 2]
    same = ~text_start[np.minimum(alone + 2, n)]
    single = np.isin(after, [ord(c) for c in "stmd"])
    double = np.zeros(len(alone), bool)
    for a, b in ("re", "ve", "ll"):
        double |= (after == ord(a)) & (two == ord(b)) & same
    cut[alone[single | double] + 1] = False
    cut[alone[single] + 2] = True
    cut[alone[double] + 3] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.append(starts[1:], n), points


def counter(vocabulary: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        merger = Merger(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                        pa.array(merger.count(texts), pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. `vocabulary` is the content of the JSON file: tasks need no local file."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = in_arrow(
        docs.select("doc_id", "text"), counter(vocabulary), f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512) of every document."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return count_tokens(table(spark, folder, "documents"), vocabulary)
