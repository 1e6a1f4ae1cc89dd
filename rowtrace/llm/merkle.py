"""Document fingerprints: Merkle trees over pieces, paragraphs and sections.

A paragraph is a line with its end; it is hashed whole, and also as pieces of
about four words, cut after words whose hash says so (in short paragraphs, after
each word), so that a change moves no cut but its own. A section is a run of paragraphs up to an empty line, or to a
paragraph whose digest says so. The root is the digest of the sections' digests:
equal roots, equal texts. Where roots differ, only sections that differ need a
look, and in them only paragraphs that differ (`differing`). The likeness of two
trees is the share of pieces they have in common.

As text: `root:section(paragraph pieces,paragraph pieces,...)section(...)`, all in
hex of fixed width.

Defined cases: a null text is an empty one, whose tree has no sections; texts of
any length are taken whole; rows of equal doc_id follow each other by text, null
ids come first; with a single row the next document is the row itself; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, in_arrow, shuffle_parts, table
from rowtrace.llm.hashing import Pieces, _byte_values, mix, word_spans

DIGEST = 16  # hex digits of a section or paragraph
PIECE = 8  # hex digits of a piece
WORDS = 4  # of a piece, on average
SHORT = 8  # words of a paragraph, up to which each word is a piece
PARAGRAPHS = 4  # of a section, on average
BATCH_BYTES = 2 << 20


def trees(texts: list[bytes]) -> list[str]:
    """The tree of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    total = len(data)
    if not total:
        return [_assemble(b"", [], [])] * len(texts)
    prefix = Pieces(_byte_values[0][data])
    # cuts after line ends and texts, and before the word that follows a chosen one
    is_cut = np.zeros(total + 1, bool)
    lines = np.flatnonzero(data == 0x0A) + 1
    is_line = np.zeros(total + 1, bool)
    is_line[lines] = True
    is_line[ends] = True
    is_line[ends - lengths] = True
    starts, stops = word_spans(data, np.concatenate(([0], ends)))
    if len(starts):
        line_of = np.searchsorted(np.flatnonzero(is_line), starts, side="right")
        short = np.bincount(line_of)[line_of] <= SHORT
        chosen = ((prefix.of(starts, stops) % np.uint64(WORDS) == 0) | short)[:-1] & (line_of[1:] == line_of[:-1])
        is_cut[starts[1:][chosen]] = True
    is_cut |= is_line
    cuts = np.flatnonzero(is_cut)
    left, right = cuts[:-1], cuts[1:]
    hashes = (mix(prefix.of(left, right)) >> np.uint64(32)).astype(">u4")
    line_cuts = np.flatnonzero(is_line)
    first_piece = np.searchsorted(left, line_cuts)  # of each line; the last entry is the end
    of_text = np.searchsorted(line_cuts, np.concatenate(([0], ends)))
    packed = hashes.tobytes().hex()
    line_list, piece_list = line_cuts.tolist(), (first_piece * PIECE).tolist()
    raw = data.tobytes()
    out = []
    for i in range(len(texts)):
        a, b = int(of_text[i]), int(of_text[i + 1])
        paragraphs = [raw[line_list[j] : line_list[j + 1]] for j in range(a, b)]
        pieces = [packed[piece_list[j] : piece_list[j + 1]] for j in range(a, b)]
        out.append(_assemble(texts[i], paragraphs, pieces))
    return out


def _assemble(text: bytes, paragraphs: list[bytes], pieces: list[str]) -> str:
    """Digests from the paragraphs up."""
    sections: list[str] = []
    top = hashlib.sha256()
    open_parts: list[str] = []
    inner = hashlib.sha256()

    def close() -> None:
        nonlocal open_parts, inner
        top.update(inner.digest())
        sections.append(f"{inner.hexdigest()[:DIGEST]}({','.join(open_parts)})")
        open_parts, inner = [], hashlib.sha256()

    for paragraph, below in zip(paragraphs, pieces, strict=True):
        digest = hashlib.sha256(paragraph).digest()
        inner.update(digest)
        open_parts.append(digest.hex()[:DIGEST] + below)
        if digest[0] % PARAGRAPHS == 0 or not paragraph.strip():
            close()
    if open_parts:
        close()
    return f"{top.hexdigest()}:{''.join(sections)}"


def branches(tree: str) -> list[tuple[str, list[str]]]:
    """(section digest, its paragraphs with their pieces) of a tree."""
    found = []
    for part in tree.partition(":")[2].split(")")[:-1]:
        digest, _, inner = part.partition("(")
        found.append((digest, inner.split(",")))
    return found


def leaves(tree: str) -> np.ndarray:
    """Sorted pieces of a tree."""
    below = "".join(p[DIGEST:] for _, paragraphs in branches(tree) for p in paragraphs)
    return np.sort(np.frombuffer(bytes.fromhex(below), ">u4").astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Pieces in common, of both trees' pieces on average (1 for two empty trees)."""
    if not len(a) and not len(b):
        return 1.0
    values, counts = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(counts[i], more[j]).sum() / (len(a) + len(b)))


def differing(tree: str, other: str) -> list[int]:
    """Numbers of the paragraphs of `tree` that `other` lacks, found from the root down."""
    if tree.partition(":")[0] == other.partition(":")[0]:
        return []
    theirs = branches(other)
    known_sections = {digest for digest, _ in theirs}
    known = {p[:DIGEST] for _, paragraphs in theirs for p in paragraphs}
    found, at = [], 0
    for digest, paragraphs in branches(tree):
        if digest not in known_sections:
            found += [at + k for k, p in enumerate(paragraphs) if p[:DIGEST] not in known]
        at += len(paragraphs)
    return found


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def in_order_with_next(docs: DataFrame) -> DataFrame:
    """Rows in blocks of consecutive ids, each block followed by a copy of the next block's first rows (`_guest`).

    Blocks are cut at ids that occur, taken at quantiles of the ids; so a text is
    moved once, and the first row of each block twice.
    """
    blocks = shuffle_parts(docs.sparkSession)
    lowest = -(2**63)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_key"))
    at = [i / blocks for i in range(1, blocks)]
    bounds = keyed.agg(F.min("_key").alias("low"), F.percentile_approx("_key", F.array(*map(F.lit, at or [0.5])), 100_000).alias("cuts")).first()
    low = lowest if bounds["low"] is None else bounds["low"]
    cuts = sorted({c for c in bounds["cuts"] or [] if c > low})[: blocks - 1] if blocks > 1 else []
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    block = F.size(F.filter(edges, lambda c: c <= F.col("_key")))
    guest_of = F.when(F.col("_key") == low, F.lit(len(cuts))).when(F.array_contains(edges, F.col("_key")), F.col("_block") - 1)
    placed = keyed.withColumn("_block", block)
    targets = F.concat(
        F.array(F.struct(F.col("_block").alias("b"), F.lit(False).alias("g"))),
        F.when(guest_of.isNotNull(), F.array(F.struct(guest_of.cast("int").alias("b"), F.lit(True).alias("g")))).otherwise(
            F.array().cast("array<struct<b:int,g:boolean>>")
        ),
    )
    spread = placed.withColumn("_to", F.explode(targets)).select(
        "doc_id", "text", "_key", F.col("_to.b").alias("_block"), F.col("_to.g").alias("_guest")
    )
    dealt = spread.repartitionById(len(cuts) + 1, F.col("_block"))
    return dealt.sortWithinPartitions("_block", "_guest", "_key", "text")


def _pairs(batches: Batches) -> Iterator[list[tuple[object, str, str]]]:
    """Lists of (doc_id, text, next text), of bounded size, from the sorted rows of blocks."""
    ready: list[tuple[object, str, str]] = []
    held = 0
    waiting: tuple[object, str, int] | None = None
    for batch in batches:
        for name, text, block, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_block", "_guest")), strict=True):
            text = text or ""
            if waiting is not None and waiting[2] == block:
                ready.append((waiting[0], waiting[1], text))
                held += len(text)
                waiting = None
            if not guest:
                waiting = (name, text, block)
            if held > BATCH_BYTES:
                yield ready
                ready, held = [], 0
    if ready:
        yield ready


def fingerprinter(id_type: pa.DataType) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for group in _pairs(batches):
            changed = [edited(text, following).encode("utf-8") for _, text, following in group]
            own = trees([text.encode("utf-8") for _, text, _ in group])
            theirs = trees(changed)
            # the next document is the next row, but at the end of a list or block
            odd = [i for i in range(len(group)) if i + 1 == len(group) or group[i][2] is not group[i + 1][1]]
            extra = dict(zip(odd, trees([group[i][2].encode("utf-8") for i in odd]), strict=True))
            sets = [leaves(t) for t in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in group], id_type),
                    pa.array([len(g[1]) for g in group], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
                    pa.array(own),
                    pa.array(theirs),
                    pa.array([likeness(a, leaves(t)) for a, t in zip(sets, theirs, strict=True)], pa.float64()),
                    pa.array([likeness(sets[i], leaves(extra[i]) if i in extra else sets[i + 1]) for i in range(len(group))], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """Trees of each document and of its edited text, and their likeness to each other and to the next document's."""
    ordered = in_order_with_next(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int32() if kind == "int" else pa.int64()
    return in_arrow(
        ordered.select("doc_id", "text", "_block", "_guest"),
        fingerprinter(id_type),
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints(table(spark, folder, "documents"))
