"""Compact shuffles: arrays of fixed-width records, packed by destination, one binary row for each task batch and
destination. Rows of the frame are (part int, kind int, blob binary)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowtrace.llm.common import Batches, in_arrow

SCHEMA = "part int, kind int, blob binary"
Record = dict[str, np.ndarray]


def pack(record: Record, order: list[tuple[str, str]]) -> bytes:
    """Columns one after the other, compressed; incompressible ones cost no more than their bytes."""
    n = len(record[order[0][0]])
    return zlib.compress(n.to_bytes(8, "little") + b"".join(record[c].astype(t, copy=False).tobytes() for c, t in order), 1)


def unpack(blob: bytes, order: list[tuple[str, str]]) -> Record:
    raw = zlib.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for c, t in order:
        out[c] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def gather(blobs: list[bytes], order: list[tuple[str, str]]) -> Record:
    parts = [unpack(b, order) for b in blobs]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in order}


def deal(record: Record, part: np.ndarray, kind: int, order: list[tuple[str, str]]) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, blob) for each destination that gets records."""
    if not len(part):
        return
    by = np.argsort(part, kind="stable")
    sorted_part = part[by]
    edges = np.flatnonzero(np.diff(sorted_part)) + 1
    for rows in np.split(by, edges):
        yield int(part[rows[0]]), kind, pack({c: record[c][rows] for c, _ in order}, order)


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        names=["part", "kind", "blob"],
    )


def regroup(df: DataFrame, parts: int, job: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], passed: set[int], schema: str) -> DataFrame:
    """Moves blobs to their parts and runs `job(kind, blobs)` on each part's blobs of a kind.

    Kinds in `passed` are not for this step: they are handed on as they are.
    A part holds 1/parts of the records; what could pile up in one was
    pre-aggregated in the sending tasks.
    """

    def run(batches: Batches) -> Batches:
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True))
            on = [r for r in rows if r[1] in passed]
            if on:
                yield as_batch(on)
            for part, kind, blob in rows:
                if kind not in passed:
                    held.setdefault((part, kind), []).append(blob)
        for part, kind in sorted(held):
            yield from job(kind, held.pop((part, kind)))

    return in_arrow(df.repartitionById(parts, df["part"]), run, schema)
