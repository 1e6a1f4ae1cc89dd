"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, score string, size string, node string, shard string, copies string"
WORDS = [a + b for a in "ba ce di fo gu ha li mo".split() for b in "ran tel vis kon pur sem nat dol".split()]


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source)"""
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None, str | None]] = [
        (1, base, "a"),
        (2, base, "a"),
        (3, " ".join(near), "b"),
        (4, None, "a"),
        (5, "", None),
        (6, "  \n\t ", "b"),
        (7, "one two", "b"),
        (8, "one two", "b"),
        (9, sentence(2, 30) + "\n" + " ".join(base.split()[10:45]) + "\n" + sentence(3, 30), "a"),
        (10, sentence(4, 6000), "c"),
        (11, "spin " * 90, "c"),
        (12, "é日本  x y   z\x0b\x0cq", None),
        (12, "same id, other text " + sentence(5, 25), "a"),
        (13, sentence(6, 50), "a"),
        (13, sentence(6, 50), "a"),
        (None, sentence(7, 40), None),
        (None, None, None),
        (-5, sentence(8, 80) + " " + base, "d"),
    ]
    rows += [(100 + i, sentence(9, 40), "hot") for i in range(40)]
    rows += [(200 + i, sentence(10, 20) + " " + sentence(1000 + i, 5), "hot") for i in range(30)]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None, str | None]] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z", "w", "v", "u", "t") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
