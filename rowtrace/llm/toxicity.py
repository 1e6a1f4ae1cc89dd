"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: compatibility forms are made plain, look-alike letters of other scripts and digits or signs that stand for letters inside words become those
letters, case is dropped, and every run of other characters is one space. A space
stands at either end, so an entry that begins with a space matches only at the
beginning of a word.

The lexicon is learned from a sample of labelled rows, of a size that is a
parameter: words and beginnings of words are counted by document and label; those that are much likelier in
toxic documents become entries, weighted by the logarithm of the ratio (their number is bounded by the sample). A
beginning stands for all of its words, and longer ones that add nothing are left
out. Exception phrases are words and pairs that hold an entry but are not likelier
in toxic documents; a match inside one does not count.

A document's evidence is the weight of its matches, counted as matches + 1 in
logarithm, and the same per hundred words; a logistic curve over both is fitted to
the same sample, and gives the score. Labels,
language, source and id are never inputs of a score.

Defined cases: null and empty texts have no evidence and the lowest score; texts
are folded whole; repeated rows get equal scores; labels without a document or
without a value are left out, and of several labels of a document the highest
holds; of several documents with a labelled id the one of the least text teaches;
without any labels every score is 0; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, boxed, cut, in_arrow, slices, table

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
LEAST_DOCUMENTS = 5  # toxic training documents that hold an entry
LEAST_RATIO = 15.0  # likelier in toxic documents by
STRONGEST = 3  # entries of a document that may explain its label
STEMS = (3, 4, 5, 6, 7)  # lengths of beginnings
SAMPLE = 16_000  # labelled rows to learn from, half of either label
BATCH_BYTES = 4 << 20

#: Letters of other scripts that look like Latin ones, and digits or signs used for letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁԛԝһвкмнтгпαβεηικνορτυχωγɑɡıℓ",
    "aeopcyxijsdqwhbkmhtrnabenikvoptuxwyagil",
)
DIGITS = str.maketrans("013457@$!", "oieasta" + "si")


class _Folding(dict):
    """Folding of single characters, worked out when first met."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKC", chr(code)).lower().translate(LOOKALIKES)
        self[code] = out = "".join(x if x.isalnum() or x in "@$!" else " " for x in plain)
        return out


_folding = _Folding()


def fold(text: str) -> str:
    """Folded words, one space around each."""
    words = text.translate(_folding).split()
    out: list[str] = []
    for word in words:
        if word.isalpha():
            out.append(word)
            continue
        core = word.strip("@$!")
        if any(c.isalpha() for c in core):
            core = core.translate(DIGITS)
        out += ["".join(c if c.isalnum() else " " for c in core)] if core else []
    return f" {' '.join(' '.join(out).split())} "


def features(folded: str) -> set[str]:
    """Words of a folded text and their beginnings, as they stand in it."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in STEMS:
        found |= {f" {w[:n]}" for w in words if len(w) > n}
    return found


def phrases(built: ahocorasick.Automaton, folded: str) -> set[str]:
    """Words that hold an entry, and pairs of words of which one does."""
    found = set()
    for end, (length, _) in built.iter(folded):
        left = folded.rindex(" ", 0, end - length + 3)
        right = folded.index(" ", max(end, left + 1))
        found.add(folded[left : right + 1])
        if left:
            found.add(folded[folded.rindex(" ", 0, left) : right + 1])
        if right + 1 < len(folded):
            found.add(folded[left : folded.index(" ", right + 1) + 1])
    return found


def strongest(built: ahocorasick.Automaton, folded: str) -> set[str]:
    """The heaviest few entries that a folded text holds."""
    held = {(weight, folded[end - length + 1 : end + 1]) for end, (length, weight) in built.iter(folded)}
    return {entry for _, entry in sorted(held)[-STRONGEST:]}


def _counted(lexicon: dict[str, float] | None, of: str) -> Callable[[Batches], Batches]:
    """Documents by label that hold a feature (or, with a lexicon, a phrase), summed in the task before they are moved."""

    def run(batches: Batches) -> Batches:
        built = _automaton(lexicon) if lexicon else None
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts: dict[str, list[int]] = {}
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    folded = fold(text or "")
                    found = features(folded) if built is None else KINDS[of](built, folded)
                    for feature in found:
                        counts.setdefault(feature, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(counts), pa.string()),
                        pa.array([c[0] for c in counts.values()], pa.int64()),
                        pa.array([c[1] for c in counts.values()], pa.int64()),
                    ],
                    names=["feature", "clean", "bad"],
                )

    return run


KINDS = {"phrases": phrases, "strongest": strongest}


def _summed(training: DataFrame, lexicon: dict[str, float] | None = None, of: str = "") -> DataFrame:
    counted = in_arrow(training.select("text", "toxic"), _counted(lexicon, of), "feature string, clean long, bad long")
    return counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))


def learn_lexicon(training: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Entries with weights, and exception phrases, from rows of (text, toxic 0 or 1). Only these reach the driver."""
    totals = training.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    n_clean, n_bad = totals[0] or 0, totals[1] or 0
    if not n_bad or not n_clean:
        return {}, []
    ratio = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    # evidence for being likelier: log ratio, less for rare ones
    weight = F.log(ratio) * F.col("bad") / (F.col("bad") + LEAST_DOCUMENTS)
    chosen = (
        _summed(training)
        .filter((F.col("bad") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO))
        .select("feature", weight.alias("weight"))
        .orderBy(F.desc("weight"), "feature")
        .collect()  # features that several texts of the bounded sample have
    )
    weights = {r["feature"]: r["weight"] for r in chosen}
    entries = {f: w for f, w in weights.items() if not _covered(f, weights)}
    if not entries:
        return {}, []
    # entries that only stand beside heavier ones, as the plain words of a copied toxic text, explain nothing
    needed = _summed(training, entries, "strongest").filter(F.col("bad") >= STRONGEST).select("feature").collect()
    entries = {r["feature"]: entries[r["feature"]] for r in needed}
    exceptions = (
        _summed(training, entries, "phrases")
        .filter((F.col("clean") >= LEAST_DOCUMENTS) & (ratio < 1))
        .orderBy(F.desc("clean"), "feature")
        .collect()
    )
    return entries, [r["feature"] for r in exceptions if r["feature"] not in entries]


def _covered(feature: str, weights: dict[str, float]) -> bool:
    """Whether a shorter entry that this one begins with is about as good."""
    return any(weights.get(feature[:n], 0.0) >= 0.8 * weights[feature] for n in range(2, len(feature)))


def _automaton(lexicon: dict[str, float], exceptions: list[str] | None = None) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for entry in exceptions or []:
        built.add_word(entry, (len(entry), None))
    for entry, weight in lexicon.items():
        built.add_word(entry, (len(entry), weight))
    built.make_automaton()
    return built


def unshielded(matches: list[tuple[int, int, float]], shields: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Matches (start, end, weight) that lie in none of the shields (start, end); both come in the order of their ends,
    and are gone through once, from the last."""
    kept = []
    at, reach = len(shields) - 1, math.inf  # the first start of the shields that end here or later
    for match in reversed(matches):
        while at >= 0 and shields[at][1] >= match[1]:
            reach = min(reach, shields[at][0])
            at -= 1
        if reach > match[0]:
            kept.append(match)
    return kept[::-1]


def evidence(built: ahocorasick.Automaton | None, text: str) -> tuple[float, float]:
    """Weight of the matches outside exceptions, damped, and the same per hundred words."""
    folded = fold(text)
    if built is None or len(folded) < 3:
        return 0.0, 0.0
    matches, shields = [], []
    for end, (length, weight) in built.iter(folded):
        if weight is None:
            shields.append((end - length + 1, end))
        else:
            matches.append((end - length + 1, end, weight))
    if shields:
        matches = unshielded(matches, shields)
    if not matches:
        return 0.0, 0.0
    # of entries that begin at the same place the heaviest counts
    best: dict[int, float] = {}
    for start, _, weight in matches:
        best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / folded.count(" "))


def _scorer(lexicon: dict[str, float], exceptions: list[str], curve: list[float] | None, passed: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        built = _automaton(lexicon, exceptions) if lexicon else None
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                pairs = np.array([evidence(built, t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, 2)
                columns = [batch.column(c) for c in passed]
                if curve is None:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=[*passed, "amount", "density"])
                else:
                    margin = curve[0] + pairs @ np.array(curve[1:])
                    score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*passed, "score"])

    return run


def fit_curve(rows: list[tuple[float, float, int, float]], steps: int = 50, ridge: float = 1e-3) -> list[float]:
    """Intercept and two slopes (not negative) of a logistic curve through (amount, density, label, weight)."""
    data = np.array(rows, float)
    x = np.column_stack((np.ones(len(data)), data[:, :2]))
    y, w, weight = data[:, 2], np.zeros(3), data[:, 3] / data[:, 3].mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * len(data) * w * np.array([0, 1, 1])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(data) * np.eye(3)
        w = w + np.linalg.solve(h, g)
        w[1:] = np.maximum(w[1:], 0)
    return [float(v) for v in w]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Judge:
    """A learned lexicon, its exceptions and the curve; scores rows of (doc_id, text)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> None:
        marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        # as many of either label, in the order of a hash: bounded, so it may be broadcast
        first = [marked.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
        picked = cut(first[0].unionAll(first[1]))
        # of several rows of an id one teaches, so what the driver gets is bounded by the sample
        labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        training = cut(labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
        self.lexicon, self.exceptions = learn_lexicon(training)
        self.curve: list[float] | None = None
        if self.lexicon:
            job = _scorer(self.lexicon, self.exceptions, None, ["toxic"])
            seen = in_arrow(training.select("toxic", "text"), job, "toxic int, amount double, density double").collect()
            # each label counts by its share among the labelled rows
            shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
            used = {v: sum(r["toxic"] == v for r in seen) for v in (0, 1)}
            self.curve = fit_curve([(r["amount"], r["density"], r["toxic"], shares[r["toxic"]] / used[r["toxic"]]) for r in seen])

    def scores(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns, which include the text, and the score."""
        if self.curve is None:
            return docs.select(*keep, F.lit(0.0).alias("score"))
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        job = _scorer(self.lexicon, self.exceptions, self.curve, keep)
        rows = docs.select(*dict.fromkeys([*keep, "text"]))
        return in_arrow(rows, job, f"{schema}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold."""
    judge = Judge(docs, labels)
    rows = boxed(docs, F.col("text").alias("text"))
    if judge.curve is None:
        return docs
    scored = in_arrow(
        rows,
        _scorer(judge.lexicon, judge.exceptions, judge.curve, ["row"]),
        f"row {rows.schema['row'].dataType.simpleString()}, score double",
    )
    return scored.filter(F.col("score") < THRESHOLD).select("row.*")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, folder, "documents")
    scored = Judge(docs, table(spark, folder, "labels")).scores(docs, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
