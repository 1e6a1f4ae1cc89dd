"""Near-duplicates by BagMinHash signatures, banding and exact verification.

A text is the multiset of its runs of five words. Weights (multiplicities) are
cut at 1, 2, 4, 8, ...; each element has one Poisson process for every piece
(2^(j-1), 2^j] that its weight reaches, with the piece's length as its rate. The points
of a process carry a time, a signature component and a place in the piece, all
from hashes of the element; where a weight ends inside a piece, the points placed
above it do not count (that is the process of the part below, as in a hierarchy of halved
pieces). A component's value is its first point, so two texts agree in it with a
probability that is their weighted Jaccard similarity. Times are only looked at
up to the one by which all components have points, so rare elements of long texts
cost one hash each.

Texts with equal multisets are one node. Nodes that share a band are candidates;
no bucket is expanded into pairs:

1. Every node of a bucket is compared with the bucket's smallest node by
   signature; what agrees well enough (five standard deviations below the
   threshold) is likely, and makes clusters.
2. Nodes of one bucket but different clusters are compared by signature, in the
   join or, where a bucket has very many of them, in blocks of bounded size, each
   two of which meet in one task. Only links that connect clusters come out, one for
   each two clusters, and clusters so connected are one from then on.
3. Each node's likeliest pair is verified, and the pairs of step 2: the texts are
   fetched once, and the multisets compared.
4. In clusters that verified links leave in several parts, nodes of different parts
   are compared exactly: blocks of bounded size meet in one task, which counts common
   elements through an inverted list and returns the links that connect something.
   Nodes of the largest part are not compared with each other.

Steps 2 and 4 are those whose work grows faster than a group: with the square of
the nodes that share a bucket but not a cluster, and of the near copies that are
similar to each other, but mostly not similar enough.
Classes are the components of the verified links.

Defined cases: null, empty and blank texts are the empty multiset, all in one
class; texts of fewer than five words are one run of all their words; texts are
processed whole; repeated rows fall in one class, and rows of equal id and different
texts are told apart; null ids come first; an empty table gives an empty result; other
columns are left alone. Nodes are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, boxed, in_arrow, ship, slices, table, written
from rowtrace.llm.components import components
from rowtrace.llm.hashing import mix
from rowtrace.llm.substrings import LOWEST, Words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
LEAST_AGREEMENT = 0.62  # five standard deviations below the threshold
ENOUGH = int(LEAST_AGREEMENT * COMPONENTS)
BLOCK = 1024  # nodes of a cluster that are compared with as many others in one task
BLOCK_BYTES = 4 << 20  # of their texts
BIG = 1000  # nodes of a bucket beyond which it is dealt into blocks of as many
BATCH_BYTES = 1 << 20
ROW_COST = 2_000  # bytes that a text's signature takes while it is worked out, at least


def multisets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight), sorted by text and element."""
    words = Words(texts, (0,))
    n = np.diff(np.append(words.first, words.n))
    runs = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), runs)
    offset = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = words.first[text] + offset
    element = words.hashes(starts, starts + np.minimum(n[text], SHINGLE), 0)
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return text[at], element[at], np.diff(np.append(at, len(text)))


def processes(text: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, process id, rate, share of the piece that counts) of every piece that a weight reaches."""
    parts = [(text, mix(element, 20), np.ones(len(text)), np.ones(len(text)))]
    low, level = 1, 1
    top = int(weight.max()) if len(weight) else 0
    while low < top:
        at = np.flatnonzero(weight > low)
        share = np.minimum((weight[at] - low) / low, 1.0)
        parts.append((text[at], mix(element[at], 20 + level), np.full(len(at), float(low)), share))
        low, level = low * 2, level + 1
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))  # type: ignore[return-value]


def signatures(count: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int = COMPONENTS) -> np.ndarray:
    """count x size values; two texts agree in a column with the probability of their weighted Jaccard similarity."""
    of, ident, rate, share = processes(text, element, weight)
    total = np.bincount(text, weight, count)
    values = np.zeros((count, size), np.uint64)
    first = np.full((count, size), np.inf)
    horizon = np.zeros(count)
    filled = total > 0
    horizon[filled] = size * (np.log(size) + 4) / total[filled]
    open_text = filled.copy()
    while open_text.any():
        rows = np.flatnonzero(open_text[of])
        time, number = np.zeros(len(rows)), np.uint64(0)
        while len(rows):
            number += np.uint64(1)
            with np.errstate(over="ignore"):
                draw = mix(ident[rows] + number * np.uint64(0x9E3779B97F4A7C15), 40)
            time = time - np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate[rows]
            alive = time <= horizon[of[rows]]
            rows, time, draw = rows[alive], time[alive], draw[alive]
            more = mix(draw, 41)
            column = (more % np.uint64(size)).astype(np.int64)
            place = (mix(draw, 42) >> np.uint64(11)).astype(float) * 2.0**-53
            counts = np.flatnonzero(place < share[rows])
            slot = of[rows[counts]] * size + column[counts]
            flat, chosen = first.reshape(-1), values.reshape(-1)
            np.minimum.at(flat, slot, time[counts])
            best = time[counts] == flat[slot]
            chosen[slot[best]] = draw[counts[best]]
        # a component without a point needs a later horizon; the points found before are found again
        open_text &= np.isinf(first).any(axis=1)
        horizon[open_text] *= 2
    return values


def _sign(batches: Batches) -> Batches:
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES, ROW_COST):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            text, element, weight = multisets(texts)
            values = mix(signatures(len(texts), text, element, weight))
            with np.errstate(over="ignore"):
                parts = (mix(element, 60) + weight.astype(np.uint64)) * np.uint64(0xD1342543DE82EF95)
                node = np.zeros(len(texts), np.uint64)
                np.add.at(node, text, mix(parts, 61))
                powers = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, ROWS + 1, dtype=np.uint64)
                bands = (values.reshape(len(texts), BANDS, ROWS) * powers).sum(axis=2, dtype=np.uint64)
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9), 62)
            short = (values & np.uint64(255)).astype(np.uint8).view(np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k1", "k2")),
                    pa.array(mix(node, 63).view(np.int64)),
                    _lists(bands.view(np.int64)),
                    _lists(short),
                ],
                names=["doc_id", "k1", "k2", "node", "bands", "short"],
            )


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list column from the rows of an array."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1]) if len(rows) else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.reshape(-1)))


def agreement(a: Column, b: Column) -> Column:
    """Number of components in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, same: n + same)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted elements and weights."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def _verify(batches: Batches) -> Batches:
    for whole in batches:
        for batch in slices(whole, "text_a", BATCH_BYTES):
            pairs = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")]
            numbers: dict[bytes, int] = {}
            left, right = ([numbers.setdefault(t or b"", len(numbers)) for t in side] for side in pairs)
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            for part in _runs_of(list(numbers)):
                text, element, weight = multisets(part)
                edges = np.searchsorted(text, np.arange(len(part) + 1))
                sets += [(element[x:y], weight[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            keep = [similarity(sets[x], sets[y]) >= THRESHOLD for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _runs_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    run: list[bytes] = []
    held = 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held > BATCH_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def has_repeated_rows(rows: DataFrame) -> bool:
    """Whether any row occurs twice with its id and text."""
    twice = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    return bool(twice.count())


class Search:
    """The tables that both rounds read."""

    def __init__(self, docs: DataFrame) -> None:
        self.texts = docs.select(
            "doc_id",
            "text",
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k1"),
            F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k2"),
        )
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.signed = written(
            in_arrow(self.texts, _sign, f"doc_id {kind}, k1 long, k2 long, node long, bands array<long>, short array<tinyint>"),
            "signatures",
        )
        # one row for each node: its first document, which has the node's text
        self.nodes = written(
            self.signed.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("at"), F.first("bands").alias("bands"), F.first("short").alias("short")), "nodes"
        )
        rows = self.signed.select("node", F.explode("bands").alias("bucket"))
        shared = written(
            rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("node").alias("pivot"), F.max("node").alias("_high")).filter("pivot <> _high").drop("_high"),
            "buckets",
        )
        self.members = written(
            rows.join(shared, F.col("bucket") == F.col("_bucket")).select("bucket", "node", "pivot").distinct(), "members"
        )

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose signatures allow the threshold, and in how many components they agree."""
        short = self.nodes.select("node", "short")
        left = pairs.join(short.withColumnsRenamed({"node": "a", "short": "short_a"}), "a")
        both = left.join(short.withColumnsRenamed({"node": "b", "short": "short_b"}), "b")
        return both.select("a", "b", agreement(F.col("short_a"), F.col("short_b")).alias("same")).filter(F.col("same") >= ENOUGH)

    def fetched(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes in `wanted`, which has each once."""
        places = written(self.nodes.join(wanted.select("node"), "node").select("node", "at.k1", "at.k2"), "places")
        found = self.texts.select("k1", "k2", "text").join(places.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")
        return written(found.dropDuplicates(["node"]) if has_repeated_rows(self.signed) else found, "texts")

    def across(self, clusters: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that share a bucket and whose signatures allow the threshold: enough of them to connect all
        clusters which any such pair connects, and at most one for two clusters and, in large buckets, block."""
        placed = self.members.join(clusters, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = written(placed, "placed")
        mixed = (
            placed.groupBy(F.col("bucket").alias("_bucket"))
            .agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("n"))
            .filter("_low <> _high and n > 2")
            .select("_bucket", "n")
        )
        open_ = written(
            placed.filter("node <> pivot").join(written(mixed, "mixed"), F.col("bucket") == F.col("_bucket")).drop("_bucket", "pivot"),
            "open",
        )
        known = open_.join(self.nodes.select("node", "bands", "short"), "node")
        side = written(known.filter(F.col("n") <= BIG).select("node", "root", "short", "bucket"), "sides")
        other = side.withColumnsRenamed({"node": "b", "root": "_root", "short": "_short", "bucket": "_bucket"})
        met = (F.col("bucket") == F.col("_bucket")) & (F.col("node") < F.col("b")) & (F.col("root") != F.col("_root"))
        alike = agreement(F.col("short"), F.col("_short"))
        pairs = side.join(other, met & (alike >= ENOUGH)).select(
            F.col("node").alias("a"), "b", alike.alias("same"), F.least("root", "_root").alias("r"), F.greatest("root", "_root").alias("s")
        )
        # the likeliest pair of each two clusters
        small = pairs.groupBy("r", "s").agg(F.max(F.struct("same", "a", "b")).alias("best")).select("best.a", "best.b")
        blocks = F.ceil(F.col("n") / BIG).cast("int")
        large = known.filter(F.col("n") > BIG).select("node", "root", "short", "bucket", blocks.alias("blocks"))
        large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "node", "root", "short", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
        )
        ship(self.texts.sparkSession)
        connecting = dealt.groupBy("bucket", "i", "j").applyInArrow(_connect_block, "a long, b long").distinct()
        return small.unionAll(connecting)

    def within(self, clusters: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
        """Links between nodes of one cluster that verified links don't connect yet.

        The nodes of a cluster's largest part and the others are dealt into blocks
        apart. Two blocks meet in one task, unless both are of the largest part; it
        returns the links that connect something, not all it finds.
        """
        placed = clusters.withColumnRenamed("root", "cluster").join(roots, "node", "left")
        placed = written(placed.select("node", "cluster", F.coalesce("root", "node").alias("root")), "clusters")
        parts = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = (
            parts.groupBy(F.col("cluster").alias("_cluster"))
            .agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
            .filter("parts > 1")
            .select("_cluster", F.col("most.root").alias("largest"), F.col("most.n").alias("n_largest"), "all")
        )
        mixed = written(mixed, "mixed")
        sizes = placed.join(mixed, F.col("cluster") == F.col("_cluster")).drop("_cluster").join(texts, "node")
        sizes = written(sizes.withColumn("inner", F.col("root") == F.col("largest")), "compared")
        heavy = sizes.groupBy(F.col("cluster").alias("_cluster"), F.col("inner").alias("_inner")).agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / BLOCK_BYTES)).cast("int").alias("blocks")
        )
        counts = heavy.groupBy("_cluster").agg(
            F.max(F.when(F.col("_inner"), F.col("blocks"))).alias("inner_blocks"), F.max(F.when(~F.col("_inner"), F.col("blocks"))).alias("outer_blocks")
        )
        rows = sizes.join(counts, F.col("cluster") == F.col("_cluster"))
        # blocks of the largest part are numbered after the others; those meet all, these only the others
        own = F.when(F.col("inner"), F.col("outer_blocks") + F.pmod(F.xxhash64("node"), F.col("inner_blocks"))).otherwise(
            F.pmod(F.xxhash64("node"), F.col("outer_blocks"))
        )
        others = F.when(F.col("inner"), F.col("outer_blocks")).otherwise(F.col("outer_blocks") + F.col("inner_blocks"))
        dealt = rows.select(
            "node", "root", "text", "cluster", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))).alias("other")
        ).select("node", "root", "text", "cluster", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        ship(self.texts.sparkSession)
        return dealt.groupBy("cluster", "i", "j").applyInArrow(_link_block, "a long, b long")


def _connect_block(group: pa.Table) -> pa.Table:
    """Pairs of two blocks of a bucket (or of one with itself) that connect their clusters, by signature."""
    nodes, roots, own = (group.column(c).to_numpy() for c in ("node", "root", "own"))
    short = np.array(group.column("short").to_pylist(), np.int8).reshape(len(nodes), -1)
    parent = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    links: list[tuple[int, int]] = []
    for k, x in enumerate(left.tolist()):
        others = right[k + 1 :] if i == j else right
        likely = (short[others] == short[x]).sum(axis=1) >= ENOUGH
        for y in others[likely & (roots[others] != roots[x])].tolist():
            a, b = find(int(roots[x])), find(int(roots[y]))
            if a != b:
                parent[a] = b
                links.append((min(int(nodes[x]), int(nodes[y])), max(int(nodes[x]), int(nodes[y]))))
    return pa.table([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


class Holders:
    """Which of some sets hold an element."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(element, kind="stable")
        self.count, self.element, self.owner = len(sets), element[order], owner[order]

    def common(self, elements: np.ndarray) -> np.ndarray:
        """How many of the distinct `elements` each set holds."""
        low = np.searchsorted(self.element, elements, side="left")
        n = np.searchsorted(self.element, elements, side="right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=self.count)


def occurrences(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each occurrence of the elements of a multiset: the common ones of two are their common weight."""
    number = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return mix(np.repeat(element, weight) + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 64)


def _link_block(group: pa.Table) -> pa.Table:
    """Verified links of two blocks of a cluster (or of one with itself) that connect their parts."""
    nodes, roots, own = (group.column(c).to_numpy() for c in ("node", "root", "own"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    parent = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    links: list[tuple[int, int]] = []
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if len(parent) > 1 and len(left) and len(right):
        whole: list[np.ndarray] = []  # occurrences of each node
        for part in _runs_of([t or b"" for t in group.column("text").cast(pa.binary()).to_pylist()]):
            text, element, weight = multisets(part)
            edges = np.searchsorted(text, np.arange(len(part) + 1))
            whole += [occurrences(element[x:y], weight[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        total = np.array([len(w) for w in whole])
        holders = Holders([whole[y] for y in right])
        for x in left.tolist():
            common = holders.common(whole[x])
            united = total[x] + total[right] - common
            alike = np.where(united > 0, common >= THRESHOLD * united, True) & (roots[right] != roots[x])
            for y in right[alike].tolist():
                a, b = find(int(roots[x])), find(int(roots[y]))
                if a != b:
                    parent[a] = b
                    links.append((int(nodes[x]), int(nodes[y])))
    return pa.table([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose texts reach the threshold."""
    with_a = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return in_arrow(both.select("a", "b", "text_a", "text_b"), _verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and class_id (the smallest id of the class; null if that is a null id) of every row."""
    search = Search(docs)
    stars = search.members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = written(search.agreeing(stars), "near")
    clusters = written(components(near.select("a", "b")), "clusters")
    across = written(search.across(clusters), "across")
    if across.limit(1).count():
        clusters = written(components(near.select("a", "b").unionAll(across)), "clusters")
    texts = search.fetched(clusters)
    best = near.groupBy("a").agg(F.max(F.struct("same", "b")).alias("best")).select("a", "best.b")
    links = written(verified(best.unionAll(across), texts), "links")
    roots = written(components(links), "roots")
    more = written(search.within(clusters, roots, texts), "links")
    if more.limit(1).count():
        roots = written(components(links.unionAll(more)), "roots")
    rows = search.signed.select("doc_id", "k1", "k2", "node").join(roots, "node", "left")
    rows = rows.select("doc_id", "k1", "k2", F.coalesce("root", "node").alias("root"))
    heads = written(rows.groupBy(F.col("root").alias("_root")).agg(F.min("k1").alias("head")), "heads")
    classed = rows.join(heads, F.col("root") == F.col("_root"))
    return classed.select("doc_id", "k1", "k2", F.when(F.col("head") != LOWEST, F.col("head")).alias("class_id"), "root")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest id, of equal ids that with the smallest text hash."""
    classed = written(near_duplicates(docs).select("k1", "k2", "root"), "classed")
    first = written(classed.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("at")).select("at.k1", "at.k2"), "firsts")
    keyed = boxed(
        docs,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k1"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k2"),
    )
    kept = keyed.join(first, ["k1", "k2"])
    if has_repeated_rows(classed):
        kept = kept.dropDuplicates(["k1", "k2"])
    return kept.select("row.*")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and class_id of every document."""
    classed = near_duplicates(table(spark, folder, "documents"))
    return classed.select("doc_id", "class_id")
