"""Main text of web pages: markup first, and a suffix array of each host's pages for what markup leaves open.

A page is read as blocks of text (ended by block-level tags). The markup claims
blocks as main text (inside `article`, `main`) or as furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments, by tag, role or class), or
leaves them open. The token streams of pages of one host are joined, with block ends
as tokens, and their suffixes are sorted by the first LENGTH tokens; equal
neighbours of different pages are repeated passages. An open block that repeated
passages mostly cover is boilerplate. The text of a page is its main blocks and its
open blocks that are not boilerplate, in order. Main blocks are kept though they may
be repeated: hosts republish articles. Beside main blocks, open ones count only where
neighbours of them have LENGTH words together that are not repeated; fewer are strays.

Every page goes through the suffix array of its group: the pages of a host, dealt into
groups of bounded bytes where there are more; most hosts are one group. For hosts of
several groups that have an open block, hashes of passages of LENGTH tokens are
aggregated over the host: what an open block has and another page too is handed to the
groups that hold it. Without open blocks, what other groups repeat decides nothing.

Defined cases: a null or empty page has an empty text; a null url, or one without
host, belongs to the empty host; unclosed tags and comments are taken to the end
of what holds them; pages are processed whole; rows of one id are one page, so
repeated rows give equal texts, and are not different pages; rows without an id are
one page if their html is equal; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import html as entities
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import Batches, in_arrow, prefix_sums, ship, slices, slices_by, table, utf8_bytes, written
from rowtrace.llm.hashing import mix, powers, word_hashes
from rowtrace.llm.urls import host_and_path

LENGTH = 8  # tokens of a repeated passage, at least
COVERED = 0.5  # of a block's tokens
GROUP_BYTES = 8 << 20  # of block text in a group of pages (or one page)
BATCH_BYTES = 4 << 20

MAIN, OPEN, FURNITURE = 2, 1, 0

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title|svg|iframe|object|canvas|select|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[/a-z!?][^>]*>",
    re.S | re.I,
)
_attribute = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_name_part = re.compile(r"[a-z0-9]+")

CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table tbody thead tr td th figure "
    "blockquote fieldset details dialog menu center".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend option".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu button".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored comment comments respond disqus sidebar nav navbar navigation "
    "menu footer cookie cookies consent notice banner popup modal newsletter subscribe signup login social share sharing "
    "related breadcrumb breadcrumbs promo widget pagination pager masthead".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())


def _claim(tag: str, attributes: str, in_main: bool) -> int:
    """What an element says of its content."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_main):
        return FURNITURE
    said = OPEN
    if attributes and tag not in ("html", "body"):
        for name, *values in _attribute.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                parts = set(_name_part.findall(value))
                if parts & FURNITURE_NAMES or ("header" in parts and not in_main):
                    return FURNITURE
            elif name == "role":
                if value in FURNITURE_ROLES:
                    return FURNITURE
                said = MAIN if value == "main" else said
            elif name == "aria-hidden" and value == "true":
                return FURNITURE
    return MAIN if tag in ("article", "main") else said


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, claim) of the blocks of a page that have text, in order."""
    found: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and what holds inside them
    now = OPEN

    def close() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                found.append((text, now))
            pieces.clear()

    at = 0
    for match in _markup.finditer(page):
        if match.start() > at:
            pieces.append(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag in BLOCKS:
            close()
            while stack and stack[-1][0] not in CONTAINERS:  # a marked paragraph ends at the next block
                stack.pop()
            if match["end"]:
                if tag in CONTAINERS and any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                outer = stack[-1][1] if stack else OPEN
                claim = FURNITURE if outer == FURNITURE else _claim(tag, match["attributes"], outer == MAIN)
                if tag in CONTAINERS or claim == FURNITURE:
                    if not match["attributes"].endswith("/"):
                        stack.append((tag, claim if claim != OPEN else outer))
            now = stack[-1][1] if stack else OPEN
    if at < len(page):
        pieces.append(page[at:])
    close()
    return found


def repeated_tokens(streams: list[np.ndarray], pages: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each token stream, which tokens lie in a passage of `length` tokens that another page has too."""
    sizes = np.array([len(s) for s in streams])
    if not sizes.sum():
        return [np.zeros(n, bool) for n in sizes]
    joined = np.concatenate(streams)
    owner = np.repeat(np.arange(len(streams)), sizes)
    # ranks of the suffixes by their first 1, 2, 4, ... tokens
    rank, known = np.unique(joined, return_inverse=True)[1].astype(np.int64), 1
    while known < length:
        step = min(known, length - known)
        following = np.full(len(rank), -1)
        following[: max(0, len(rank) - step)] = rank[step:]
        rank, known = np.unique(rank * (len(joined) + 1) + following + 1, return_inverse=True)[1].astype(np.int64), known + step
    inside = np.zeros(len(joined), bool)
    whole = len(joined) - length + 1
    if whole > 0:
        inside[:whole] = owner[:whole] == owner[length - 1 :]
    suffixes = np.flatnonzero(inside)
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    page = pages[owner[suffixes]]
    begins = np.flatnonzero(np.append(True, np.diff(rank[suffixes]) != 0)[: len(suffixes)])
    change = np.zeros(len(joined) + 1, np.int64)
    if len(begins):
        several = np.minimum.reduceat(page, begins) != np.maximum.reduceat(page, begins)
        hit = suffixes[np.repeat(several, np.diff(np.append(begins, len(suffixes))))]
        change[hit] += 1  # suffixes are distinct
        np.add.at(change, hit + length, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.split(covered, np.cumsum(sizes)[:-1])


def _stream(found: list[tuple[str, int]]) -> np.ndarray:
    """Hashes of a page's words, with one token after each block."""
    data = np.frombuffer("\x00".join(t for t, _ in found).encode("utf-8") + b"\x00", np.uint8)
    blank = (data == 0x20) | (data == 0)
    edges = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    starts = np.flatnonzero(edges == -1)
    ends = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
    words = mix(word_hashes(data, starts, ends))
    stops = np.searchsorted(starts, np.flatnonzero(data == 0))
    return np.insert(words, stops, 0)


def _kept(found: list[tuple[str, int]], stream: np.ndarray, mask: np.ndarray) -> list[str]:
    """The blocks of a page's text: what markup claims, and open ones that repeats do not cover."""
    ends = np.flatnonzero(stream == 0)
    starts = np.concatenate(([0], ends + 1))
    beside = any(claim == MAIN for _, claim in found)
    kept: list[str] = []
    at = 0
    for claim, run in itertools.groupby(found, lambda block: block[1]):
        texts = [t for t, _ in run]
        spans = list(zip(starts[at : at + len(texts)], ends[at : at + len(texts)], strict=True))
        at += len(texts)
        if claim == MAIN:
            kept += texts
        elif claim == OPEN and (not beside or sum(int((~mask[a:b]).sum()) for a, b in spans) >= LENGTH):
            kept += [t for t, (a, b) in zip(texts, spans, strict=True) if mask[a:b].sum() < COVERED * max(b - a, 1)]
    return kept


def passages(streams: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where the passages of `length` tokens of all streams, joined, begin, and their hashes."""
    sizes = np.array([len(s) for s in streams], np.int64)
    n = int(sizes.sum()) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = mix(np.concatenate(streams), 50)
    owner = np.repeat(np.arange(len(streams)), sizes)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(powers(0x9E3779B97F4A7C15, length)):
            total += joined[j : j + n] * factor
    at = np.flatnonzero(owner[:n] == owner[length - 1 :])
    return at, mix(total[at], 51)


def _tokens_of(pages: list[list[tuple[str, int]]]) -> list[np.ndarray]:
    return [_stream(p) if p else np.zeros(0, np.uint64) for p in pages]


BLOCKS_TYPE = "array<struct<text:string,claim:tinyint>>"


def _parsed(batches: Batches) -> Batches:
    """The blocks of every page, their bytes, and whether one of them is open."""
    for whole in batches:
        for batch in slices(whole, "html", BATCH_BYTES):
            pages = [blocks(p or "") for p in batch.column("html").to_pylist()]
            names = [c for c in batch.schema.names if c != "html"]
            flat = [block for found in pages for block in found]
            texts, claims = pa.array([t for t, _ in flat], pa.string()), pa.array([c for _, c in flat], pa.int8())
            ends = np.concatenate(([0], np.cumsum([len(found) for found in pages])))
            sizes = np.concatenate(([0], np.cumsum([len(t.encode("utf-8")) for t, _ in flat], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(np.diff(sizes[ends])),
                    pa.array([any(c == OPEN for _, c in found) for found in pages], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([texts, claims], names=["text", "claim"])),
                ],
                names=[*names, "bytes", "open", "blocks"],
            )


def _open_hosts(batches: Batches) -> Batches:
    """Hosts of pages that have an open block."""
    for batch in batches:
        found = {h for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) if any(c == OPEN for _, c in blocks(p or ""))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["_host"])


def _pages_of(column: pa.Array) -> list[list[tuple[str, int]]]:
    flat = column.flatten()
    pairs = list(zip(flat.field("text").to_pylist(), flat.field("claim").to_pylist(), strict=True))
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
    return [pairs[a:b] for a, b in itertools.pairwise(ends)]


def _passages(batches: Batches) -> Batches:
    """(host, group, page, passage, open) of the pages, each once in a batch; `open` if it starts in an open block."""
    for whole in batches:
        for batch in slices_by(whole, whole.column("bytes").to_numpy(), BATCH_BYTES):
            pages = _pages_of(batch.column("blocks"))
            streams = _tokens_of(pages)
            at, key = passages(streams)
            sizes = [len(s) for s in streams]
            owner = np.repeat(np.arange(len(streams)), sizes)[at]
            claims = np.concatenate([np.zeros(0, np.int8), *(_claims(p, s) for p, s in zip(pages, streams, strict=True))])
            # any open token: a passage may begin before the block that it reaches into
            reach = np.concatenate(([0], np.cumsum(claims == OPEN)))
            is_open = reach[at + LENGTH] > reach[at]
            order = np.lexsort((~is_open, key, owner))
            owner, key, is_open = owner[order], key[order], is_open[order]
            new = np.ones(len(key), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            rows = pa.array(owner[new])
            columns = [batch.column(c).take(rows) for c in ("number", "group", "page")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(key[new].view(np.int64)), pa.array(is_open[new])], names=["number", "group", "page", "passage", "open"]
            )


def _claims(found: list[tuple[str, int]], stream: np.ndarray) -> np.ndarray:
    """The claim of each token's block."""
    ends = np.flatnonzero(stream == 0)
    return np.repeat(np.array([c for _, c in found], np.int8), np.diff(np.concatenate(([-1], ends))))


def _covered(streams: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """For each token stream, which tokens lie in one of the known passages."""
    sizes = np.array([len(s) for s in streams], np.int64)
    at, key = passages(streams)
    hit = at[np.isin(key, known)]
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + LENGTH, -1)
    return np.split(np.cumsum(change[:-1]) > 0, np.cumsum(sizes)[:-1])


def _texts(group: pa.Table, known: pa.Table) -> pa.Table:
    """Texts of the pages of a group; `known`: passages in open blocks of the group that other pages have too."""
    pages = _pages_of(group.column("blocks").combine_chunks()) if group.num_rows else []
    streams = _tokens_of(pages)
    masks = repeated_tokens(streams, group.column("page").to_numpy())
    if known.num_rows:
        more = _covered(streams, known.column("passage").to_numpy().view(np.uint64))
        masks = [a | b for a, b in zip(masks, more, strict=True)]
    kept = ["\n\n".join(_kept(*parts)) for parts in zip(pages, streams, masks, strict=True)]
    return pa.table([group.column("page_id"), group.column("url"), pa.array(kept, pa.string())], names=["page_id", "url", "text"])


def _texts_alone(group: pa.Table) -> pa.Table:
    """Texts of the pages of a group for which other groups decide nothing."""
    return _texts(group, group.slice(0, 0))


def extract_main_text(pages: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    page = F.when(F.col("page_id").isNotNull(), F.xxhash64("page_id")).otherwise(F.xxhash64(F.lit("no id"), "html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host.alias("host"), page.alias("page"))
    types = f"page_id {kind}, url string, host string, page long, %sbytes long, open boolean, blocks {BLOCKS_TYPE}"
    # hosts of more bytes than a group: no more of them than groups
    totals = rows.groupBy(F.col("host").alias("_host")).agg(F.sum(utf8_bytes(F.col("html"))).alias("total"))
    totals = totals.filter(F.col("total") > group_bytes)
    crowded = written(totals.select("_host", F.ceil(F.col("total") / group_bytes).cast("long").alias("groups")), "hosts")
    here = F.col("host") == F.col("_host")
    of_crowded = rows.join(crowded, here, "left_semi").select("host", "html")
    unsettled = written(in_arrow(of_crowded, _open_hosts, "_host string").distinct(), "hosts")
    # copies of a page are dealt as well
    dealt = F.pmod(F.xxhash64("page", F.monotonically_increasing_id()), F.coalesce("groups", F.lit(1).cast("long")))
    alone = rows.join(unsettled, here, "left_anti").join(crowded, here, "left").select(*rows.columns, dealt.alias("group"))
    blocked = in_arrow(alone, _parsed, types % "group long, ").select("page_id", "url", "host", "page", "group", "blocks")
    result = blocked.groupBy("host", "group").applyInArrow(_texts_alone, f"page_id {kind}, url string, text string")
    if unsettled.limit(1).count():
        several = written(in_arrow(rows.join(unsettled, here, "left_semi"), _parsed, types % ""), "blocks")
        result = result.unionAll(_judged(several, kind, group_bytes))
    return result.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _judged(parsed: DataFrame, kind: str, group_bytes: int) -> DataFrame:
    """page_id, url, text of the pages of hosts that are several groups and have open blocks."""
    placed = prefix_sums(parsed, ["page"], ["bytes"], ["host"])
    group = F.floor(F.col("before_bytes") / group_bytes).cast("long")
    placed = written(placed.select("page_id", "url", F.xxhash64("host").alias("number"), group.alias("group"), "page", "bytes", "blocks"), "placed")
    several = placed.groupBy(F.col("number").alias("_number")).agg(F.max("group").alias("last")).filter("`last` > 0").select("_number")
    large = placed.join(several, F.col("number") == F.col("_number"), "left_semi")
    found = in_arrow(large.select("number", "group", "page", "bytes", "blocks"), _passages, "number long, group long, page long, passage long, open boolean")
    # of each passage: pages, and the groups that have it in an open block, each once for a batch
    found = written(found, "passages")
    spread = found.groupBy("number", "passage").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.max("open").alias("any"))
    repeated = spread.filter("low <> high and any").select(F.col("number").alias("_n"), F.col("passage").alias("_p"))
    asked = found.filter("open").select("number", "group", "passage")
    known = asked.join(repeated, (F.col("number") == F.col("_n")) & (F.col("passage") == F.col("_p")), "left_semi").distinct()
    schema = f"page_id {kind}, url string, text string"
    keys = ["number", "group"]
    return placed.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_texts, schema)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_main_text(table(spark, folder, "pages"))
