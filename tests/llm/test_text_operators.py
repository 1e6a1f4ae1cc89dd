"""Substring dedup, decontamination, fingerprints, token counts and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import documents, empty, sentence, texts
from tokenizers import Tokenizer

from rowtrace.llm import decontamination, merkle, neardup, registry, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows, length):
    """(n_words, n_removed, kept) for each distinct (id, text), by the definition."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in distinct:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id, text] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_words_are_removed(spark):
    # ids that several different texts share have no order of their own here
    rows = [(i, t) for i, t, _ in texts() if i not in (None, 12)] + [(None, sentence(7, 40))]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = substrings.remove_repeats(docs, 20, digest=True).collect()
    want = brute_repeats(rows, 20)
    assert len(got) == len(rows)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *want[i, t])) for i, t in rows)


def test_removed_words_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(registry.sql()["op2_substring_dedup"]).fetchall()
    got = substrings.op2_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("length", [6, 13])
def test_repeats_in_dense_text(spark, length):
    r = random.Random(length)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 90)))) for i in range(60)]
    got = substrings.remove_repeats(documents(spark, [(i, t, "s") for i, t in rows]), length, digest=True).collect()
    want = brute_repeats(rows, length)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: want[i, t] for i, t in rows}


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
    kept = substrings.remove_repeats(documents(spark, [(1, None, None), (2, "a\tb", None)])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in kept) == [(1, 0, ""), (2, 2, "a b")]


def test_overlaps_with_substitutions(spark):
    item = sentence(50, 40)
    words = item.split()
    swapped = [w if i % 7 else "other" for i, w in enumerate(words)]
    rows = [
        (1, sentence(51, 100) + " " + item.upper() + ", " + sentence(52, 100), "s"),
        (2, sentence(53, 30) + " " + " ".join(swapped) + " " + sentence(54, 30), "s"),
        (3, sentence(55, 300), "s"),
        (4, sentence(56, 20) + " " + " ".join(words[:12]) + " " + sentence(57, 20), "s"),
        (5, None, "s"),
        (6, "", "s"),
        (1, sentence(51, 100) + " " + item.upper() + ", " + sentence(52, 100), "s"),
    ]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item), (10, "")], "item_id long, text string")
    got = decontamination.overlaps(documents(spark, rows), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(1, 7): 2, (1, None): 2, (2, 7): 1, (2, None): 1}
    assert {r["equal_tokens"] for r in got if r["doc_id"] == 1} == {40}
    assert {r["start"] for r in got if r["doc_id"] == 1} == {100}
    # blocks of one item each give the same pairs
    again = decontamination.overlaps(documents(spark, rows), bench, block_bytes=10).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    kept = decontamination.decontaminate(documents(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert kept.columns == documents(spark, rows).columns
    assert decontamination.overlaps(empty(spark), bench).count() == 0
    assert decontamination.overlaps(documents(spark, rows), bench.limit(0)).count() == 0


def test_overlaps_in_parts():
    item = sentence(80, 60).split()
    block = decontamination.Block([(1, " ".join(item)), (2, " ".join(sentence(81, 300).split()))])
    around = [sentence(82, 40), sentence(83, 40)]
    spread = [*item[:20], "inserted", *item[20:40], "again", *item[40:]]
    back = [*item[:20], "inserted", *item[20:40], *item[41:]]
    texts_ = [around[0] + " " + " ".join(x) + " " + around[1] for x in (spread, back, sentence(81, 300).split()[50:150], item[5:18], item[5:17])]
    hashes, first = decontamination.tokens(texts_)
    got = {(t, b): (start, equal, stretch) for t, b, start, equal, stretch in block.overlaps(hashes, first)}
    assert got[0, 0][:2] == (40, 60) and got[1, 0][:2] == (40, 59)
    assert got[2, 1] == (40, 100, 100)
    assert got[3, 0][2] == 13 and got[4, 0][2] == 12


def test_passages_shorter_than_half_an_item(spark):
    words = sentence(81, 300).split()
    spread = sentence(80, 60).split()
    spread = [*spread[:20], "inserted", *spread[20:40], "again", *spread[40:]]
    rows = [(1, " ".join(words[50:150]), "s"), (2, " ".join(words[50:62]), "s"), (3, " ".join(spread), "s"), (4, sentence(84, 300), "s")]
    bench = spark.createDataFrame([(1, sentence(80, 60)), (2, " ".join(words))], "item_id long, text string")
    got = decontamination.overlaps(documents(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["equal_tokens"]) for r in got) == [(1, 2, 100), (3, 1, 60)]


def test_fingerprints(spark):
    rows = [(i, t) for i, t, _ in texts() if i is not None]
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    got = sorted(merkle.fingerprints(documents(spark, [(i, t, "s") for i, t in rows])).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1] or ""
        changed = merkle.edited(t or "", following)
        n = len(t or "") // 4
        assert changed == (t or "")[: len(t or "") - n] + following[:n]
        want.append((i, len(t or ""), hashlib.sha256(changed.encode()).hexdigest(), *merkle.trees([(t or "").encode(), changed.encode()])))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert merkle.fingerprints(empty(spark)).count() == 0
    only = merkle.fingerprints(documents(spark, [(None, "a b c d", None)])).first()
    assert only["near_next"] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c\n", max_size=60), min_size=1, max_size=6))
def test_trees_tell_texts_apart(found):
    raw = [t.encode() for t in found]
    trees = merkle.trees(raw)
    assert trees == [merkle.trees([t])[0] for t in raw]  # a tree depends on its own text only
    for a, x in zip(raw, trees, strict=True):
        for b, y in zip(raw, trees, strict=True):
            assert (a == b) == (x == y) == (x.partition(":")[0] == y.partition(":")[0])


def test_differing_paragraphs_are_located():
    lines = [sentence(i, 12) + "\n" for i in range(60)]
    other = [*lines]
    other[17] = sentence(99, 12) + "\n"
    a, b = merkle.trees(["".join(lines).encode(), "".join(other).encode()])
    assert merkle.differing(a, b) == merkle.differing(b, a) == [17]
    assert merkle.differing(a, a) == []
    assert merkle.likeness(merkle.leaves(a), merkle.leaves(b)) > 0.9


@pytest.fixture(scope="module")
def merger():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return tokens.Merger(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="a 'streavdl\n\t1.é <|endoftxt>", max_size=80), max_size=5))
def test_token_counts_equal_the_library(merger, library, found):
    found = [t.encode("utf-8", "ignore").decode() for t in found]
    assert merger.count(found) == [len(e.ids) for e in library.encode_batch(found, add_special_tokens=False)]
    pattern = regex.compile(tokens.PATTERN)
    for t in found:
        starts, ends, _ = tokens.pre_tokens(t, np.array([len(t)]))
        assert [t[a:b] for a, b in zip(starts, ends, strict=True)] == pattern.findall(t)


def test_token_counts(spark, library):
    rows = [*texts(), (300, "a<|endoftext|>b<|endoftext|>", "s"), (301, "x" * 30_000, "s"), (302, "don't we'll 'tis ''s", "s")]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        got = tokens.count_tokens(documents(spark, rows), file.read()).collect()
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def brute_classes(rows):
    """Class (smallest id) of each row, and number of classes: components of weighted Jaccard >= 0.8 on runs of five words."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common, both = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
            if common >= 0.8 * both:
                parent[find(a)] = find(b)
    heads = {}
    for a, (i, _) in enumerate(rows):
        heads.setdefault(find(a), []).append(i)
    return [None if None in heads[find(a)] else min(heads[find(a)]) for a in range(len(rows))], len(heads)


def near_rows():
    rows = [(i, t) for i, t, _ in texts()]
    base = sentence(60, 200).split()
    for k in range(25):  # a chain: each is near the one before, the ends are not
        base[8 * k % 200] = f"new{k}"
        rows.append((400 + k, " ".join(base)))
    return rows


def test_near_duplicate_classes(spark):
    rows = near_rows()
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = neardup.near_duplicates(docs).select("doc_id", "class_id").collect()
    want = list(zip([i for i, _ in rows], brute_classes(rows)[0], strict=True))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == brute_classes(rows)[1]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BIG", 2)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = near_rows()
    got = neardup.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows])).select("doc_id", "class_id").collect()
    want = list(zip([i for i, _ in rows], brute_classes(rows)[0], strict=True))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_pairs_of_a_crowded_bucket_need_no_other_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BIG", 2)
    r = np.random.default_rng(4)
    shorts = {n: r.integers(-128, 128, neardup.COMPONENTS).tolist() for n in range(1, 10)}
    shorts[9] = shorts[5]
    shorts[6] = shorts[5][:-20] + shorts[1][-20:]
    search = neardup.Search.__new__(neardup.Search)
    search.texts = documents(spark, [])
    search.members = spark.createDataFrame([(7, n, 1) for n in shorts], "bucket long, node long, pivot long")
    search.nodes = spark.createDataFrame([(n, [7, 100 + n], s) for n, s in shorts.items()], "node long, bands array<long>, short array<tinyint>")
    pairs = search.across(spark.createDataFrame([], "node long, root long")).collect()
    parts = {n: n for n in shorts}
    for a, b in sorted((p["a"], p["b"]) for p in pairs):
        parts = {n: parts[a] if root == parts[b] else root for n, root in parts.items()}
    assert len({parts[n] for n in (5, 6, 9)}) == 1 and len(set(parts.values())) == 7


def test_signatures_are_unbiased():
    r = random.Random(3)
    for _ in range(4):
        a = Counter({k: r.randint(0, 9) for k in range(40)})
        b = Counter({k: max(0, n + r.choice([0, 0, 0, -2, 3])) for k, n in a.items()})
        a, b = +a, +b
        want = (a & b).total() / (a | b).total()
        element = np.array([*a, *b], np.uint64)
        weight = np.array([*a.values(), *b.values()])
        owner = np.array([0] * len(a) + [1] * len(b))
        values = neardup.signatures(2, owner, neardup.mix(element), weight, size=4000)
        assert abs((values[0] == values[1]).mean() - want) < 0.03
