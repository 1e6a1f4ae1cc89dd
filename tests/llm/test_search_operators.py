"""SentencePiece ids, ranked search and source divergence against the library, SQL and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import documents, empty, sentence, texts

from rowtrace.llm import divergence, pieces, ranking

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.read_model(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
AWKWARD = ["", " ", "  a  b", "▁x ▁▁", "<s></s><unk><0x41>", "日本語ñé", "\x00q\n\t", "\u200b😀🏽", "a" * 500, " " * 70 + "t", "\ufffd ﬁ", "x" * 20_000 + " y"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_equal_the_library():
    r = random.Random(3)
    for text in [*AWKWARD, *[sentence(k, r.randint(1, 60)) for k in range(50)]]:
        assert MODEL.encode(text) == LIBRARY.encode(text), text[:50]
        assert MODEL.decode(MODEL.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab theinñé日▁\n\t.<s>0x4\u200b😀 "), max_size=60))
def test_ids_of_any_text(text):
    assert MODEL.encode(text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999), st.sampled_from([28705, 259, 1, 2])), max_size=15))
def test_text_of_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_pairs_stay_as_they_are_or_merge():
    r = random.Random(1)
    known = list(MODEL.text_of)
    marks = [i for i in known if not MODEL.text_of[i].strip(pieces.SPACE)]
    for _ in range(5000):
        a, b = r.choice(known), r.choice(known if r.random() < 0.8 else marks)
        left, right = MODEL.text_of[a], MODEL.text_of[b]
        assert MODEL.compatible(a, b) == (MODEL.merge(left + right) == [len(left), len(right)])


def test_tables_may_be_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "STRETCHES", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    model = pieces.read_model(PATH)
    for k in range(20):
        assert model.encode(sentence(k, 30)) == LIBRARY.encode(sentence(k, 30))


def test_encoded_and_decoded_tables(spark):
    rows = [(i, t, None) for i, t in enumerate([*AWKWARD, None, AWKWARD[2]])] + [(None, "no id", None)] + texts()
    docs = documents(spark, rows)
    ids = pieces.encode(docs, MODEL)
    want = sorted(((i, LIBRARY.encode(t or "")) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=repr) == want
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(ids, MODEL).collect()), key=repr)
    assert back == sorted(((i, LIBRARY.decode(x)) for i, x in want), key=repr)
    got = sorted(map(tuple, pieces.digests(docs, MODEL).collect()), key=repr)
    assert got == sorted(((i, len(x), digest(",".join(map(str, x))), digest(LIBRARY.decode(x))) for i, x in want), key=repr)
    assert pieces.digests(empty(spark), MODEL).count() == 0
    assert [r["text"] for r in pieces.decode(ids.limit(1).selectExpr("doc_id", "cast(null as array<int>) ids"), MODEL).collect()] == [""]


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LETTERS = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_ranking(rows, items, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t, _ in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counted:
            m = 75 + 25 * n * docs // length
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if c[t]:
                    score += math.floor(1000 * math.log((2.0 * docs + 2) / (2.0 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block_bytes"), [(20, ranking.BLOCK_BYTES), (3, 150)])
def test_ranking_equals_brute_force(spark, k, block_bytes):
    rows = texts() + [(900 + i, sentence(9, 40), "hot") for i in range(30)] + [(950, "Ñandú ÑANDÚ x1 x1 x1 É", None), (951, "ñandÚ X1", None)]
    items = [(1, sentence(9, 12)), (2, "ÑANDÚ x1 x1 é"), (3, "... !"), (4, None), (5, ""), (None, sentence(1, 40)), (6, sentence(10, 200)), (7, "one nowhere"), (7, sentence(4, 90))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    docs = documents(spark, rows)
    got = ranking.search(docs, bench, k, block_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute_ranking(rows, items, k)
    assert ranking.search(empty(spark), bench, k).count() == 0
    assert ranking.search(docs, bench.limit(0), k).count() == 0


def test_masks_are_left_out_only_below_the_bound():
    r = np.random.default_rng(4)
    for terms, width in [(3, 400), (70, 300), (130, 50), (1, 9)]:
        lists = []
        for _ in range(terms):
            docs = np.flatnonzero(r.random(width) < r.random() * 0.3)
            lists.append((docs, r.integers(0, 50, len(docs))))
        repeats = r.integers(1, 4, terms)
        score = np.zeros(width, np.int64)
        for (docs, values), n in zip(lists, repeats, strict=True):
            score[docs] += values * n
        ids = ranking.pa.array(r.permutation(width))
        best = ranking.Best(20)
        scored = ranking.by_mask(lists, repeats, width, ids, 0, best)
        want = sorted((-int(s), False, i) for s, i in zip(score, ids.to_pylist(), strict=True) if s > 0)[:20]
        assert best.rows == want and scored <= width
    # two runs of documents: the second starts from the bound of the first
    again = ranking.by_mask(lists, repeats, width, ids, 0, best)
    assert again <= scored


@pytest.mark.parametrize(("name", "query"), [("RANKING", ranking.op12_ranked_search), ("DIVERGENCE", divergence.op13_source_divergence)])
def test_rows_equal_sql(spark, name, query):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got = query(spark, SMALL)
    want = con.execute(ranking.SQL if name == "RANKING" else divergence.SQL)
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def brute_audit(rows, least, top):
    counts, df, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(LETTERS.findall((text or "").translate(LOWER)))
        counts.setdefault((lang, source), Counter()).update(found)
        df.update((lang, t) for t in found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for g, t in df if g == lang and df[g, t] >= least)
        sides = {s: {t: counts[lang, s][t] for t in kept} for g, s in groups if g == lang}
        total = {t: sum(c[t] for c in sides.values()) for t in kept}

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        whole = share(total)
        p = {s: share(c) for s, c in sides.items()}
        for s in sides:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in sides if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            own = sorted(
                (-((p[s][t] - whole[t]) ** 2 // (p[s][t] + whole[t])), t.encode(), t) for t in kept if sides[s][t] and p[s][t] > whole[t]
            )
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(own[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("segment", "block"), [(divergence.SEGMENT, divergence.BLOCK), (4, 2), (1, 1)])
def test_audit_equals_brute_force(spark, segment, block):
    r = random.Random(6)
    words = "Aa aa bÉ bé über x1y zz ñ q w e".split() + sentence(5, 30).split()
    rows = [(" ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 25))), r.choice(["en", None, "", "de"]), r.choice(["a", "b", "ä", None, "c", "d"])) for _ in range(150)]
    rows += [("lone words here", "fr", "a"), (None, "fr", "b"), ("", "it", None), ("aa " * 500, "en", "a")] + [("same text", "en", "b")] * 12
    df = spark.createDataFrame([(i, t, g, s, "v") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, value string").repartition(3)
    got = divergence.audit(df, 3, 4, segment, block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 3, 4)
    assert divergence.audit(df.limit(0), 3, 4).count() == 0


def test_shares_are_exact():
    r = random.Random(8)
    counts = [r.randint(0, 10**k) for k in range(14) for _ in range(20)]
    totals = [c + r.randint(1, 9 * 10**13 - c) for c in counts]
    got = divergence.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 2) // n for c, n in zip(counts, totals, strict=True)]
