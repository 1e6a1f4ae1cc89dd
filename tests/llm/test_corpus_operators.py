"""URL filters, toxicity, page text, sharding, mixing and the pipeline against the contracts and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import documents, empty, sentence, texts

from rowtrace.llm import decontamination, html, mixing, sharding, toxicity, urls
from rowtrace.llm.common import prefix_sums, table, word_count
from rowtrace.llm.components import components

SMALL = "/root/testdata/sf0.001"


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("ab") if r.random() < 0.9 else None, r.randint(0, 5), r.randint(0, 9)) for _ in range(400)] + [("a", 3, 2)] * 300
    got = prefix_sums(spark.createDataFrame(rows, "g string, o int, v long"), ["o"], ["v"], ["g"]).collect()
    by_group = defaultdict(list)
    for row in got:
        by_group[row["g"]].append(row)
    assert len(got) == len(rows)
    for found in by_group.values():
        found.sort(key=lambda x: x["before_rows"])
        assert [x["before_rows"] for x in found] == list(range(len(found)))
        assert [x["o"] for x in found] == sorted(x["o"] for x in found)
        assert [x["before_v"] for x in found] == [sum(y["v"] for y in found[:k]) for k in range(len(found))]


def test_shards(spark):
    docs = documents(spark)
    got = sharding.shard_documents(docs, ("doc_id",)).collect()
    rows = texts()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(map(repr, want))
    total, largest = sum(w[1] for w in want), max(w[1] for w in want)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert max(sizes.values()) <= total / 16 + largest
    in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in in_order] == [w[0] for w in want]  # contiguous in the order of ids
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_shards_are_even(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = [r["s"] for r in sharding.shard_documents(docs).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.3 * max(sizes)


def brute_targets(sizes):
    """Weights 3, 1, 2 by source, nulls last; what is above twice a source's size is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, sentence(i, r.randint(1, 60)), r.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(1000 + i, sentence(7, 30), "hot") for i in range(200)] + [(2000, None, "a"), (2001, "", "e"), (2002, " ", None)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for row in got:
        assert row["source_size"] == sizes[row["source"]] and row["target"] == pytest.approx(want[row["source"]])
        assert 0 <= row["copies"] <= 2
        taken[row["source"]] += row["copies"] * row["size"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(30, 0.01 * target), (s, taken[s], target)
    again = mixing.mix(documents(spark, rows)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(empty(spark)).count() == 0
    applied = mixing.apply_mix(documents(spark, rows))
    assert applied.columns == documents(spark, rows).columns
    assert applied.count() == sum(row["copies"] for row in got)


def test_mixing_rates_solve_the_dual(spark):
    rows = [("a", 10 * k, k) for k in range(1, 20)] + [("b", 5, 100), ("b", 500, 3)]
    histogram = spark.createDataFrame(rows, "source string, size long, n long")
    sizes = {s: sum(z * n for t, z, n in rows if t == s) for s in "ab"}
    aims = {"a": 0.4 * sizes["a"], "b": 1.7 * sizes["b"]}
    targets = spark.createDataFrame([(s, sizes[s], aims[s]) for s in "ab"], "source string, source_size long, target double")
    for row in mixing.balance(histogram, targets).collect():
        mine = [(z, n) for t, z, n in rows if t == row["source"]]
        got = sum(z * n * min(2.0, np.exp(row["multiplier"] * z / row["mean"])) for z, n in mine)
        assert got == pytest.approx(aims[row["source"]], rel=1e-4)


def test_words_are_counted_like_the_pattern(spark):
    rows = [(i, t, "s") for i, t in enumerate(["a b", "", None, "\u00a0x\u2003y z", "\x0ba\x0c\rb\n", " \t "])]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", word_count(docs["text"]).alias("n")).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 2, 4: 2, 5: 0}


def test_url_rules_and_model(spark):
    cases = {
        "http://X.NET/a?b": ("x.net", "/a", "net/", "block"),
        "https://www.example.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/fr/1": ("example.net", "/fr/1", "net/", "block"),
        "http://a.example.com/de/x": ("a.example.com", "/de/x", "example.com/de/", "block"),
        "http://notexample.com/de/x": ("notexample.com", "/de/x", None, None),
        "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://b.org/fr": ("b.org", "/fr", None, None),
        "http://x.net": ("x.net", "", None, None),
        "http://x.net?q=://y.org/fr/": ("x.net", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    weights = urls.fit(urls.labels_table(spark)).cache()
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] * 2, "page_id long, url string, html string, host string")
    got = urls.judge(pages, weights).collect()
    assert len(got) == 2 * len(cases)
    for row in got:
        host, path, rule, verdict = list(cases.values())[row["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))
    # hosts that are not in the labelled table
    unseen = {"poker-bonus-slots.example.org": "block", "cheap-replica-pills.example.com": "block", "museum-garden.example.org": "allow", "citylibrary.example.com": "allow"}
    frame = spark.createDataFrame([(i, f"https://{h}/en/5") for i, h in enumerate(unseen)], "page_id long, url string")
    assert {r["host"]: r["verdict"] for r in urls.judge(frame, weights).collect()} == unseen
    assert urls.judge(pages.limit(0), weights).count() == 0


def test_url_model_equals_plain_logistic_regression(spark):
    """On a third of the labelled urls that it has not seen, beside a ridge regression on the same features, by Newton's
    method over the rows."""
    known = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(urls.labelled_urls())], "page_id long, url string, label int")
    train, held = known.filter("page_id % 3 > 0"), known.filter("page_id % 3 = 0")
    got = {r["page_id"]: r["score"] for r in urls.judge(held, urls.fit(train.select("url", "label")), ()).collect()}
    host, path = urls.host_and_path(F.col("url"))
    data = known.select("page_id", "label", urls.buckets(host, path).alias("features")).collect()
    place = {f: k for k, f in enumerate(sorted({f for r in data for f in r["features"]}))}
    matrix = np.zeros((len(data), len(place)))
    for k, row in enumerate(data):
        matrix[k, [place[f] for f in row["features"]]] = 1
    label, seen = np.array([r["label"] for r in data]), np.array([r["page_id"] % 3 > 0 for r in data])
    alike = matrix @ matrix[seen].T + 100.0  # the intercept is hardly held back
    margin = np.zeros(seen.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-margin))
        curve = np.maximum(p * (1 - p), 1e-4)
        share = np.linalg.solve(alike[seen] + urls.RIDGE * np.diag(1 / curve), margin + (label[seen] - p) / curve)
        margin = alike[seen] @ share
    plain = 1 / (1 + np.exp(-alike @ share))
    pairs = [(got[r["page_id"]], plain[k], r["label"]) for k, r in enumerate(data) if not seen[k]]
    right = [float(np.mean([(s[side] >= 0.5) == bool(s[2]) for s in pairs])) for side in (0, 1)]
    same = float(np.mean([(a >= 0.5) == (b >= 0.5) for a, b, _ in pairs]))
    assert right[0] >= right[1] - 0.03 and same >= 0.9, (right, same)


def toxic_rows():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = sentence(3000 + i, r.randint(15, 80)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["gr0tzly", "Grotzlies", "vilmock", "v1lmock", "grоtzly"])
        elif i % 30 == 7:
            words[3:5] = ["vilmock", "festival"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    more = [(9000, None, "s"), (9001, "", "s"), (9002, "x " * 30_000, "s"), (None, rows[0][1], "s"), (0, rows[0][1], "s")]
    docs = documents(spark, rows + more)
    marked = spark.createDataFrame([*labels, (None, 1, 1), (77777, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    judge = toxicity.Judge(docs, marked)
    got = judge.scores(docs, ["doc_id"]).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    wrong = [i for i, _, t in labels if (score[i] >= 0.3) != bool(t)]
    assert len(wrong) <= 12
    assert score[9000] == score[9001] == min(score.values()) and score[None] == score[0]
    assert any("festival" in e for e in judge.exceptions)
    kept = toxicity.drop_toxic(docs, marked)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in got)
    none = toxicity.Judge(docs, marked.limit(0)).scores(docs, ["doc_id"])
    assert {r["score"] for r in none.collect()} == {0.0}
    assert judge.scores(empty(spark), ["doc_id"]).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_shielded_matches_equal_brute_force(seed):
    r = random.Random(seed)
    spans = sorted(((a, a + r.randint(0, 9)) for a in (r.randint(0, 60) for _ in range(40))), key=lambda x: x[1])
    matches, shields = [(a, b, 1.0 * a) for a, b in spans if r.random() < 0.6], [x for x in spans if r.random() < 0.3]
    want = [m for m in matches if not any(a <= m[0] and m[1] <= b for a, b in shields)]
    assert toxicity.unshielded(matches, shields) == want


def test_matches_equal_a_plain_search():
    r = random.Random(12)
    lexicon = {" gro": 1.5, "mock": 0.7, " vil": 2.0, "ckf": 0.2}
    exceptions = [" vil mock ", "grow"]
    built = toxicity._automaton(lexicon, exceptions)
    for _ in range(200):
        text = " ".join(r.choice(["grow", "gr0", "vil", "mock", "vilmock", "ckfest", "plain", "grotz"]) for _ in range(r.randint(0, 12)))
        folded = toxicity.fold(text)
        hidden = [(i, i + len(e)) for e in exceptions for i in range(len(folded)) if folded.startswith(e, i)]
        best = {}
        for entry, weight in lexicon.items():
            for i in range(len(folded)):
                if folded.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in hidden):
                    best[i] = max(best.get(i, 0), weight)
        total = sum(best.values())
        want = (math.log1p(total), math.log1p(100 * total / folded.count(" "))) if total else (0.0, 0.0)
        assert toxicity.evidence(built, text) == pytest.approx(want)


def test_many_rows_of_a_labelled_id_teach_once(spark):
    rows, labels = toxic_rows()
    schema = "doc_id long, quality int, toxic int"
    marked = spark.createDataFrame(labels, schema)
    plain = toxicity.Judge(documents(spark, rows), marked)
    again = toxicity.Judge(documents(spark, rows + [rows[5]] * 500 + [rows[6]] * 300), marked)
    assert again.lexicon == plain.lexicon and again.exceptions == plain.exceptions and again.curve == pytest.approx(plain.curve)


def test_folding():
    assert toxicity.fold("Gr0tzly, l33t 2024 @ ﬁne") == " grotzly leet 2024 fine "
    assert toxicity.fold("").strip() == ""


def test_held_out_labels_teach_nothing(spark):
    rows, labels = toxic_rows()
    docs = documents(spark, rows)
    kept = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    flipped = [x if x in kept else (x[0], 1, 1 - x[2]) for x in labels]
    schema = "doc_id long, quality int, toxic int"
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.Judge(docs, spark.createDataFrame(x, schema)).scores(docs, ["doc_id"]).collect()}
        for x in (labels, kept, flipped)
    ]
    assert scores[0] == scores[1] == scores[2]


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body class='ad'><nav><a>Home</a></nav>"
    "<article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Fo<i>ur</i> &lt;x&gt;<div class=ad-slot>Buy</div>"
    "<aside>side</aside><ul><li>a<li>b</ul><div class='comments'><article>rude</article></div></article>"
    "<div>stray</div><footer>&copy;</footer></body></html>"
)


def test_blocks_of_a_page():
    main = [t for t, claim in html.blocks(PAGE) if claim == html.MAIN]
    assert main == ["Head & line", "One two three", "Four <x>", "a", "b"]
    assert html.blocks("") == [] and html.blocks("<p") == [("<p", html.OPEN)]
    assert html.blocks("<!-- open") == [] and html.blocks("<script>x") == []


def test_repeated_tokens_equal_brute_force():
    r = np.random.default_rng(2)
    streams = [r.integers(0, 3, r.integers(0, 60)).astype(np.uint64) for _ in range(12)]
    pages = np.array([k // 2 for k in range(12)])
    got = html.repeated_tokens(streams, pages, 5)
    for a, stream in enumerate(streams):
        want = np.zeros(len(stream), bool)
        for i in range(len(stream) - 4):
            piece = stream[i : i + 5].tobytes()
            if any(pages[b] != pages[a] and any(o[j : j + 5].tobytes() == piece for j in range(len(o) - 4)) for b, o in enumerate(streams)):
                want[i : i + 5] = True
        assert (got[a] == want).all()


@pytest.mark.parametrize("group_pages", [128, 6])
def test_page_text(spark, group_pages):
    menu = "".join(f"<div>menu entry {sentence(k, 3)}</div>" for k in range(5))
    rows = [(i, f"http://h.example/{i}", f"<html><body>{menu}<div>{sentence(500 + i, 40)}</div><p>{sentence(700 + i, 9)}</p></body></html>") for i in range(12)]
    rows += [(50, "http://h.example/x", PAGE), (51, None, None), (52, "bad url", ""), (53, "http://one.example", "<p>alone</p>"), (50, "http://h.example/x", PAGE)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(12):
        assert text[i] == f"{sentence(500 + i, 40)}\n\n{sentence(700 + i, 9)}"
    assert text[50] == "Head & line\n\nOne two three\n\nFour <x>\n\na\n\nb"
    assert text[51] == text[52] == "" and text[53] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_open_blocks_beside_main_ones(spark):
    menu = f"<div>{sentence(1, 12)}</div>"
    rows = [
        (i, f"http://h.example/{i}", f"{menu}<article>teaser {i}</article><div><p>Part {i}</p><p>{sentence(900 + i, 30)}</p></div>")
        for i in range(4)
    ]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"teaser {i}\n\nPart {i}\n\n{sentence(900 + i, 30)}" for i in range(4)}


@pytest.mark.parametrize("group_bytes", [html.GROUP_BYTES, 600])
def test_pages_whose_blocks_are_claimed_go_through_the_array(spark, group_bytes):
    """The markup claims every block: no shorter way beside the array of a host's pages."""
    rows = [(i, "http://h.example/x", f"<nav>{sentence(1, 12)}</nav><article><p>{sentence(800 + i % 3, 20)}</p><p>own {i}</p></article>") for i in range(9)]
    got = html.extract_main_text(spark.createDataFrame([*rows, rows[4]], "page_id long, url string, html string"), group_bytes)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = [(i, f"{sentence(800 + i % 3, 20)}\n\nown {i}") for i in [*range(9), 4]]
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == sorted(want)


def test_repeats_across_groups_of_a_host(spark):
    twice = {0: 5, 1: 5, 7: 6, 30: 6, 11: 7, 12: 7, 103: 5}  # page and passage; 103 is of another host
    rows = [
        (i, f"http://{'a' if i < 100 else 'b'}.example/{i}", f"<div>{sentence(2000 + i, 20)}</div><div>{sentence(twice.get(i, 3000 + i), 15)}</div>")
        for i in [*range(40), *range(100, 140)]
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = html.extract_main_text(df, 1000).collect()
    dealt = html.extract_main_text(df.repartition(3), 2).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, dealt))
    assert {r["page_id"] for r in dealt if "\n\n" not in r["text"]} == {0, 1, 7, 30, 11, 12}


def test_pages_without_claims_equal_brute_force(spark):
    """No article or main anywhere: the repeats on the host decide about every block, in one group or many."""
    r = random.Random(5)
    shared = [sentence(40 + k, 10) for k in range(6)]
    pages = {}
    for i in range(30):
        parts = [sentence(6000 + 20 * i + k, r.randint(1, 30)) for k in range(4)] + r.sample(shared, 3)
        r.shuffle(parts)
        pages[i] = parts
    rows = [(i, f"https://{'x' if i < 20 else 'y'}.example/{i}", "".join(f"<div>{p}</div>" for p in parts)) for i, parts in pages.items()]
    rows += [rows[3], (None, "https://x.example/a", f"<div>{shared[0]}</div><p>{sentence(7777, 12)}</p>"), (None, None, None)]

    def host_tokens(found):
        return [w for p in found for w in [*p.split(), None]]

    def kept(i):
        here = host_tokens(pages[i])
        others = {tuple(t[k : k + 8]) for j, p in pages.items() if j != i and (j < 20) == (i < 20) for t in [host_tokens(p)] for k in range(len(t) - 7)}
        if i < 20:
            others |= {tuple(t[k : k + 8]) for t in [host_tokens([shared[0], sentence(7777, 12)])] for k in range(len(t) - 7)}
        gone = [False] * len(here)
        for k in range(len(here) - 7):
            if tuple(here[k : k + 8]) in others:
                gone[k : k + 8] = [True] * 8
        out, at = [], 0
        for p in pages[i]:
            n = len(p.split())
            if sum(gone[at : at + n]) < 0.5 * n:
                out.append(p)
            at += n + 1
        return "\n\n".join(out)

    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (html.GROUP_BYTES, 3000, 1):
        got = html.extract_main_text(df, limit).collect()
        assert len(got) == len(rows)
        for row in got:
            if row["page_id"] is not None:
                assert row["text"] == kept(row["page_id"])
            else:
                assert row["text"] == (sentence(7777, 12) if row["url"] else "")


def test_rows_that_share_an_id_are_judged_and_mixed_each(spark):
    item = sentence(50, 40)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaked, clean = sentence(51, 30) + " " + item, sentence(52, 60)
    rows = [(None, leaked, "s"), (None, clean, "s"), (None, None, "s"), (7, leaked, "s"), (7, clean, "s"), (8, item, "t"), (8, item, "u"), (9, clean, "s"), (9, clean, "s")]
    docs = documents(spark, rows)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    want = [(i, t, s) for i, t, s in rows if item not in (t or "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in kept.collect()))) == sorted(map(repr, want))


def test_equal_rows_have_the_copies_of_the_mix(spark):
    words = sentence(60, 10)
    rows = [(1, words, "b")] * 300 + [(None, words, "b")] * 50 + [(1, words, "a")] * 70 + [(i, sentence(60 + i, 12), "a") for i in range(100, 160)]
    rows += [(i, sentence(60 + i, 20), "c") for i in range(200, 230)]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs).collect()
    want = Counter()
    for row in mixed:
        want[row["source"]] += row["copies"]
    copies = Counter((r["doc_id"], r["source"]) for r in mixed for _ in range(r["copies"]))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    got = applied.collect()
    assert Counter(r["source"] for r in got) == want
    assert Counter((r["doc_id"], r["source"]) for r in got) == copies
    uneven = {(r["doc_id"], r["source"]) for r in mixed if r["doc_id"] in (1, None)}
    assert any(len({r["copies"] for r in mixed if (r["doc_id"], r["source"]) == k}) > 1 for k in uneven)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(45)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 350)]
    parent = list(range(400))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        rows = after.collect()
        assert name == "mixing" or len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == before and {"doc_id", "shard", "slot"} <= set(last.columns)


def test_stages_on_awkward_rows(spark):
    for rows in (texts(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SMALL)
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
