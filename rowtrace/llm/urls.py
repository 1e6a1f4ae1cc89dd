"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted to a small labelled URL table by gradient steps scaled by a
bound of the Hessian's diagonal, with momentum; each step joins and aggregates (url, bucket) rows. The weights are a table of
at most BUCKETS rows, which bounds what scoring broadcasts; a page's n-grams are
joined with it and summed where they are read, before one row a page is moved.

Defined cases: a null url, or one without `://`, has an empty host and path, fits
no rule and is judged by the model (its intercept); repeated rows are judged
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrace.llm.common import cut, table

BUCKETS = 1 << 18
HOST_SIZES, PATH_SIZES = (3, 4, 5), (3,)
STEPS = 20
RIDGE = 0.1
MOMENTUM = 0.85
#: (host and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled table is built from these words: hosts to block pair two of the first kind, hosts to allow two of the
# second; both kinds get the same prefixes, domains and paths, so that only the words tell them apart.
UNWANTED = (
    "casino win bets free cheap pills ads track poker slots jackpot bonus loans payday viagra cialis pharma adult porn "
    "xxx escort sexcam clickbait spam scam malware warez torrent crack keygen phish popup banner adserver tracker "
    "lottery gamble replica diet earn crypto"
).split()
WANTED = (
    "news garden library weather history school recipes travel museum theater nation research science health forum "
    "wiki docs blog press journal university city council music books film sport photo art maps energy water forest "
    "ocean physics math language nature court other these nothing station motion action thing whether there another "
    "north south earth month both bath path truth method theory thread width threshold together mother weather "
    "brother then than that this think thanks throne thesis athens ethnic northern southern reading writing teaching "
    "training planning meeting sharing nursing painting printing shipping learning morning evening king spring string "
    "table stable able noble cable answer finder founder garden owner corner order reader leader center winter letter "
    "hand land stand island sound ground around found house mouse outside country county mountain fountain "
    "edition mission session version vision passion region season person lesson reason station position tradition "
    "west east coast post host test forest honest best rest list artist dentist hotel heart health healthy wheat "
    "are here where were share store shore before more core near year hearing early family daily lyric only enter "
    "entry agent event client student parent content present garden open oven hen ten men women kitchen children"
).split()
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.org", "example.net", "example.edu")
PATHS = ("/en/1042", "/fr/77.html", "/de/9310/", "/es/5521?page=2", "/en/640#top", "/")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow), a few hundred in all."""
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for step in (0, 1, 2, 3, 5, 7, 11, 13) if label else (0, 5, 17):
            for i, word in enumerate(words):
                name = word if step == 0 else f"{word}-{words[(i + step) % len(words)]}"
                k = i + 5 * step
                url = f"https://{PREFIXES[k % 4]}{name}.{DOMAINS[(k // 4) % 4]}{PATHS[(k // 2) % 6]}"
                rows.append((url, label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host or a parent domain, and path prefix) and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """Array of bucket numbers (from 1) of the distinct character n-grams of `^host$` and `path`."""

    def grams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
        found = [
            F.transform(
                F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda i, n=n: (F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))), F.lit(size)) + 1).cast("int"),
            )
            for n in sizes
        ]
        return F.concat(*found)

    whole = F.concat(F.lit("^"), host, F.lit("$"))
    return F.array_distinct(F.concat(grams(whole, "h", HOST_SIZES), grams(path, "p", PATH_SIZES)))


def fit(labelled: DataFrame, steps: int = STEPS, ridge: float = RIDGE, size: int = BUCKETS) -> DataFrame:
    """(bucket, weight) from rows of (url, label); bucket 0 is the intercept.

    The labelled table is small by its nature, so its features lie in one partition,
    and a step is one task; larger ones could be dealt by url and bucket as they are.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("url", F.col("label").cast("double").alias("label"), buckets(host, path, size).alias("features"))
    seen = cut(
        rows.select(
            "url", "label", F.size("features").alias("k"), F.explode(F.concat(F.array(F.lit(0)), "features")).alias("bucket")
        ).coalesce(1)
    )
    zero = F.lit(0.0)
    weights = cut(seen.select("bucket").distinct().select("bucket", zero.alias("weight"), zero.alias("speed")))
    for _ in range(steps):
        margin = seen.join(weights, "bucket").groupBy("url", "label", "k").agg(F.sum("weight").alias("margin"))
        p = 1 / (1 + F.exp(-F.col("margin")))
        # a row's curvature counts once for each of its features, as they move together
        curve = F.greatest(p * (1 - p), F.lit(0.02)) * F.col("k")
        errors = margin.select("url", (F.col("label") - p).alias("error"), curve.alias("curve"))
        sums = seen.join(errors, "url").groupBy("bucket").agg(F.sum("error").alias("g"), F.sum("curve").alias("h"))
        pull = F.when(F.col("bucket") > 0, F.col("weight") * ridge).otherwise(0.0)
        speed = F.col("speed") * MOMENTUM + (F.col("g") - pull) / (F.col("h") + ridge)
        moved = sums.join(weights, "bucket").select("bucket", "weight", speed.alias("speed"))
        weights = cut(moved.select("bucket", (F.col("weight") + F.col("speed")).alias("weight"), "speed"))
    return weights.select("bucket", "weight")


def judge(pages: DataFrame, weights: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, size: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of rows with page_id and url. `weights` has a row for each bucket at most."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("place"))
    features = F.explode(F.concat(F.array(F.lit(0)), buckets(F.col("host"), F.col("path"), size))).alias("bucket")
    met = split.select("*", features).join(F.broadcast(weights), "bucket", "left")
    summed = met.groupBy("page_id", "host", "path", "place").agg(F.sum("weight").alias("margin"))
    score = 1 / (1 + F.exp(-F.col("margin")))
    rule, outcome = matching_rule(F.col("host"), F.col("path"), rules)
    return summed.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(outcome, F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        score.alias("score"),
    )


def labels_table(spark: SparkSession) -> DataFrame:
    """The labelled table as rows of (url, label)."""
    rows = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    return spark.sql(f"select * from values {rows} as t(url, label)")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict (and the model's score) of every page's url."""
    return judge(table(spark, folder, "pages"), fit(labels_table(spark)))
