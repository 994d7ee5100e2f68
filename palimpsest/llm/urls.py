"""URL filters: rules by host and path, else a logistic regression on hashed character n-grams of host and path. DataFrame functions only.

The model is learnt on the driver from a small labelled table (at most ``MOST_LABELLED`` rows), whose n-grams are hashed by the same columns that score a
table; its weights are a literal of ``BUCKETS`` numbers, whatever the input.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null URL or one without
``://`` has an empty host and path; no rule fits it and the model judges the empty text. A rule fits its host and all subdomains if the path starts with
its own; the longest rule wins, then the one that is listed first. Columns of the same names are replaced; repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAMS, MOST_LABELLED = 4096, (3, 4), 5000
#: Log-odds from which a URL that no rule fits is blocked.
BLOCK_AT = 0.0
#: (verdict, host and path)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_BLOCKED = ["casino-royal", "mega-casinos", "casino-slots", "casino-bonus", "topcasino", "pills-discount", "buy-pills-now", "pills-store", "diet-pills", "sports-bets", "betsonline", "live-bets", "free-spins", "free-prizes", "free-money", "adults-only", "adult-chat", "adult-video", "adclicks-track", "tracker-ads", "ads-server", "banner-ads", "spambots", "link-spam", "spam-mail", "spam-offers", "link-farms", "content-farm", "cheap-loans", "cheap-watches", "win-prizes", "instant-win", "jackpot-win"]
_ALLOWED = ["library", "museum", "university", "weather", "cooking", "gardening", "daily-news", "open-maps", "history", "oranges", "teaching", "stories", "research", "travel", "parliament", "orchestra", "football-club", "hospital", "railways", "bookshop", "mountains", "theatre", "chemistry", "kitchen", "village-school", "bakery", "sailing", "architecture", "statistics", "translation", "botany", "furniture", "blossom", "blocks", "forest", "farmers-market", "winter", "wind-energy", "freedom", "address-book", "trackside", "opening", "seasons", "children", "together", "information", "northern", "handbook", "entertainment", "nations", "sentence", "thirteen", "weathered", "area", "season", "outside"]
_PLACES = [("", "example.org", "/en/12"), ("www.", "example.net", "/de/7.html"), ("blog.", "example.com", "/fr/455/"), ("m.", "example.org", "/es/830"), ("", "example.net", "/en/671?utm_source=feed"), ("www.", "example.org", "/fr/9#top")]
#: The small labelled table: 1 is to be blocked.
LABELLED = [(f"https://{www}{name}.{host}{path}", label) for names, label in ((_BLOCKED, 1), (_ALLOWED, 0)) for name in names for www, host, path in _PLACES]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def grams() -> Column:
    """Buckets of the n-grams of host and path; the host's ends are marked."""
    s = F.concat(F.lit("^"), "host", F.lit("$"), "path")
    each = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i, n=n: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int")) for n in GRAMS]
    return F.array_distinct(F.concat(*each))


def learn(labelled: DataFrame, epochs: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[float, list[float]]:
    """(bias, weights) of a logistic regression by full gradient steps, scaled for each weight by what its gradients were so far (AdaGrad), from at most MOST_LABELLED rows (url, label)."""
    host, path = parts()
    rows = labelled.where("url is not null and label is not null").orderBy("url", "label").limit(MOST_LABELLED).withColumns({"host": host, "path": path}).select("url", "label", grams().alias("g")).collect()
    rows = [(r["g"], r["label"]) for r in sorted(rows, key=lambda r: (r["url"], r["label"]))]
    bias, weight, seen, seen_bias = 0.0, [0.0] * BUCKETS, [1e-12] * BUCKETS, 1e-12
    used = sorted({i for g, _ in rows for i in g})
    for _ in range(epochs if rows else 0):
        step, off = dict.fromkeys(used, 0.0), 0.0
        for g, y in rows:
            e = 1 / (1 + math.exp(-(bias + sum([weight[i] for i in g])))) - y
            off += e
            for i in g:
                step[i] += e
        seen_bias += (off / len(rows)) ** 2
        bias -= rate * off / len(rows) / math.sqrt(seen_bias)
        for i in used:
            g = step[i] / len(rows) + decay * weight[i]
            seen[i] += g * g
            weight[i] -= rate * g / math.sqrt(seen[i])
    return bias, weight


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``pages`` (url and more) with host, path, rule, score and verdict."""
    spark = pages.sparkSession
    rules = RULES if rules is None else rules
    labelled = spark.createDataFrame(LABELLED, "url string, label int") if labelled is None else labelled
    bias, weight = learn(labelled)
    host, path = parts()
    out = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, so it comes on top last
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    table = F.array(*[F.lit(round(x, 9)) for x in weight])
    out = out.withColumn("score", F.aggregate(grams(), F.lit(bias), lambda a, i: a + F.element_at(table, i + 1)))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
