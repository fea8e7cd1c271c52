"""URL filters: allow and block rules, and a classifier for what no rule decides.

The classifier is a logistic regression on hashed character 3- to 5-grams of host
and path, fitted on the driver from a small labelled URL table.
Rules fit a host and its subdomains and a path by prefix; the longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, and gets the classifier's verdict on an empty url (allow); equal
urls get equal verdicts; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# The labelled table is made from words of either kind, in the shapes that urls have.
UNWANTED = "spam adult ads tracker adserver clickbait sex nude loans cheap-deal free-gift win-prize bonus-code casino bets poker jackpot slots roulette gambling pills viagra cialis pharmacy-rx xxx porn adult-cams escort hot-singles sexchat torrent-crack keygen warez replica-watches payday-loan quick-cash get-rich crypto-doubler free-iphone miracle-diet click-bait spin-win cheap-meds".split()
WANTED = "news library museum university school weather garden recipes history science physics travel-guide city-council health-service wiki encyclopedia docs manual tutorial forum blog music theatre sports chess gallery archive journal review maps bicycle coffee hiking poetry astronomy chemistry economics kitchen market village harbour railway language grammar dictionary atlas biology geology painting sculpture".split()
#: Common English trigrams; pairs of them stand for host names that mean nothing.
TRIGRAMS = "the and ing ion her ent tha nth int ere tio ter est ers ati hat ate all eth hes".split()
SHAPES = ("http://www.{}.com/", "https://{}.net/en/{}", "http://m.{}-online.org/page/{}.html", "https://blog.{}.example.com/de/{}?ref=x", "https://example.com/{}/index.html", "http://the-{}-place.info/fr/{}/")
PLACES = 1 << 16
ORDERS = (3, 4, 5)
ROUNDS = 600
L2 = 1e-5
UNWANTED_WEIGHT = 3.0
THRESHOLD = 0.6


def labelled_urls() -> list[tuple[str, int]]:
    rows = [(shape.format(word, 100 + 37 * i), label) for label, words in ((1, UNWANTED), (0, WANTED)) for i, word in enumerate(words) for shape in SHAPES]
    plain = [a + b for a in TRIGRAMS for b in TRIGRAMS if a != b]
    return rows + [(SHAPES[i % len(SHAPES)].format(name, 100 + 37 * i), 0) for i, name in enumerate(plain)]


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased."""
    return ascii_lower(F.substring_index(F.regexp_replace(_after(url), r"[/?#]", "/"), "/", 1))


def path_of(url: Column) -> Column:
    """From the host's end to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed places of the n-grams."""
    out = []
    for part in (f"^{host}$", f"{path.lower()}$"):
        a = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        g = a
        with np.errstate(over="ignore"):
            for n in range(2, max(ORDERS) + 1):
                g = g[:-1] * np.uint64(0x100000001B3) + a[n - 1 :]
                if n in ORDERS:
                    out.append(((g + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % PLACES)
    return np.unique(np.concatenate(out))


def split_url(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path


def train(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept, from a table that fits the driver."""
    found = [features(*split_url(u)) for u, _ in rows]
    y = np.asarray([label for _, label in rows], np.float64)
    at, row = np.concatenate(found), np.repeat(np.arange(len(rows)), [len(f) for f in found])
    x = 1 / np.sqrt([len(f) for f in found])[row]
    cost = np.where(y == 1, UNWANTED_WEIGHT, 1.0) / len(y)
    w, b, vw, vb = np.zeros(PLACES), -1.0, np.zeros(PLACES), 0.0
    for _ in range(ROUNDS):
        z = np.bincount(row, weights=w[at] * x, minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-z)) - y) * cost
        vw = 0.9 * vw - 5.0 * (np.bincount(at, weights=x * e[row], minlength=PLACES) + L2 * w)
        vb = 0.9 * vb - 5.0 * e.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def classifier(spark: SparkSession, rows: list[tuple[str, int]] | None = None):
    """A column function: host and path to the probability that the url is unwanted."""
    weights, intercept = train(rows or labelled_urls())
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                at = features(h, p)
                out.append(shared.value[at].sum() / np.sqrt(max(1, len(at))) + intercept)
            yield pd.Series(np.round(1 / (1 + np.exp(-np.asarray(out, np.float64))), 9))

    return unwanted


def url_filter(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` (score: null where a rule decides)."""
    score = classifier(pages.sparkSession, labelled)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_ruled", ruled)
    # Urls that a rule decides aren't scored: the classifier sees them as empty.
    open_ = F.col("rule").isNull()
    rows = rows.withColumn("_score", score(F.when(open_, F.col("host")).otherwise(""), F.when(open_, F.col("path")).otherwise("")))
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_ruled", F.when(F.col("_score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(open_, F.col("_score")).alias("score"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
