"""URL filters: explicit rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Explicit rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled hosts and paths (1: block) from which the model learns, made up from common words of each kind, not from any table that is judged.
#: Any such table can be given instead.
BLOCKED = """
junk-mail.example.org/en/1 www.spammers.example.com/fr/20 discount-pharmacy.example.com/en/3 www.pills-online.example.net/de/41
casino-bonus.example.net/play big-jackpot.example.org/es/5 free-money.example.com/now get-free-gifts.example.net/en/77
hot-singles.example.org/join adult-cams.example.com/fr/8 xxx-videos.example.net/en/9 porn-tube.example.com/watch
click-bait.example.com/en/top10 buy-followers.example.net/order fake-watches.example.org/shop replica-bags.example.com/de/2
seo-links.example.net/en/5 backlinks.example.com/es/31 cheap-meds.example.org/buy viagra-shop.example.com/order.html
m.adult-chat.example.org/en/6 sports-betting.example.com/de/4 www.bet-now.example.org/bet adserver.example.net/track
banner-ads.example.com/click click-tracker.example.org/ads online-casino.example.net/fr/6 slots-poker.example.com/en/2
""".split()
ALLOWED = """
www.example.com/en/1 blog.example.net/fr/20 m.example.org/de/3 docs.example.com/guide/41 news.example.net/play
science.example.org/es/5 library.example.com/now school.example.net/en/77 museum.example.org/join garden.example.com/fr/8
weather.example.net/en/9 recipes.example.com/watch history.example.com/en/top10 maps.example.net/order wiki.example.org/shop
www.bakery.example.com/de/2 blog.orchard.example.net/en/5 m.railway.example.com/es/31 forum.example.org/buy theatre.example.com/order.html
m.travel.example.org/en/6 cooking.example.com/de/4 www.physics.example.org/results archive.example.net/track
gallery.example.com/click economics.example.org/pictures radio.example.net/fr/6 village.example.com/en/2
""".split()
#: Hash buckets, n-gram lengths, steps and rate of the fit, and its ridge.
BUCKETS, LENGTHS, STEPS, RATE, RIDGE = 1 << 14, (3, 4, 5), 300, 1.0, 1e-3


def features(host: str, path: str) -> np.ndarray:
    """The distinct hash buckets of the n-grams of ^host$ and ^path$, kept apart by a prefix."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in LENGTHS:
            found.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode(errors="replace")) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(labelled: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent over a small labelled table (host, path, label); each URL's features have norm 1."""
    x = np.zeros((len(labelled), BUCKETS), np.float32)
    for i, (host, path, _) in enumerate(labelled):
        at = features(host, path)
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
    y, w, b = np.array([r[2] for r in labelled], np.float32), np.zeros(BUCKETS, np.float32), 0.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= RATE * (x.T @ error / len(y) * 10 + RIDGE * w)
        b -= RATE * float(error.mean())
    return w, b


def seed_table() -> list[tuple[str, str, int]]:
    return [(u.partition("/")[0], "/" + u.partition("/")[2], label) for label, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls]


def split_url(url):
    """(host, path) columns: host from the first :// to /, ? or #, A-Z lower-cased; path to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(urls: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score): the longest rule that fits decides, else the model.

    A rule fits its host and all subdomains where the path starts with the rule's path. Null URLs and URLs without ://
    have empty host and path and go to the model like any other. Repeated rows are judged each; extra columns are ignored.
    """
    w, b = fit(labelled or seed_table())

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(host, path):
            at = features(host, path)
            return 1 / (1 + np.exp(-(float(w[at].sum()) / np.sqrt(max(len(at), 1)) + b)))

        return pd.Series([one(h, p) for h, p in zip(hosts, paths)], dtype="float64")

    host, path = split_url(F.col(url))
    out = urls.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    out = out.withColumns({"rule": rule, "_ruled": verdict, "score": score("host", "path")})
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(key, "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), "score")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))
