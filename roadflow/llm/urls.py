"""URL filter: path rules first, then logistic regression on hashed character n-grams.

All work on pages is column expressions.  The model is fitted on the driver from
``LABELLED``, a small fixed table; its weights are rounded to integers, so a sum
of weights has no order and every engine gives the same verdict.

A feature is a trigram of the host or of the path (with marks at both
ends), told apart by a tag and hashed by md5 into ``BUCKETS``; a URL's features
are its trigram shares.

Defined results: a null url, or one without "://", has an empty host and path and fits no
rule; the model decides it like any other.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.llm.common import kept_names

BUCKETS = 4096
STEPS = 300

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: The labelled table: 1 is block.
LABELLED = [
    ("ads.shopfront.test", "/click/banner?id", 1),
    ("ads-track.media.test", "/pixel.gif", 1),
    ("track.adserver.test", "/view/promo", 1),
    ("cheap-pills.test", "/buy/now/discount", 1),
    ("casino-bonus.test", "/slots/free-spins", 1),
    ("bet365win.test", "/poker/jackpot", 1),
    ("xxx-video.test", "/adult/cams", 1),
    ("hot-singles.test", "/dating/adult", 1),
    ("free-download.test", "/crack/keygen", 1),
    ("banner-ads.test", "/serve/ad.js", 1),
    ("popunder.click.test", "/redirect/offer", 1),
    ("win-prize.test", "/lottery/claim", 1),
    ("spam-links.test", "/seo/backlinks", 1),
    ("loan-fast.test", "/payday/apply-now", 1),
    ("replica-watch.test", "/sale/discount", 1),
    ("tracker.metrics.test", "/collect/beacon", 1),
    ("doubleads.test", "/adclick/affiliate", 1),
    ("coupon-deals.test", "/affiliate/buy", 1),
    ("torrent-crack.test", "/warez/serial", 1),
    ("clickbait-viral.test", "/shocking/ads", 1),
    ("en.encyclopedia.test", "/wiki/history", 0),
    ("www.university.test", "/research/papers/12", 0),
    ("news.city.test", "/en/2024/article/401", 0),
    ("docs.library.test", "/guide/install.html", 0),
    ("blog.writer.test", "/en/3312/", 0),
    ("www.museum.test", "/collection/item/88", 0),
    ("forum.garden.test", "/de/thread/5501", 0),
    ("m.recipes.test", "/es/pasta/77.html", 0),
    ("archive.journal.test", "/volume/3/issue/2", 0),
    ("www.school.test", "/fr/cours/1034", 0),
    ("science.weekly.test", "/en/articles/20417", 0),
    ("travel.notes.test", "/de/berlin/1180/", 0),
    ("www.council.test", "/minutes/2023.html", 0),
    ("history.society.test", "/fr/43790", 0),
    ("books.reader.test", "/en/review/9834", 0),
    ("music.theory.test", "/lesson/7?page=2", 0),
    ("weather.station.test", "/es/51097/", 0),
    ("code.manual.test", "/en/reference/1065", 0),
    ("health.service.test", "/advice/sleep", 0),
    ("www.observatory.test", "/en/stars/12774", 0),
]


def grams(tag: str, text: str) -> list[int]:
    marked = f"^{text}$"
    return [int(hashlib.md5(f"{tag}{marked[i : i + 3]}".encode()).hexdigest()[:3], 16) for i in range(max(0, len(marked) - 2))]


@lru_cache(maxsize=1)
def fit(steps: int = STEPS, rate: float = 4.0, decay: float = 1e-3) -> tuple[int, list[int]]:
    """(bias, weights) in thousandths, from the labelled table; trigram shares, gradient descent."""
    rows = []
    for host, path, label in LABELLED:
        found = grams("h", host) + grams("p", path.split("?")[0])
        share: dict[int, float] = {}
        for g in found:
            share[g] = share.get(g, 0) + 1 / len(found)
        rows.append((share, label))
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(steps):
        slope: dict[int, float] = {}
        lean = 0.0
        for share, label in rows:
            z = bias + sum(weights[g] * s for g, s in share.items())
            miss = 1 / (1 + math.exp(-z)) - label
            lean += miss / len(rows)
            for g, s in share.items():
                slope[g] = slope.get(g, 0) + miss * s
        bias -= 0.1 * rate * lean
        for g, d in slope.items():
            weights[g] -= rate * (d + decay * weights[g])
    return round(bias * 1000), [round(w * 1000) for w in weights]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Column expressions for the host (A-Z lower-cased) and the path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: list[tuple[str, str]]):
    """The longest rule that fits (ties: the longer host), as a column; null without one."""
    split = [(r, r.partition("/")[0], "/" + r.partition("/")[2]) for r, _ in rules]
    split.sort(key=lambda x: (-len(x[0]), -len(x[1]), x[0]))
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(r)) for r, h, p in split]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def logit(host, path):
    """Thousandths of the log-odds of block, times the number of trigrams: a sum of integers."""
    bias, weights = fit()
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one literal

    def hashed(tag: str, text):
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.when(F.length(marked) >= 3, F.sequence(F.lit(1), F.length(marked) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.conv(F.substr(F.md5(F.concat(F.lit(tag), F.substr(marked, i, F.lit(3))).cast("binary")), F.lit(1), F.lit(3)), 16, 10).cast("int"))

    found = F.concat(hashed("h", host), hashed("p", path))
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, g: total + F.lit(bias) + F.element_at(table, g + 1))


def filter_urls(df: DataFrame, keep: list[str], url_col: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The columns ``keep`` with host, path, rule and verdict (allow or block)."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    mine = [f"_{i}" for i in range(len(keep))]
    parts = df.select(*[F.col(c).alias(m) for c, m in zip(keep, mine)], host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    model = F.when(logit(F.col("host"), F.col("path")) > 0, F.lit("block")).otherwise(F.lit("allow"))
    names = kept_names(keep, "host string, path string, rule string, verdict string")
    return parts.withColumn("verdict", F.when(F.col("rule").isNotNull(), said).otherwise(model)).withColumnsRenamed(dict(zip(mine, names)))


def filter_sql(rules: list[tuple[str, str]] | None = None) -> str:
    """The same over the table ``pages``, for DuckDB."""
    rules = RULES if rules is None else rules
    split = sorted(((r, r.partition("/")[0], "/" + r.partition("/")[2]) for r, _ in rules), key=lambda x: (-len(x[0]), -len(x[1]), x[0]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'" for r, h, p in split)
    said = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    bias, weights = fit()
    hashed = "list_transform(range(1, greatest(length(m{0}) - 1, 1)), lambda i: CAST('0x' || substr(md5('{0}' || substr(m{0}, i, 3)), 1, 3) AS INTEGER))"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE {cases} END AS rule, '^' || host || '$' AS mh, '^' || path || '$' AS mp FROM parts
), summed AS (
  SELECT *, coalesce(list_sum(list_transform(list_concat({hashed.format("h")}, {hashed.format("p")}), lambda g: {bias} + ({weights})[g + 1])), 0) AS z FROM ruled
)
SELECT page_id, host, path, rule, CASE {said} WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict FROM summed"""
