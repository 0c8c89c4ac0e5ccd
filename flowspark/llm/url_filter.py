"""URL filter: explicit rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, long_array

#: (verdict, host, path prefix); a rule holds for its host and all subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

BLOCKED_NAMES = """casino casino-win win-casino online-casino free-bets bets-now sports-bets best-bets cheap-pills pills-online
 pills-shop viagra-shop poker-win free-poker slots-jackpot win-slots payday-loan fast-loan cheap-loan adult-cams xxx-videos
 hot-adult free-xxx porn-tube click-win win-prize lottery-win replica-watch cheap-meds keygen-crack free-spins jackpot-casino""".split()
ALLOWED_NAMES = """news wiki library science history garden weather recipes museum school university docs forum journal archive maps
 music travel theatre chess kitchen physics poetry biology health football research city-council public-library bookshop
 national-park open-data radio hospital post-office""".split()
#: Everyday words of several languages; pairs of them name hosts that say nothing, so that the bias says allow.
NEUTRAL_WORDS = """station leather northern mountain river apple carpenter brother evening kitchen meadow lantern nation
 harbour winter teacher engine village copper motion thunder weaver window paper silver market fashion corner
 bahnhof garten werkstatt fenster strasse schule zeitung wasser handwerk licht
 maison jardin chemin lumiere fontaine marche atelier voyage montagne soleil
 casa camino ciudad libro mercado estrella fuente madera puente cocina""".split()
LOWER = str.maketrans(UPPER, UPPER.lower())
#: Endings and prefixes meet names of both labels, so that they say little themselves.
TRAINING_DOMAINS = """example.com com example.net net example.org org io de fr es edu gov co.uk info eu dev it nl ch ca""".split()
TRAINING_PREFIXES = ["", "www.", "m.", "blog.", "", "en.", "shop.", "mail.", "docs.", ""]
#: Parts of names that the web has many of, and numbers in place of names; like the everyday words they say nothing.
WEB_WORDS = """code stack hub data cloud times post mail search photo video stream social chat game store ticket hotel flight bank card
 tech soft ware byte pixel graph node cache server proxy kernel parse query index table column spark flow batch cluster
 daily herald tribune gazette observer weekly review digest press media channel broadcast""".split()
NUMBERED = [f"{a}.{b}.{c}.{d}" for a, b, c, d in zip(range(1, 255, 17), range(0, 255, 16), range(0, 60, 4), range(1, 150, 10), strict=False)]
#: Paths of either label; every path meets hosts of both labels, so its n-grams are learned apart from the host's.
BLOCKED_PATHS = """casino casino-win/free-bets online-casino/bonus free-bets/today sports-bets/odds best-bets.html bets-now
 cheap-pills/viagra-shop pills-online/order pills-shop viagra/buy cheap-meds/no-prescription free-poker/download poker-win
 slots-jackpot/play free-spins/slots jackpot win-prize/click-here lottery-win/claim payday-loan/apply fast-loan cheap-loan/today
 adult-cams/live xxx-videos/free hot-adult/cams free-xxx porn-tube/videos porn replica-watch/shop replica-watches
 keygen-crack/download crack/serial-keygen""".split()
ALLOWED_PATHS = """en/1204 de/3391.html fr/577/ es/8810 index.html about contact news/2021/05/town-council articles/river-history.html
 docs/install/guide blog/2019/garden-notes wiki/Physics category/books/page/2 images/map.png events/summer-concert
 recipes/apple-cake research/papers/117 school/timetable library/opening-hours forum/thread/4410 archive/1998/letters
 travel/mountain-huts weather/today privacy search products/lamp-42 team/people.php download/report.pdf sports/results/league
 health/advice/sleep users/login en/77/ de/9025 fr/6448.html es/315/ en/5590.html de/140/ fr/2816 es/4703.html""".split() + ["", ""]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (url, label): blocked if the host or the path is.

    Names and paths of both labels are paired evenly with each other, with the domains and the
    prefixes; neutral names meet paths of both labels. Paths also come in title case and capitals.
    """
    rows = []

    def pair(names: list[str], paths: list[str], label: int, times: int) -> None:
        for i, name in enumerate(names):
            for j in range(times):
                host = f"{TRAINING_PREFIXES[(3 * i + j) % len(TRAINING_PREFIXES)]}{name}.{TRAINING_DOMAINS[(i + 7 * j) % len(TRAINING_DOMAINS)]}"
                host = name if name[0].isdigit() else host
                path = paths[(i * times + j) % len(paths)]
                rows.append((f"https://{host}/{(path, path, path.title(), path.upper())[(i + 3 * j) % 4]}", label))

    words = NEUTRAL_WORDS + WEB_WORDS
    k = len(words)
    neutral = [words[i % k] + ("-", "", "")[i % 3] + (words[(7 * i + i // k + 1) % k] if i % 3 < 2 else "") for i in range(5 * k)] + NUMBERED
    pair(BLOCKED_NAMES, ALLOWED_PATHS, 1, 5)
    pair(ALLOWED_NAMES, BLOCKED_PATHS, 1, 2)
    pair(neutral[: 3 * k], BLOCKED_PATHS, 1, 1)
    pair(ALLOWED_NAMES, ALLOWED_PATHS, 0, 5)
    pair(neutral, ALLOWED_PATHS, 0, 3)
    return rows


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngram_buckets(host: Column, path: Column, n: int = 4) -> Column:
    """Bucket numbers 0..16383 (the first 14 bits of md5) of the character n-grams of host and of path, each marked at its ends."""

    def grams(mark: str, part: Column) -> Column:
        padded = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        hashed = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(padded, i, F.lit(n)))), F.lit(1), F.lit(4)), 16, 10)
        return F.transform(starts, lambda i: F.shiftright(hashed(i).cast("int"), 2))

    return F.concat(grams("h", host), grams("p", path))


def url_buckets(url: str, n: int = 4) -> list[int]:
    """``ngram_buckets`` of one URL, for the labelled table."""
    found = re.search("://([^/?#]*)([^?#]*)", url)
    out = []
    for mark, part in zip("hp", found.groups() if found else ("", ""), strict=True):
        padded = f"^{part.translate(LOWER) if mark == 'h' else part}$"
        grams = [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
        out += [int(hashlib.md5(f"{mark}{g}".encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) >> 2 for g in grams]
    return out


def fit_url_model(labelled, buckets: int = 1 << 14, max_rows: int = 20_000, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[int], int]:
    """Weights and bias, in millionths, of a logistic regression fitted to (url, label) rows.

    ``labelled`` is a list or a DataFrame, of which at most ``max_rows`` rows are taken; the
    labelled table is small by contract, and the fit is done once, before any page is read.
    """
    if isinstance(labelled, DataFrame):
        labelled = [tuple(r) for r in labelled.where("url is not null and label is not null").select("url", "label").limit(max_rows).collect()]
    rows = list(labelled)[:max_rows]
    if not rows:
        return [0] * buckets, 0
    grams = [url_buckets(url) for url, _ in rows]
    column, row = np.array([g for r in grams for g in r]), np.repeat(np.arange(len(rows)), [len(r) for r in grams])
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(buckets), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[column], len(rows)) + b))) - y
        w -= rate * (np.bincount(column, error[row], buckets) / len(rows) + ridge * w)
        b -= rate * error.mean()
    return [int(round(v * 1e6)) for v in w], int(round(b * 1e6))


def rule_for(host: Column, path: Column, rules=None) -> Column:
    """Text (host and path prefix) of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("string")
    for _, rule_host, prefix in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        chosen = F.when(fits, F.lit(rule_host + prefix)).otherwise(chosen)
    return chosen


def filter_urls(pages: DataFrame, model: tuple[list[int], int], rules=None) -> DataFrame:
    """Judge every url: the longest fitting rule decides, else the model's score.

    Columns page_id, host, path, rule, verdict, score (millionths; positive means block). A null
    url or one without ``://`` has empty host and path and is judged by the bias and the n-grams
    of empty parts. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are not read. All of it is a projection: no shuffle, whatever the hosts' skew.
    """
    rules = RULES if rules is None else rules
    weights, bias = model
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    table = long_array(weights)
    score = F.aggregate(ngram_buckets(F.col("host"), F.col("path")), F.lit(bias).cast("long"), lambda total, i: total + F.element_at(table, i + 1))
    judged = parsed.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("rule"), score.alias("score"))
    by_rule = F.lit(None).cast("string")
    for verdict, rule_host, prefix in rules:
        by_rule = F.when(F.col("rule") == rule_host + prefix, F.lit(verdict)).otherwise(by_rule)
    by_model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit_url_model(labelled_urls()))
