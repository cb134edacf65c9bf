"""URL filter: rules first, then host word segmentation and naive Bayes.

A URL that a rule fits has the rule's verdict, the longest rule winning. For the
others the host is cut into words: a unigram model of words, counted over the
titles and paths of all pages and the labelled URLs, splits each run of letters
into its most probable words (Viterbi). Multinomial naive Bayes, trained on
labelled URLs that went through the same steps, scores the words of host and
path; a positive log odds for "block" blocks.

Segmentation runs once per distinct run of letters and host scores once per
distinct host, so frequent hosts cost nothing extra.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii, read

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled sample for the default training: URLs of each verdict.
LABELLED = {
    "block": (
        "http://online-casino-win.test/slots/jackpot", "http://bestcasinobonus.test/casino/poker", "http://winbigcasino.test/bets", "http://free-bets.test/betting/odds",
        "http://freebetsnow.test/win/bets", "http://cheap-pills.test/pills/viagra", "http://cheappillsonline.test/pharmacy", "http://buypills.test/cheap/pills",
        "http://spam-farm.test/spam/links", "http://linkfarm.test/farm/spam", "http://spammail.test/bulk/spam", "http://adult-x.test/xxx/adult", "http://adultvideos.test/porn/sex",
        "http://sexcams.test/adult/cams", "http://xxx-porn.test/adult", "http://ads-track.test/ads/click", "http://adstracker.test/track/pixel", "http://clicktrack.test/ads/banner",
        "http://malware-download.test/crack/warez", "http://warezcrack.test/torrent/keygen", "http://phishing-login.test/account/verify", "http://payday-loans.test/cash/loans",
    ),
    "allow": (
        "http://www.daily-news.test/en/world", "http://newsroom.test/article/politics", "http://blog.open-science.test/en/research", "http://scienceblog.test/post/physics",
        "http://www.city-library.test/books/catalog", "http://onlinelibrary.test/history/books", "http://m.weather-report.test/de/weather", "http://cookingrecipes.test/recipes/soup",
        "http://university.test/course/math", "http://schoolbook.test/fr/lesson", "http://www.health-guide.test/medicine/doctor", "http://travelguide.test/es/travel", "http://musichall.test/concert/music",
        "http://gardenhouse.test/plants/garden", "http://softwaredocs.test/docs/manual", "http://www.encyclopedia.test/wiki/article", "http://photogallery.test/art/photo", "http://sportsclub.test/football/match",
        "http://blog.family.test/en/page", "http://government.test/law/public", "http://bookstore.test/shop/books", "http://m.train-times.test/travel/train",
    ),
}
#: At most this many labelled URLs are used to train.
MOST_LABELLED = 20_000
LONGEST_WORD = 20
LETTERS = "[a-z]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null or without "://"."""
    form = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, form, 1)), F.regexp_extract(url, form, 2)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fitting = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def _viterbi(run: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Most probable split; an unknown word of n letters costs ``unknown`` and 1 more decade per letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for begin in range(max(0, end - LONGEST_WORD), end):
            p = known.get((begin, end), unknown - (end - begin) * math.log(10.0))
            options.append((best[begin][0] + p, begin))
        best.append(max(options))
    words, end = [], len(run)
    while end:
        words.append(run[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segment(runs: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """(run, words) for distinct runs of letters; vocabulary: (word, n).

    Only the parts of a run that are words of the vocabulary are gathered, at
    most LONGEST_WORD per letter of the run.
    """
    parts = runs.select(
        "run",
        F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("run") - 1), lambda b: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - b)), lambda n: F.struct(b.alias("begin"), n.alias("n")))))).alias("at"),
    ).select("run", "at.begin", (F.col("at.begin") + F.col("at.n")).alias("end"), F.substring("run", F.col("at.begin") + 1, F.col("at.n")).alias("word"))
    known = parts.join(vocabulary, "word").groupBy("run").agg(F.collect_list(F.struct("begin", "end", F.log(F.col("n") / F.lit(float(max(total, 1)))).alias("p"))).alias("known"))
    unknown = math.log(10.0 / max(total, 1))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([_viterbi(r, {(k["begin"], k["end"]): k["p"] for k in (ks if ks is not None else ())}, unknown) for r, ks in zip(run, known)])

    return runs.join(known, "run", "left").select("run", split("run", "known").alias("words"))


def train_bayes(labelled: DataFrame) -> dict[str, float]:
    """Log odds of "block" for each word of labelled (word, verdict), with one pseudo-count."""
    counts = {(r["word"], r["verdict"]): r["count"] for r in labelled.groupBy("word", "verdict").count().collect()}
    words = {w for w, _ in counts}
    total = {v: sum(c for (_, x), c in counts.items() if x == v) + len(words) for v in ("block", "allow")}
    return {w: math.log((counts.get((w, "block"), 0) + 1) / total["block"]) - math.log((counts.get((w, "allow"), 0) + 1) / total["allow"]) for w in words}


def _sum_odds(words: Column, odds: dict[str, float]) -> Column:
    table = F.from_json(F.lit("{" + ",".join(f'"{w}":{x:.6f}' for w, x in sorted(odds.items())) + "}"), "map<string,double>")
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.element_at(table, w), F.lit(0.0)))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, log_odds.

    labelled: (url, verdict); by default the URLs above. A null or empty URL has
    empty host and path, no rule and log odds 0, so it is allowed. Null html adds
    no words. Repeated rows are judged alike; an empty table gives an empty
    result. Words that the labelled URLs do not have count for neither verdict.
    """
    spark = pages.sparkSession
    host, path = host_and_path(pages[url_col])
    page = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), F.regexp_extract(F.coalesce(pages[html_col], F.lit("")), r"<title>([^<]*)", 1).alias("title"))
    if labelled is None:
        labelled = spark.createDataFrame([(u, v) for v, urls in LABELLED.items() for u in urls], "url string, verdict string")
    host, path = host_and_path(F.col("url"))
    sample = labelled.filter("verdict IN ('block', 'allow')").orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED).select(host.alias("host"), path.alias("path"), "verdict")

    texts = page.select(F.concat_ws(" ", "title", "path").alias("t")).unionAll(sample.select(F.concat_ws(" ", F.translate("host", ".", " "), "path")))
    vocabulary = texts.select(F.explode(_runs(F.col("t"))).alias("word")).filter(f"length(word) BETWEEN 2 AND {LONGEST_WORD}").groupBy("word").agg(F.count("*").alias("n")).persist()
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    hosts = page.select("host").unionAll(sample.select("host")).distinct()
    run_of = hosts.select("host", F.explode(_runs(F.col("host"))).alias("run"))
    words = segment(run_of.select("run").distinct(), vocabulary, total)
    host_words = run_of.join(words, "run").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words")).persist()
    seen = sample.join(host_words, "host", "left").select("verdict", F.explode(F.concat(F.coalesce("words", F.array().cast("array<string>")), _runs(F.col("path")))).alias("word"))
    odds = train_bayes(seen)
    host_odds = host_words.select("host", _sum_odds(F.col("words"), odds).alias("host_odds"))
    judged = page.join(host_odds, "host", "left").withColumn("log_odds", F.coalesce("host_odds", F.lit(0.0)) + _sum_odds(_runs(F.col("path")), odds))
    fits = ruled(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", fits["rule"].alias("rule"), F.coalesce(fits["verdict"], F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
