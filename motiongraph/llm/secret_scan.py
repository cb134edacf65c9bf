"""Secret scan: fixed patterns, plus character Markov models for unknown formats.

Two first-order Markov models over characters are trained, one on random strings
and one on ordinary identifiers. A long token outside the patterns' spans is a
secret when its log-likelihood ratio passes a cut set on the identifiers. The
labelled samples come from the corpus: values that the patterns find are random
strings, long words of documents without any such value are identifiers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # same spans as runs of any length, of which those below 32 are dropped
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{11,}"
#: Each class is trained on at most this many distinct strings.
MOST_STRINGS = 20_000
#: Share of identifiers whose ratio stays below the cut.
CLEAN_SHARE = 0.999


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value): leftmost matches that do not overlap, in code points.

    The text between matches and the matches themselves alternate, so their
    lengths add up to positions. Texts without a match cost one pass.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    step = F.transform(F.arrays_zip(between.alias("gap"), found.alias("hit")), lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
    ends = F.aggregate(step, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, F.size(acc))), F.lit(0)) + n)))
    placed = F.transform(
        F.arrays_zip(found.alias("hit"), value.alias("value"), F.slice(ends, F.lit(1), F.size(found)).alias("end")),
        lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def find_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, assign, access, hex, tokens) of each row, as span arrays."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.filter(spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8).alias("assign"),
        F.filter(spans(text, ACCESS), lambda s: F.length(s["value"]) >= 16).alias("access"),
        spans(text, HEX).alias("hex"),
        spans(text, TOKEN).alias("tokens"),
    )


def _sampled(strings: DataFrame) -> DataFrame:
    return strings.distinct().orderBy(F.xxhash64("s"), "s").limit(MOST_STRINGS)


def train(random_strings: DataFrame, identifiers: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratios by (character, next character), row by row, and the cut.

    Both inputs have one column s. Transitions get one pseudo-count. Only the
    transition counts, a table of fixed size, come to the driver.
    """
    n = len(ALPHABET)
    strings = cut(_sampled(random_strings).select("s", F.lit(1).alias("random")).union(_sampled(identifiers).select("s", F.lit(0))), "secret-samples")
    pair = F.explode(_steps(F.col("s")))
    counts = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for r in strings.select("random", pair.alias("p")).filter("p >= 0").groupBy("random", "p").count().collect():
        counts[r["random"]][r["p"] // n][r["p"] % n] += r["count"]
    ratio = [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a])) for a in range(n) for b in range(n)]
    edge = strings.filter("random = 0").select(F.percentile(log_ratio(F.col("s"), ratio), CLEAN_SHARE)).first()[0]
    return ratio, max(edge if edge is not None else math.inf, 0.0)


def _steps(s: Column) -> Column:
    """Number of each pair of neighbouring characters; -1 where one is outside the alphabet."""
    code = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    nxt = F.slice(code, F.lit(2), F.greatest(F.size(code) - 1, F.lit(0)))
    return F.zip_with(F.slice(code, F.lit(1), F.size(nxt)), nxt, lambda a, b: F.when((a >= 0) & (b >= 0), a * len(ALPHABET) + b).otherwise(-1))


def log_ratio(s: Column, ratio: list[float]) -> Column:
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratio) + "]"), "array<double>")
    return F.aggregate(_steps(s), F.lit(0.0), lambda acc, p: acc + F.when(p >= 0, F.element_at(table, p + 1)).otherwise(0.0))


def _ranked(kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), rank.alias("kind"), s["end"].alias("end")))


def _listed(*kinds: str) -> Column:
    """kind:start:end of the spans, by start, then kind, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(_ranked, kinds))), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the span arrays assign, access, hex and random.

    Null and empty texts have no spans; repeated rows are scanned each on its
    own; an empty table gives an empty result. Where the corpus holds no string
    of one class, the models add nothing. Only id and text are read, so other
    columns cannot clash.
    """
    found = cut(find_base(docs, id_col, text_col), "secret-spans")
    base = F.concat("assign", "access", "hex")
    values = found.select(F.explode(F.transform(base, lambda s: s["value"])).alias("s")).filter(F.length("s") >= 16)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = ~F.regexp_like(text, F.lit(f"{ASSIGN}|{ACCESS}|{HEX}"))
    words = docs.filter(plain).select(F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    ratio, edge = train(values, words)
    outside = F.filter("tokens", lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    judged = F.filter(outside, lambda t: log_ratio(t["value"], ratio) > edge) if math.isfinite(edge) else F.filter("tokens", lambda t: F.lit(False))
    return found.select("doc_id", "assign", "access", "hex", judged.alias("random"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed("assign", "access", "hex"), 256).alias("base_sha256"),
        _listed(*KINDS).alias("spans"),
    )
