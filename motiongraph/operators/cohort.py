"""Cohort, error and summary statistics over long tables. Missing values are NULL and are skipped."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import matched, quantiles, with_quantiles


def summary(c: str) -> list[Column]:
    return [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def deform_info(df: DataFrame, c: str, keys: Sequence[str]) -> DataFrame:
    """Smallest, largest and mean value, the range in % of the smallest, and a line of text."""
    s = df.groupBy(*keys).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"))
    s = s.withColumn("percent", 100 * (F.col("max") - F.col("min")) / F.nullif(F.col("min"), F.lit(0.0)))
    return s.withColumn("text", F.format_string("min %d max %d", F.floor("min"), F.floor("max")))


def paired_errors(a: DataFrame, b: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Absolute error per axis and in space of one method against another."""
    j = a.join(b.select(*keys, *[F.col(x).alias(f"o{x}") for x in axes]), list(keys))
    d = [F.col(x) - F.col(f"o{x}") for x in axes]
    return j.select(*keys, *[F.abs(e).alias(f"e{x}") for x, e in zip(axes, d)], F.sqrt(sum((e * e for e in d[1:]), d[0] * d[0])).alias("error"))


def error_stats(err: DataFrame, c: str, keys: Sequence[str]) -> DataFrame:
    """Root mean square, and mean, std and largest absolute error."""
    a = F.abs(F.col(c))
    return err.groupBy(*keys).agg(F.sqrt(F.avg(a * a)).alias("rmse"), F.avg(a).alias("mae"), F.stddev_pop(a).alias("std"), F.max(a).alias("max"))


def amplitude_error(patterns: DataFrame, reference: DataFrame, keys: Sequence[str], c: str = "value") -> DataFrame:
    """Largest value of each pattern minus that of its reference."""
    top = reference.groupBy(*keys).agg(F.max(c).alias("ref"))
    return patterns.groupBy(*keys).agg(F.max(c).alias("top")).join(top, list(keys)).select(*keys, (F.col("top") - F.col("ref")).alias("error"))


def observer_rollup(err: DataFrame, position: Sequence[str], c: str = "error") -> DataFrame:
    """Errors averaged over observers per position, then summarised."""
    m = err.groupBy(*position).agg(F.avg(c).alias("m"))
    return with_quantiles(m.agg(*summary("m")), m, (), "m", {"median": 0.5})


def translation(landmark: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Range of each axis over the phases."""
    return landmark.groupBy(*keys).agg(*[(F.max(a) - F.min(a)).alias(f"t{a}") for a in axes])


def change_from_baseline(measure: DataFrame, baseline: int = 0) -> DataFrame:
    """Adds ``change`` against the baseline time point of the same patient and metric; null without one."""
    base = measure.filter(F.col("timepoint") == baseline).select("patient", "metric", F.col("value").alias("base"))
    return measure.join(base, ["patient", "metric"], "left").withColumn("change", F.col("value") - F.col("base")).drop("base")


def over_time(measure: DataFrame, baseline: int = 0) -> DataFrame:
    """Per metric and time point: statistics of the value, and mean and std of the change from baseline."""
    return change_from_baseline(measure, baseline).groupBy("metric", "timepoint").agg(F.count("value").alias("n"), *summary("value"), F.avg("change").alias("mean_change"), F.stddev_pop("change").alias("std_change"))


def pooled(measure: DataFrame) -> DataFrame:
    """Statistics per metric and over all (metric null), time points pooled; no set meets in one task."""
    sets = measure.rollup("metric").agg(F.grouping("metric").alias("every"), F.count("value").alias("n"), *summary("value"))
    each = quantiles(measure, ("metric",), "value", QUARTILES).withColumn("every", F.lit(0))
    every = quantiles(measure, (), "value", QUARTILES).select(F.lit(None).cast(measure.schema["metric"].dataType).alias("metric"), "*", F.lit(1).alias("every"))
    return matched(sets, each.unionByName(every), ("metric", "every")).drop("every")


def group_stats(measure: DataFrame, keys: Sequence[str], c: str = "value") -> DataFrame:
    """Missing-aware statistics and box-plot numbers."""
    return with_quantiles(measure.groupBy(*keys).agg(F.count(c).alias("n"), *summary(c)), measure, keys, c, QUARTILES)


def pulsatility_summary(values: DataFrame, ring: str, direction: str, c: str) -> DataFrame:
    """Over ring, direction and both (cube): mean and largest value; of each ring also the direction of the largest."""
    return values.cube(ring, direction).agg(F.avg(c).alias("mean"), F.max(c).alias("max"), F.max(F.struct(F.col(c), F.col(direction).alias("w")))["w"].alias("direction_max"))


def deployment(measure: DataFrame, peak: str, valley: str, first: int, last: int, nominal: float) -> DataFrame:
    """Per patient: peak over valley, deployment in % of a nominal size, and the change from first to last."""
    at = lambda m, tp: F.max(F.when((F.col("metric") == m) & (F.col("timepoint") == tp), F.col("value")))
    s = measure.filter(F.col("metric").isin(peak, valley) & F.col("timepoint").isin(first, last)).groupBy("patient").agg(at(peak, first).alias("p0"), at(valley, first).alias("v0"), at(peak, last).alias("p1"), at(valley, last).alias("v1"))
    level = lambda p, v: 100 * (F.col(p) + F.col(v)) / 2 / nominal
    return s.select("patient", (F.col("p0") / F.nullif(F.col("v0"), F.lit(0.0))).alias("asymmetry"), level("p0", "v0").alias("deployment"), (level("p1", "v1") - level("p0", "v0")).alias("change"))


def ttest_paired(a: DataFrame, b: DataFrame, keys: Sequence[str], c: str = "value", p_value: bool = True) -> DataFrame:
    """t statistic, degrees of freedom, mean difference and two-sided p of the paired test."""
    d = a.join(b.select(*keys, F.col(c).alias("other")), list(keys)).select((F.col(c) - F.col("other")).alias("d")).filter("d IS NOT NULL")
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("difference"), F.stddev_samp("d").alias("s"))
    t = s.select((F.col("n") - 1).alias("df"), "difference", (F.col("difference") / (F.col("s") / F.sqrt("n"))).alias("t"))
    return with_p(t) if p_value else t


def ttest_ind(a: DataFrame, b: DataFrame, c: str = "value", p_value: bool = True) -> DataFrame:
    """As ttest_paired, of two independent groups of equal variance."""
    one = lambda df, p: df.filter(F.col(c).isNotNull()).agg(F.count(c).alias(f"n{p}"), F.avg(c).alias(f"m{p}"), F.var_samp(c).alias(f"v{p}"))
    s = one(a, "a").join(F.broadcast(one(b, "b")))  # one row each
    df = F.col("na") + F.col("nb") - 2
    pool = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / df
    t = s.select(df.alias("df"), (F.col("ma") - F.col("mb")).alias("difference"), ((F.col("ma") - F.col("mb")) / F.sqrt(pool * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"))
    return with_p(t) if p_value else t


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    tiny, c, f, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) * (f - 1) / a


def with_p(t: DataFrame) -> DataFrame:
    """Adds ``p``, two-sided, to rows (t, df); one reduced row a test."""
    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or n < 1 else _beta_tail(n / 2, 0.5, n / (n + x * x)) for x, n in zip(ts, dfs)], dtype="float64")

    return t.withColumn("p", p("t", "df"))


def normality_screen(df: DataFrame, c: str, keys: Sequence[str], critical: float = 5.991464547107979) -> DataFrame:
    """Jarque-Bera statistic and whether it stays below the critical value (5 % by default)."""
    s = df.groupBy(*keys).agg(F.count(c).alias("n"), F.skewness(c).alias("s"), F.kurtosis(c).alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return s.select(*keys, "n", jb.alias("jb"), (jb < critical).alias("normal"))


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; the last one includes hi."""
    v = df.filter(F.col(c).between(lo, hi))
    return v.groupBy(F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def drop_outlier_seeds(seeds: DataFrame, keys: Sequence[str], factor: float = 2.5, least: float | None = None, c: str = "v") -> DataFrame:
    """Drop seeds more than factor std above the mean (and at least ``least``, where given)."""
    m = seeds.groupBy(*keys).agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"))
    far = F.col(c) - F.col("m") > factor * F.col("s")
    if least is not None:
        far = far & (F.col(c) >= least)
    return seeds.join(m, list(keys)).filter(~far).drop("m", "s")


def with_device(measure: DataFrame, device: DataFrame) -> DataFrame:
    """Device size by patient; the device table has one row a patient, so Spark picks the join by its size."""
    return measure.join(device, "patient", "left")


def device_stats(measure: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled statistics with the normality flag."""
    flag = normality_screen(measure, "value", keys).select(*keys, "normal")
    return measure.groupBy(*keys).agg(F.count("value").alias("n"), *summary("value")).join(flag, list(keys))


def errors_by_profile(err: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean and largest absolute error placed at each profile's amplitude."""
    e = err.join(profile, "profile")
    return e.groupBy("profile", "amplitude").agg(F.avg(F.abs("error")).alias("mean"), F.max(F.abs("error")).alias("max"))


def remap_groups(measure: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename metrics where the mapping (patient, metric, new_metric) says so."""
    return measure.join(mapping, ["patient", "metric"], "left").withColumn("metric", F.coalesce("new_metric", "metric")).drop("new_metric")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of two sheets by patient, metric and time point, whatever their order."""
    on = ["patient", "metric", "timepoint"]
    return a.join(b.select(*on, F.col("value").alias("other")), on)


def cohort_matrix(measure: DataFrame, metric: str, timepoints: Sequence[int]) -> DataFrame:
    """Patients by time points."""
    return measure.filter(F.col("metric") == metric).groupBy("patient").pivot("timepoint", list(timepoints)).agg(F.first("value"))
