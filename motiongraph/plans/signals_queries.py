"""Queries over time signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as op
from ..sources import tables as t
from .registry import query, r

MIN = "idx % 12 = 5"


@query("w17_peaks")
def w17(spark, d):
    return op.peaks(t.signal(spark, d), 40.0)


CUT = f"""c AS (SELECT *, sum(CASE WHEN {MIN} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY idx) AS period FROM signal),
u AS (SELECT source, period, idx, t, value FROM c UNION ALL SELECT source, period - 1, idx, t, value FROM c WHERE {MIN}),
p AS (SELECT u.source, CAST(u.period AS BIGINT) AS period, idx, t - min(t) OVER (PARTITION BY u.source, u.period) AS t, value - min(value) OVER (PARTITION BY u.source, u.period) AS value FROM u JOIN (SELECT source, max(period) AS last FROM c GROUP BY 1) l ON l.source = u.source WHERE u.period > 0 AND u.period < last)"""


def _periods(spark, d):
    s = t.signal(spark, d)
    return op.periods(s, s.filter(MIN))


@query("w18_periods", "signal", f"{CUT} SELECT source, period, {r(amplitude='max(value) - min(value)', duration='max(t)')} FROM p GROUP BY 1, 2")
def w18(spark, d):
    return op.period_shape(_periods(spark, d))


@query("w19_first_period", "signal", f"m AS (SELECT *, min(t) OVER (PARTITION BY source) AS t0 FROM signal), s AS (SELECT *, min(CASE WHEN t >= t0 + 50000 THEN t END) OVER (PARTITION BY source) AS stop FROM m) SELECT source, idx, {r(t='t')} FROM s WHERE stop IS NULL OR t <= stop")
def w19(spark, d):
    return op.first_period(t.signal(spark, d), 50000.0).select("source", "idx", "t")


LAG = "e AS (SELECT s.source, lag, sqrt(avg(pow(s.value - q.value, 2))) AS rmse FROM signal s, range(-3, 4) l(lag), signal q WHERE q.source = s.source AND q.idx = s.idx + lag AND lag <> 0 GROUP BY 1, 2)"


@query("w20_best_lag", "signal", f"{LAG} SELECT source, arg_min(lag, (rmse, -lag)) AS lag, {r(rmse='min(rmse)')} FROM e GROUP BY 1")
def w20(spark, d):
    s = t.signal(spark, d)
    return op.best_lag(s, s, [-3, -2, -1, 1, 2, 3])


@query("w21_roll", "signal", f"SELECT source, (idx + 5) % count(*) OVER (PARTITION BY source) AS idx, {r(value='value')} FROM signal")
def w21(spark, d):
    return op.roll(t.signal(spark, d), 5).select("source", "idx", "value")


PAD = f"{CUT}, k AS (SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY idx) - 1 AS k FROM p), g AS (SELECT source, period, unnest(range(most + 1)) AS k FROM (SELECT DISTINCT source, period, max(k) OVER (PARTITION BY source) AS most FROM k)), pd AS (SELECT g.source, g.period, g.k, k.value FROM g LEFT JOIN k ON k.source = g.source AND k.period = g.period AND k.k = g.k)"


@query("w22_pad_periods", "signal", f"{PAD} SELECT source, period, k, {r(value='value')} FROM pd")
def w22(spark, d):
    return op.pad_periods(_periods(spark, d))


@query("a46_mean_period", "signal", f"{PAD} SELECT source, k, {r(mean='avg(value)', std='stddev_pop(value)')}, count(value) AS n FROM pd GROUP BY 1, 2")
def a46(spark, d):
    return op.mean_period(op.pad_periods(_periods(spark, d)))


@query("w23_tile", "signal", f"SELECT source, idx, {r(t='t + k * 1000', value='value')} FROM signal, range(3) q(k)")
def w23(spark, d):
    return op.tile(t.signal(spark, d), 3, 1000.0).select("source", "idx", "t", "value")


@query("w25_rebase", "signal", f"SELECT source, idx, {r(first='value - first_value(value) OVER (PARTITION BY source ORDER BY idx)', unit='(value - min(value) OVER (PARTITION BY source)) / (max(value) OVER (PARTITION BY source) - min(value) OVER (PARTITION BY source))')} FROM signal")
def w25(spark, d):
    s = t.signal(spark, d)
    both = op.rebase(s.withColumn("unit", F.col("value")), "first")
    return op.rebase(both, "unit", c="unit").select("source", "idx", F.col("value").alias("first"), "unit")


@query("j25_resample", "signal", f"s AS (SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM signal WINDOW w AS (PARTITION BY source ORDER BY idx)), b AS (SELECT source, min(t) AS t0, (max(t) - min(t)) / 49 AS step FROM signal GROUP BY 1), g AS (SELECT source, k, t0 + k * step AS at FROM b, range(49) q(k)) SELECT g.source, k, {r(t='g.at', value='value + (nv - value) * (g.at - s.t) / (nt - s.t)')} FROM g JOIN s ON s.source = g.source AND s.t <= g.at AND g.at < nt UNION ALL SELECT source, 49, {r(t='max(t)', value='arg_max(value, idx)')} FROM signal GROUP BY 1")
def j25(spark, d):
    return op.resample(t.signal(spark, d), 50)


@query("j25_resample_t_new", "signal", f"s AS (SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM signal WINDOW w AS (PARTITION BY source ORDER BY t, idx)), g AS (SELECT source, k, min(t) + k * (200000.0::DOUBLE / 39) AS at FROM signal, range(40) q(k) GROUP BY 1, 2) SELECT g.source, k, {r(t='g.at', value='value + (nv - value) * (g.at - s.t) / (nt - s.t)')} FROM g JOIN s ON s.source = g.source AND s.t <= g.at AND g.at < nt")
def j25_t_new(spark, d):
    return op.resample(t.signal(spark, d), 40, t_new=200000.0)


@query("j25_resample_at", "signal", f"s AS (SELECT source, t, value, nt, nv FROM (SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM signal WINDOW w AS (PARTITION BY source ORDER BY t, idx)) WHERE nt > t OR nt IS NULL), q AS (SELECT source, idx, t * 1.003 - 600 AS t FROM signal) SELECT q.source, q.idx, {r(t='q.t', value='CASE WHEN q.t = s.t THEN s.value ELSE s.value + (nv - s.value) / (nt - s.t) * (q.t - s.t) END')} FROM q ASOF LEFT JOIN s ON s.source = q.source AND q.t >= s.t")
def j25_at(spark, d):
    """At irregular times, some before the first sample and after the last."""
    s = t.signal(spark, d)
    return op.resample_at(s, s.select("source", "idx", (F.col("t") * 1.003 - 600).alias("t")))


@query("a41_dominant_frequency")
def a41(spark, d):
    return op.dominant_frequency(t.signal(spark, d), 20.0)


@query("w28_radius_drop", "path", "q AS (SELECT *, sqrt(x * x + y * y) AS rr FROM path), w AS (SELECT *, avg(rr) OVER b AS m, count(*) OVER b AS n, lag(x) OVER o AS px, lag(y) OVER o AS py FROM q WINDOW o AS (PARTITION BY path_id ORDER BY idx), b AS (PARTITION BY path_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
       f"SELECT path_id, min(idx) AS idx, {r(r='arg_min(rr, idx)')} FROM w WHERE n > 10 AND rr < 0.75 * m AND sqrt(pow(x - px, 2) + pow(y - py, 2)) > 0.25 * m GROUP BY 1")
def w28(spark, d):
    return op.radius_drop(t.path(spark, d).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), ("path_id",))
