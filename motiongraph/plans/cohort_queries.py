"""Queries over measures, errors and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as op
from ..sources import tables as t
from .motion_queries import stats
from .registry import query, r

Q = {"q1": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)", "q3": "quantile_cont({c}, 0.75)"}


def box(c: str) -> dict[str, str]:
    return {k: v.format(c=c) for k, v in Q.items()}


@query("a17_deform_info", "measure", f"SELECT metric, {r(min='min(value)', max='max(value)', mean='avg(value)', percent='100 * (max(value) - min(value)) / min(value)')}, format('min {{:d}} max {{:d}}', CAST(floor(min(value)) AS BIGINT), CAST(floor(max(value)) AS BIGINT)) AS text FROM measure GROUP BY 1")
def a17(spark, d):
    return op.deform_info(t.measure(spark, d), "value", ("metric",))


#: Method a is a path's own rows, method b the row after.
ERR = "er AS (SELECT a.path_id AS observer, a.idx AS landmark, a.phase, abs(a.x - b.x) AS ex, abs(a.y - b.y) AS ey, abs(a.z - b.z) AS ez, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS error FROM posed a JOIN posed b ON a.path_id = b.path_id AND a.idx = b.idx - 1 AND a.phase = b.phase)"


def _landmarks(spark, d):
    from .motion_queries import posed

    p = posed(spark, d).select(F.col("path_id").alias("observer"), F.col("idx").alias("landmark"), "phase", "x", "y", "z")
    return p, p.withColumn("landmark", F.col("landmark") - 1)


def _errors(spark, d):
    return op.paired_errors(*_landmarks(spark, d), ("observer", "landmark", "phase"))


@query("j22_paired_errors", "posed", f"{ERR} SELECT observer, landmark, phase, {r(ex='ex', ey='ey', ez='ez', error='error')} FROM er")
def j22(spark, d):
    return _errors(spark, d)


@query("a18_error_stats", "posed", f"{ERR} SELECT observer, {r(rmse='sqrt(avg(error * error))', mae='avg(error)', std='stddev_pop(error)', max='max(error)')} FROM er GROUP BY 1")
def a18(spark, d):
    return op.error_stats(_errors(spark, d), "error", ("observer",))


@query("a19_amplitude_error", "signal", f"SELECT source, {r(error='max(value) FILTER (WHERE idx % 2 = 0) - max(value) FILTER (WHERE idx % 2 = 1)')} FROM signal GROUP BY 1")
def a19(spark, d):
    s = t.signal(spark, d)
    return op.amplitude_error(s.filter("idx % 2 = 0"), s.filter("idx % 2 = 1"), ("source",))


@query("a20_observer_rollup", "posed", f"{ERR}, m AS (SELECT landmark, phase, avg(error) AS m FROM er GROUP BY 1, 2) SELECT {stats('m', median='quantile_cont(m, 0.5)')} FROM m")
def a20(spark, d):
    return op.observer_rollup(_errors(spark, d), ("landmark", "phase"))


@query("a21_translation", "posed", f"SELECT path_id AS observer, idx AS landmark, {r(tx='max(x) - min(x)', ty='max(y) - min(y)', tz='max(z) - min(z)')} FROM posed GROUP BY 1, 2")
def a21(spark, d):
    return op.translation(_landmarks(spark, d)[0], ("observer", "landmark"))


BASE = "b AS (SELECT m.*, m.value - o.value AS change FROM measure m LEFT JOIN measure o ON o.patient = m.patient AND o.metric = m.metric AND o.timepoint = 0)"


@query("a23_over_time", "measure", f"{BASE} SELECT metric, timepoint, count(value) AS n, {stats('value', mean_change='avg(change)', std_change='stddev_pop(change)')} FROM b GROUP BY 1, 2")
def a23(spark, d):
    return op.over_time(t.measure(spark, d))


@query("a24_pooled", "measure", f"SELECT metric, count(value) AS n, {stats('value', **box('value'))} FROM measure GROUP BY ROLLUP (metric)")
def a24(spark, d):
    return op.pooled(t.measure(spark, d))


@query("a25_group_stats", "measure", f"SELECT metric, timepoint, count(value) AS n, {stats('value', **box('value'))} FROM measure GROUP BY 1, 2")
def a25(spark, d):
    return op.group_stats(t.measure(spark, d), ("metric", "timepoint"))


@query("a26_pulsatility_summary", "measure", f"SELECT timepoint, metric, {r(mean='avg(value)', max='max(value)')}, arg_max(m, (value, m)) AS direction_max FROM (SELECT timepoint, metric, metric AS m, value FROM measure) GROUP BY CUBE (timepoint, metric)")
def a26(spark, d):
    return op.pulsatility_summary(t.measure(spark, d).withColumn("way", F.col("metric")), "timepoint", "metric", "value").select("timepoint", "metric", "mean", "max", "direction_max")


@query("a28_deployment", "measure", f"s AS (SELECT patient, max(value) FILTER (WHERE metric = '1-URGENT' AND timepoint = 0) AS p0, max(value) FILTER (WHERE metric = '5-LOW' AND timepoint = 0) AS v0, max(value) FILTER (WHERE metric = '1-URGENT' AND timepoint = 1) AS p1, max(value) FILTER (WHERE metric = '5-LOW' AND timepoint = 1) AS v1 FROM measure WHERE metric IN ('1-URGENT', '5-LOW') AND timepoint IN (0, 1) GROUP BY 1) SELECT patient, {r(asymmetry='p0 / v0', deployment='100 * (p0 + v0) / 2 / 200', change='100 * (p1 + v1) / 2 / 200 - 100 * (p0 + v0) / 2 / 200')} FROM s")
def a28(spark, d):
    return op.deployment(t.measure(spark, d), "1-URGENT", "5-LOW", 0, 1, 200.0)


@query("a37_ttest_paired", "measure", f"d AS (SELECT a.value - b.value AS d FROM measure a JOIN measure b ON a.patient = b.patient AND a.timepoint = b.timepoint WHERE a.metric = '1-URGENT' AND b.metric = '5-LOW') SELECT count(*) - 1 AS df, {r(difference='avg(d)', t='avg(d) / (stddev_samp(d) / sqrt(count(*)))')} FROM d")
def a37(spark, d):
    m = t.measure(spark, d)
    return op.ttest_paired(m.filter("metric = '1-URGENT'"), m.filter("metric = '5-LOW'"), ("patient", "timepoint"), p_value=False)


@query("a37_ttest_paired_p")
def a37p(spark, d):
    m = t.measure(spark, d)
    return op.ttest_paired(m.filter("metric = '1-URGENT'"), m.filter("metric = '5-LOW'"), ("patient", "timepoint"))


@query("a38_ttest_ind", "measure", f"s AS (SELECT count(*) FILTER (WHERE metric = '1-URGENT') AS na, count(*) FILTER (WHERE metric = '5-LOW') AS nb, avg(value) FILTER (WHERE metric = '1-URGENT') AS ma, avg(value) FILTER (WHERE metric = '5-LOW') AS mb, var_samp(value) FILTER (WHERE metric = '1-URGENT') AS va, var_samp(value) FILTER (WHERE metric = '5-LOW') AS vb FROM measure) SELECT na + nb - 2 AS df, {r(difference='ma - mb', t='(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))')} FROM s")
def a38(spark, d):
    m = t.measure(spark, d)
    return op.ttest_ind(m.filter("metric = '1-URGENT'"), m.filter("metric = '5-LOW'"), p_value=False)


JB = "count(value) / 6.0 * (pow(pow(count(value), 0.5) * sum(pow(value - m, 3)) / pow(sum(pow(value - m, 2)), 1.5), 2) + pow(count(value) * sum(pow(value - m, 4)) / pow(sum(pow(value - m, 2)), 2) - 3, 2) / 4)"
CENTRED = "cm AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS m FROM measure)"


@query("a39_normality_screen", "measure", f"{CENTRED} SELECT metric, count(value) AS n, {r(jb=JB)}, {JB} < 5.991464547107979 AS normal FROM cm GROUP BY 1")
def a39(spark, d):
    return op.normality_screen(t.measure(spark, d), "value", ("metric",))


@query("a40_histogram", "measure", "SELECT least(CAST(floor((value - 0) / 50) AS BIGINT), 7) AS bin, count(*) AS n FROM measure WHERE value BETWEEN 0 AND 400 GROUP BY 1")
def a40(spark, d):
    return op.histogram(t.measure(spark, d), "value", 0.0, 400.0, 8)


@query("a49_device_stats", "measure", f"{CENTRED} SELECT metric, count(value) AS n, {stats('value')}, {JB} < 5.991464547107979 AS normal FROM cm GROUP BY 1")
def a49(spark, d):
    return op.device_stats(t.measure(spark, d), ("metric",))


@query("a54_errors_by_profile", "posed", f"{ERR} SELECT observer AS profile, {r(amplitude='0.5 * observer', mean='avg(abs(error))', max='max(abs(error))')} FROM er GROUP BY 1")
def a54(spark, d):
    e = _errors(spark, d).select(F.col("observer").alias("profile"), "error")
    return op.errors_by_profile(e, t.path(spark, d).select(F.col("path_id").alias("profile")).distinct().withColumn("amplitude", F.col("profile") * 0.5))


@query("j26_align", "measure", f"SELECT a.patient, a.metric, a.timepoint, {r(value='a.value', other='b.value')} FROM measure a JOIN measure b ON a.patient = b.patient AND a.metric = b.metric AND b.timepoint = a.timepoint + 1")
def j26(spark, d):
    m = t.measure(spark, d)
    return op.align(m, m.withColumn("timepoint", F.col("timepoint") - 1))


@query("j27_with_device", "measure device", f"SELECT device_size, count(*) AS n, {r(mean='avg(value)')} FROM measure LEFT JOIN device USING (patient) GROUP BY 1")
def j27(spark, d):
    return op.with_device(t.measure(spark, d), t.device(spark, d)).groupBy("device_size").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("p12_remap_groups", "measure", f"SELECT patient, timepoint, CASE WHEN patient % 10 = 0 AND metric = '1-URGENT' THEN '5-LOW' WHEN patient % 10 = 0 AND metric = '5-LOW' THEN '1-URGENT' ELSE metric END AS metric, {r(value='value')} FROM measure")
def p12(spark, d):
    m = t.measure(spark, d)
    swapped = F.when(F.col("metric") == "1-URGENT", "5-LOW").otherwise("1-URGENT")
    rule = m.filter("patient % 10 = 0 AND metric IN ('1-URGENT', '5-LOW')").select("patient", "metric").distinct().withColumn("new_metric", swapped)
    return op.remap_groups(m, rule).select("patient", "timepoint", "metric", "value")


@query("s20_cohort_matrix", "measure", f"SELECT patient, {', '.join(r(**{f't{k}': f'max(value) FILTER (WHERE timepoint = {k})'}) for k in range(4))} FROM measure WHERE metric = '1-URGENT' GROUP BY 1")
def s20(spark, d):
    m = op.cohort_matrix(t.measure(spark, d), "1-URGENT", range(4))
    return m.select("patient", *[F.col(str(k)).alias(f"t{k}") for k in range(4)])
