"""Queries on score, attribution and membership tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import attribution as AT
from tracklume.operators import reports as R
from tracklume.operators import select as S
from tracklume.plans.inputs import (
    ATTRIBUTIONS_SQL,
    MEMBERSHIPS_SQL,
    SCORES_SQL,
    attributions,
    memberships,
    scores,
)
from tracklume.plans.registry import registered, twin
from tracklume.schema import SCORES
from tracklume.sources.tables import labelled, new_location, read_recursive_csv, union_all, write_csv, write_runs

WITH_SCORES = f"WITH scores AS ({SCORES_SQL})"
WITH_ATTR = f"WITH attr AS ({ATTRIBUTIONS_SQL})"
WITH_MEMBERS = f"WITH members AS ({MEMBERSHIPS_SQL})"


def query(name: str, sql: str | None = None, doubles: str = "", keep: str = "", **other: int):
    return registered(name, None if sql is None else twin(sql, keep.split(), doubles.split(), 6, **other))


@query("scores_scan", f"""{WITH_SCORES} SELECT fset AS dir, kernel_size, count(*) AS n, sum(accuracy) AS total FROM scores
 GROUP BY fset, kernel_size""", "total", "dir kernel_size n")
def scores_scan(spark, sf_dir):
    """Write the scores as CSV below one directory per feature set and scan them back with the directory's name."""
    place = new_location(spark, "scores")
    rows = scores(spark, sf_dir)
    write_csv(rows.withColumn("dir", F.col("fset")), place, ["dir"])
    back = read_recursive_csv(spark, place, SCORES).withColumn("dir", F.regexp_replace("dir", "^dir=", ""))
    return rounded(back.groupBy("dir", "kernel_size").agg(F.count(F.lit(1)).alias("n"), F.sum("accuracy").alias("total")))


@query("attr_scan", f"""{WITH_ATTR} SELECT run, count(*) AS n, sum(phi) AS total FROM attr GROUP BY run""",
       "total", "run n")
def attr_scan(spark, sf_dir):
    """Store attributions as one dataset partitioned by run; scanning it is the union of all runs."""
    place = new_location(spark, "attributions")
    rows = attributions(spark, sf_dir)
    write_runs(rows, place, "run")
    back = spark.read.schema(rows.schema).parquet(place)
    return rounded(back.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("phi").alias("total")))


@query("score_summary", f"""{WITH_SCORES} SELECT kernel_size, fset, avg(accuracy) AS mean, stddev_samp(accuracy) AS std,
 stddev_pop(accuracy) AS std_pop, count(*) AS n, stddev_samp(accuracy) / sqrt(count(*)) AS sem FROM scores GROUP BY kernel_size, fset""",
       "mean std std_pop sem", "kernel_size fset n")
def score_summary(spark, sf_dir):
    return rounded(R.score_summary(scores(spark, sf_dir), ["kernel_size", "fset"]))


@query("score_curve", f"""{WITH_SCORES} SELECT epochs, avg(s) AS mean, count(*) AS repeats FROM (SELECT epochs, repeat_no,
 avg(accuracy) AS s FROM scores WHERE epochs <= 16 GROUP BY epochs, repeat_no) q GROUP BY epochs""", "mean", "epochs repeats")
def score_curve(spark, sf_dir):
    return rounded(R.score_curve(scores(spark, sf_dir), upto=16))


_EPOCHS = list(range(2, 22, 2))


@query("grid_pivot", f"""{WITH_SCORES} SELECT fset, {", ".join(
    f"avg(accuracy) FILTER (epochs = {e}) AS epochs_{e}" for e in _EPOCHS)} FROM scores GROUP BY fset""",
       " ".join(f"epochs_{e}" for e in _EPOCHS), "fset")
def grid_pivot(spark, sf_dir):
    return rounded(R.score_grid(scores(spark, sf_dir), "fset", "epochs", _EPOCHS))


@query("grid_best", f"""{WITH_SCORES} SELECT fset, epochs, avg(accuracy) AS mean FROM scores GROUP BY fset, epochs
 ORDER BY round(avg(accuracy), 12) DESC, fset, epochs LIMIT 1""", "mean", "fset epochs")
def grid_best(spark, sf_dir):
    return rounded(R.best_cell(scores(spark, sf_dir), ["fset", "epochs"]))


@query("curves_wide", f"""{WITH_SCORES} SELECT epochs, {", ".join(
    f"avg(accuracy) FILTER (fset = 'f{i}') AS mean_f{i}, stddev_samp(accuracy) FILTER (fset = 'f{i}') AS std_f{i}" for i in range(3))}
 FROM scores WHERE kernel_size = 20 GROUP BY epochs""", "mean_f0 std_f0 mean_f1 std_f1 mean_f2 std_f2", "epochs")
def curves_wide(spark, sf_dir):
    return rounded(R.curves_wide(scores(spark, sf_dir).where(F.col("kernel_size") == 20), ["f0", "f1", "f2"]))


@query("epoch_alignment", f"""{WITH_SCORES} SELECT epochs, count(DISTINCT fset) AS sets, CASE WHEN count(DISTINCT fset) =
 (SELECT count(DISTINCT fset) FROM scores) THEN 1 ELSE 0 END AS aligned FROM scores GROUP BY epochs""", "", "epochs sets aligned")
def epoch_alignment(spark, sf_dir):
    return R.alignment(scores(spark, sf_dir))


@query("target_run", f"""{WITH_SCORES} SELECT * FROM scores WHERE abs(0.98 - accuracy) < 0.0225
 ORDER BY repeat_no, fold, kernel_size, fset, epochs, accuracy LIMIT 1""", "accuracy", "repeat_no fold kernel_size fset epochs")
def target_run(spark, sf_dir):
    return rounded(R.target_run(scores(spark, sf_dir), within=0.0225))


@query("repeated_scores", f"""{WITH_SCORES} SELECT fset, repeat_no, avg(accuracy) AS accuracy, 'baseline' AS classifier, 1 AS job_id FROM scores
 GROUP BY fset, repeat_no UNION ALL SELECT fset, repeat_no, avg(accuracy), 'k' || CAST(kernel_size AS VARCHAR), 2 FROM scores
 GROUP BY fset, repeat_no, kernel_size""", "accuracy", "fset repeat_no classifier job_id")
def repeated_scores(spark, sf_dir):
    """Scores of several classifiers, tagged with their configuration and stacked."""
    rows = scores(spark, sf_dir)
    whole = rows.groupBy("fset", "repeat_no").agg(F.avg("accuracy").alias("accuracy"))
    split = rows.groupBy("fset", "repeat_no", "kernel_size").agg(F.avg("accuracy").alias("accuracy"))
    tagged = labelled(split, classifier=F.concat(F.lit("k"), F.col("kernel_size").cast("string")), job_id=2)
    return rounded(union_all([labelled(whole, classifier="baseline", job_id=1), tagged.drop("kernel_size")]))


_PRED_SQL = f"""(SELECT DISTINCT run, sample, truth, pred FROM ({ATTRIBUTIONS_SQL}) a)"""


@query("fold_metrics", f"""SELECT run, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
 coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT run,
 CAST(count(*) FILTER (truth = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (truth = 0 AND pred = 1) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (truth = 1 AND pred = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (truth = 0 AND pred = 0) AS DOUBLE) AS tn
 FROM {_PRED_SQL} p GROUP BY run) c""", "accuracy precision recall f1", "run")
def fold_metrics(spark, sf_dir):
    predictions = attributions(spark, sf_dir).select("run", "sample", "truth", "pred").distinct()
    return rounded(R.fold_metrics(predictions, ["run"]))


@query("runs_hi_lo", f"""WITH runs AS (SELECT run, count(*) AS n, max(accuracy) AS accuracy FROM ({MEMBERSHIPS_SQL}) m GROUP BY run),
 lim AS (SELECT quantile_cont(accuracy, 0.2) AS l2, quantile_cont(accuracy, 0.8) AS h2, quantile_cont(accuracy, 0.25) AS l25,
 quantile_cont(accuracy, 0.75) AS h25 FROM runs) SELECT run, accuracy, 'inclusive' AS kind, CAST(accuracy >= h2 AS INT) AS is_high,
 CAST(accuracy <= l2 AS INT) AS is_low FROM runs, lim UNION ALL SELECT run, accuracy, 'strict', CAST(accuracy > h25 AS INT),
 CAST(accuracy < l25 AS INT) FROM runs, lim""", "accuracy", "run kind is_high is_low")
def runs_hi_lo(spark, sf_dir):
    runs = memberships(spark, sf_dir).groupBy("run").agg(F.max("accuracy").alias("accuracy"))
    inclusive = labelled(R.run_groups(runs, 0.2, 0.8, strict=False), kind="inclusive")
    strict = labelled(R.run_groups(runs, 0.25, 0.75, strict=True), kind="strict")
    return rounded(inclusive.unionByName(strict))


@query("membership_counts", f"""{WITH_MEMBERS}, lim AS (SELECT quantile_cont(accuracy, 0.25) AS lo, quantile_cont(accuracy, 0.75) AS hi
 FROM (SELECT DISTINCT run, accuracy FROM members) r), c AS (SELECT sample, count(*) AS in_all, CAST(sum(CASE WHEN accuracy > hi THEN 1
 ELSE 0 END) AS BIGINT) AS in_high, CAST(sum(CASE WHEN accuracy < lo THEN 1 ELSE 0 END) AS BIGINT) AS in_low FROM members, lim GROUP BY sample),
 j AS (SELECT least(min(in_high), min(in_low)) AS mn, greatest(max(in_high), max(in_low)) AS mx FROM c)
 SELECT sample, in_all, in_high, in_low, in_high - in_low AS difference, (in_high - mn) / mx AS high_scaled,
 (in_low - mn) / mx AS low_scaled FROM c, j""", "high_scaled low_scaled", "sample in_all in_high in_low difference")
def membership_counts(spark, sf_dir):
    return rounded(R.membership_counts(memberships(spark, sf_dir)))


@query("attr_time_sum", f"{WITH_ATTR} SELECT sample, feature, sum(phi) AS phi, avg(phi * 2 + 1) AS value FROM attr GROUP BY sample, feature",
       "phi value", "sample feature")
def attr_time_sum(spark, sf_dir):
    rows = attributions(spark, sf_dir).withColumn("value", F.col("phi") * 2 + 1)
    return rounded(AT.over_time(rows, ["sample"]))


@query("attr_sample_sum", f"{WITH_ATTR} SELECT sample, sum(phi) AS phi FROM attr GROUP BY sample", "phi", "sample")
def attr_sample_sum(spark, sf_dir):
    return rounded(AT.per_sample(attributions(spark, sf_dir), ["sample"]))


@query("attr_trim", f"""{WITH_ATTR} SELECT sample, feature, CASE WHEN abs(s) > 0.5 THEN 0 ELSE s END AS phi FROM
 (SELECT sample, feature, sum(phi) AS s FROM attr GROUP BY sample, feature) q""", "phi", "sample feature")
def attr_trim(spark, sf_dir):
    sums = attributions(spark, sf_dir).groupBy("sample", "feature").agg(F.sum("phi").alias("phi"))
    return rounded(S.zero_beyond(sums, "phi", 0.5))


@query("attr_extreme", f"""{WITH_ATTR}, s AS (SELECT sample, truth, pred, sum(phi) AS phi FROM attr GROUP BY sample, truth, pred)
 SELECT * FROM (SELECT 0 AS label, sample, phi FROM s WHERE truth = 0 AND pred = 0 ORDER BY phi DESC, sample LIMIT 1) a
 UNION ALL SELECT * FROM (SELECT 1 AS label, sample, phi FROM s WHERE truth = 1 AND pred = 1 ORDER BY phi, sample LIMIT 1) b""",
       "phi", "label sample")
def attr_extreme(spark, sf_dir):
    return rounded(AT.extreme_samples(attributions(spark, sf_dir)))


@query("attr_average", f"""{WITH_ATTR} SELECT sample % 100 AS track, {", ".join(
    f"avg(phi) FILTER (feature = {f}) AS shap_{f}, avg(phi * 2 + 1) FILTER (feature = {f}) AS value_{f}" for f in range(4))}
 FROM attr GROUP BY sample % 100""", " ".join(f"shap_{f} value_{f}" for f in range(4)), "track")
def attr_average(spark, sf_dir):
    rows = attributions(spark, sf_dir).select(
        (F.col("sample") % 100).alias("track"), "repeat_no", "feature", "phi", (F.col("phi") * 2 + 1).alias("value")
    )
    return rounded(AT.averaged(rows, ["track"], [0, 1, 2, 3]))


@query("attr_importance", f"""{WITH_ATTR} SELECT feature, avg(abs(phi)) AS mean_abs, avg(phi) AS mean, count(*) AS n FROM attr
 GROUP BY feature""", "mean_abs mean", "feature n")
def attr_importance(spark, sf_dir):
    return rounded(AT.importance(attributions(spark, sf_dir)))


@query("attr_dependence", f"{WITH_ATTR} SELECT sample, step, phi * 2 + 1 AS value, phi FROM attr WHERE feature = 2", "value phi", "sample step")
def attr_dependence(spark, sf_dir):
    rows = attributions(spark, sf_dir).withColumn("value", F.col("phi") * 2 + 1)
    return rounded(AT.dependence(rows, 2).select("sample", "step", "value", "phi"))
