"""Classification reports as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.quantiles import quantiles

THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def _rates(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    return {
        "accuracy": (tp + tn) / F.greatest(tp + tn + fp + fn, F.lit(1)),
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8)),
    }


def _counts(label: Column, predicted: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 1) & predicted),
        "tn": F.count_if((label == 0) & ~predicted),
        "fp": F.count_if((label == 0) & predicted),
        "fn": F.count_if((label == 1) & ~predicted),
    }


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, logarithmic loss and Brier score. Scores are clipped to [1e-8, 1 - 1e-8] first."""
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(score), F.lit(1e-8)), F.lit(1 - 1e-8))
    counts = _counts(F.col(label), p >= threshold)
    agg = df.groupBy(*by).agg(*(c.alias(k) for k, c in counts.items()), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))
    return agg.withColumns(_rates(*(F.col(k) for k in counts)))


def sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The rates at each threshold, from one pass: a row goes to its score's step, and steps are summed from the top."""
    edges = sorted(thresholds)
    p = F.least(F.greatest(F.col(score), F.lit(1e-8)), F.lit(1 - 1e-8))
    step = F.lit(0)
    for e in edges:
        step = step + (p >= e).cast("int")
    per = df.groupBy(step.alias("step")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    steps = df.sparkSession.createDataFrame([(i, e) for i, e in enumerate([0.0, *edges])], "step int, threshold double")
    full = F.broadcast(steps).join(per, "step", "left").fillna(0, ["pos", "neg"])
    above, all_rows = Window.orderBy(F.desc("step")), Window.partitionBy()  # a row per threshold
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    out = full.withColumns({"tp": tp, "fp": fp, "fn": F.sum("pos").over(all_rows) - tp, "tn": F.sum("neg").over(all_rows) - fp}).where("step > 0")
    return out.withColumns(_rates(*(F.col(k) for k in ("tp", "tn", "fp", "fn")))).drop("step", "pos", "neg")


def best_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold of the best metric; ties to the one closest to 0.5, then the smaller."""
    return swept.orderBy(F.desc(metric), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def by_type(df: DataFrame, truth: str, predicted_flag: str, predicted_type: str, benign: str = "Benign") -> DataFrame:
    """For each true type: rows, flagged rows, recall (null for the benign type) and the commonest predicted type, ties to the smaller."""
    per = df.groupBy(truth, predicted_type).agg(F.count(F.lit(1)).alias("c"), F.sum(predicted_flag).alias("f"))
    return per.groupBy(truth).agg(
        F.sum("c").alias("rows"),
        F.sum("f").alias("flagged"),
        F.when(F.col(truth) != benign, F.sum("f") / F.sum("c")).alias("recall"),
        F.min(F.struct((-F.col("c")).alias("c"), predicted_type)).getField(predicted_type).alias("commonest"),
    )


def missed_types(report: DataFrame, truth: str, least_recall: float = 0.5) -> DataFrame:
    return report.where(F.col("recall") < least_recall).select(truth, "rows", "recall")


def risk_summary(df: DataFrame, score: str, alert: Column) -> DataFrame:
    """One row: mean, median, p90 and p95 of the scores, and the share of alerts. Nulls without rows."""
    p = quantiles(df, [score], (0.5, 0.9, 0.95))[score]
    names = dict(zip(("median", "p90", "p95"), p, strict=True))
    return df.agg(F.avg(score).alias("mean"), *(F.lit(v).cast("double").alias(k) for k, v in names.items()), F.avg(alert.cast("double")).alias("alert_rate"))


def alert_threshold(df: DataFrame, score: str, rate: float) -> DataFrame:
    """The score that the given share of rows lies above; 1 without rows."""
    found = quantiles(df, [score], [1 - rate])[score][0]
    return df.sparkSession.createDataFrame([(1.0 if found is None else float(found),)], "threshold double")


def alert_precision(df: DataFrame, label: str, alert: Column) -> DataFrame:
    """One row: the share of positive labels among alerts; null without alerts."""
    return df.agg(F.avg(F.when(alert, F.col(label).cast("double"))).alias("alert_precision"), F.count_if(alert).alias("alerts"))


def _attacks(df: DataFrame, truth: str, predicted_type: str, flag: str, benign: str) -> DataFrame:
    kind = F.coalesce(F.col(truth), F.lit(benign))
    right = F.coalesce(F.col(predicted_type) == kind, F.lit(False))
    return df.where(kind != benign).select(kind.alias("attack_type"), right.alias("right"), (right & F.coalesce(F.col(flag) == 1, F.lit(False))).alias("strict"))


def attack_type_accuracy(df: DataFrame, truth: str, predicted_type: str, flag: str = "y_pred", benign: str = "Benign") -> DataFrame:
    """One row over the rows of attacks: their number, the share with the right type, and of those that are flagged too; nulls without attacks."""
    share = lambda c, n: F.avg(F.col(c).cast("double")).alias(n)
    return _attacks(df, truth, predicted_type, flag, benign).agg(F.count(F.lit(1)).alias("attack_rows"), share("right", "attack_type_accuracy"), share("strict", "strict_attack_accuracy"))


def attack_types(df: DataFrame, truth: str, predicted_type: str, flag: str = "y_pred", benign: str = "Benign") -> DataFrame:
    """The same for each type of attack."""
    return _attacks(df, truth, predicted_type, flag, benign).groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("right").alias("type_correct"), F.avg(F.col("right").cast("double")).alias("type_accuracy"), F.count_if("strict").alias("strict_correct")
    )


def reference_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> dict[str, float]:
    """Rates against a column that may not be there; none unless it is there and holds 0 and 1 only."""
    if label not in df.columns:
        return {}
    value = F.col(label).try_cast("double")
    known = df.where(F.col(label).isNotNull())
    odd = known.where(~F.coalesce(value.isin(0.0, 1.0), F.lit(False))).limit(1)
    if not odd.isEmpty() or known.isEmpty():
        return {}
    return confusion(known.withColumn(label, value.cast("int")), label, score, threshold).collect()[0].asDict()


def class_weights(df: DataFrame, label: str) -> DataFrame:
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (2.0 * F.col("n")))  # a row per class
