"""Logistic models fitted by mini-batch steps that stop by themselves.

The rows are standardised and written once as vectors, in a folder for each of `batches` random batches, so that a step reads
its batch only. A step is one job: every task sums the gradient of its rows in Arrow batches, the sums are added up by
coordinate, and a row per coordinate reaches the driver, which makes an Adam step. After each pass the loss of the validation
split decides: no better by `least_gain` halves the rate, `patience` such passes in a row end the fit, and the best parameters are kept.
A fit can start from an earlier model; its parameters are turned into the new rows' standardisation.

The loss is the weighted mean of the log loss plus l2 / 2 times the squared standardised coefficients, as Spark ML's. Null,
infinite and non-numeric features count as 0; a label other than 0 and 1 and a split without rows are refused. Columns that
do not vary get the coefficient 0 at a cold start. Repeated rows count as often as they stand; one class alone is fitted too.
Other columns, whatever their names, play no part. Which rows share a batch is drawn with `seed` as the rows are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.numbers import finite, number
from tracefold.names import fresh
from tracefold.operators.metrics import class_weights
from tracefold.operators.tabular import require_binary
from tracefold.sources import readers, sinks
from tracefold.storage import dropped, written

MOST_BATCHES = 1024  # folders of the written rows
MOST_SCORED = 4096  # rows whose vectors a task multiplies at once
BETAS, TINY = (0.9, 0.999), 1e-8
PASSES_SQL = "at int, value double"


@dataclass
class LogisticModel:
    """Coefficients of standardised columns, the intercept, and the losses of each pass of the fit."""

    columns: list[str]
    mean: list[float]
    scale: list[float]
    coefficients: list[float]
    intercept: float
    losses: list[dict] = field(default_factory=list)
    best_pass: int = 0

    def score(self, df: DataFrame, name: str = "y_score") -> DataFrame:
        """The table with the probability of 1, as one expression; a column of that name is replaced."""
        margin = F.lit(float(self.intercept))
        for c, m, s, w in zip(self.columns, self.mean, self.scale, self.coefficients, strict=True):
            margin = margin + (finite(number(F.col(f"`{c}`"))) - m) * (w / s)
        return df.withColumn(name, 1 / (1 + F.exp(-margin)))

    def importance(self, k: int = 20) -> list[tuple[str, float]]:
        return sorted(zip(self.columns, self.coefficients, strict=True), key=lambda x: -abs(x[1]))[:k]

    def save(self, spark: SparkSession, path: str) -> None:
        sinks.report(spark, self.__dict__, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticModel:
        return cls(**readers.manifest(spark, path))

    def in_units_of(self, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Its parameters, intercept last, for other columns and another standardisation; columns it does not know get 0."""
        raw = {c: w / s for c, w, s in zip(self.columns, self.coefficients, self.scale, strict=True)}
        free = self.intercept - sum(raw[c] * m for c, m in zip(self.columns, self.mean, strict=True))
        w = np.array([raw.get(c, 0.0) for c in columns])
        return np.append(w * scale, free + float(w @ mean))


def _sums(parameters: list[float], gradient: bool):
    """Of each task's rows: the summed gradient by coordinate, then the summed loss and the summed weight."""
    theta = np.array(parameters)
    width = len(theta) - 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight = np.zeros(width + 1), 0.0, 0.0
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            for i in range(0, batch.num_rows, MOST_SCORED):
                x, yy, ww = flat[i : i + MOST_SCORED], y[i : i + MOST_SCORED], w[i : i + MOST_SCORED]
                margin = x @ theta[:-1] + theta[-1]
                loss += float((ww * (np.logaddexp(0.0, margin) - yy * margin)).sum())
                weight += float(ww.sum())
                if gradient:
                    off = ww * (np.exp(-np.logaddexp(0.0, -margin)) - yy)
                    total += np.append(off @ x, off.sum())
        value = np.append(total, (loss, weight)) if gradient else np.array((loss, weight))
        at = np.arange(len(value)) + (0 if gradient else width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(value)], names=["at", "value"])

    return summed


def _evaluated(rows: DataFrame, theta: np.ndarray, l2: float, gradient: bool) -> tuple[float, np.ndarray]:
    """Mean loss with the penalty and its gradient over the rows; a row per coordinate is collected."""
    sums = rows.mapInArrow(_sums(theta.tolist(), gradient), PASSES_SQL).groupBy("at").agg(F.sum("value").alias("value"))
    got = {r["at"]: r["value"] for r in sums.collect()}
    weight = got[len(theta) + 1] or 1.0
    slope = np.array([got.get(i, 0.0) for i in range(len(theta))]) / weight
    slope[:-1] += l2 * theta[:-1]
    return got[len(theta)] / weight + l2 / 2 * float(theta[:-1] @ theta[:-1]), slope


def _standards(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    value = [finite(number(F.col(f"`{c}`"))) for c in columns]
    row = df.agg(F.count(F.lit(1)), *(F.avg(x) for x in value), *(F.stddev_pop(x) for x in value)).collect()[0]
    d = len(columns)
    if not row[0]:
        raise ValueError("no rows to fit on")
    scale = np.array(row[1 + d :], dtype=float)
    return np.array(row[1 : 1 + d], dtype=float), np.where(scale > 0, scale, 1.0)


def _vectors(df: DataFrame, columns: Sequence[str], label: str, mean: np.ndarray, scale: np.ndarray, weights: dict[float, float]) -> DataFrame:
    x = [(finite(number(F.col(f"`{c}`"))) - float(m)) / float(s) for c, m, s in zip(columns, mean, scale, strict=True)]
    y = number(F.col(f"`{label}`"))
    w = F.lit(1.0)
    for value, weight in weights.items():
        w = F.when(y == value, F.lit(weight)).otherwise(w)
    return df.select(F.array(*x).alias("x"), y.alias("y"), w.alias("w"))


def fit(
    train: DataFrame,
    val: DataFrame,
    columns: Sequence[str],
    label: str,
    balanced: bool = True,
    l2: float = 1e-4,
    rate: float = 0.1,
    batches: int = 8,
    most_passes: int = 50,
    patience: int = 4,
    least_gain: float = 1e-5,
    start: LogisticModel | None = None,
    seed: int = 0,
) -> LogisticModel:
    """A model of the columns, fitted on train, stopped by the loss on val. batches: steps in a pass over train, at most 1024."""
    if not columns or not 1 <= batches <= MOST_BATCHES:
        raise ValueError(f"needs columns and between 1 and {MOST_BATCHES} batches")
    for df in (train, val):
        require_binary(df, f"`{label}`")
    mean, scale = _standards(train, columns)
    weights: dict[float, float] = {}
    if balanced:
        kind = fresh(train, "kind")
        classes = class_weights(train.select(number(F.col(f"`{label}`")).alias(kind)), kind)
        weights = {r[kind]: r["weight"] for r in classes.collect()}  # a row per class
    rows = _vectors(train, columns, label, mean, scale, weights)
    # rows of a batch are spread over up to 64 files by a second draw, so equal rows don't meet in one task
    drawn = rows.withColumn("batch", F.floor(F.rand(seed) * batches).cast("int")).withColumn("part", F.floor(F.rand(seed + 1) * 64).cast("int"))
    kept = written(drawn.repartition("batch", "part").drop("part"), "descent-train", by="batch")
    held = written(_vectors(val, columns, label, mean, scale, weights), "descent-val")
    try:
        if held.isEmpty():
            raise ValueError("no rows to validate on")
        theta = start.in_units_of(columns, mean, scale) if start else np.zeros(len(columns) + 1)
        first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
        best, best_theta, best_pass, stale = _evaluated(held, theta, l2, False)[0], theta.copy(), 0, 0
        losses = [{"pass": 0, "train_loss": None, "val_loss": best, "rate": rate}]
        filled = sorted(r["batch"] for r in kept.select("batch").distinct().collect())  # at most MOST_BATCHES rows
        for number_of_pass in range(1, most_passes + 1):
            seen = []
            for b in filled:
                loss, slope = _evaluated(kept.where(F.col("batch") == b).drop("batch"), theta, l2, True)
                seen.append(loss)
                step += 1
                first = BETAS[0] * first + (1 - BETAS[0]) * slope
                second = BETAS[1] * second + (1 - BETAS[1]) * slope**2
                theta = theta - rate * (first / (1 - BETAS[0] ** step)) / (np.sqrt(second / (1 - BETAS[1] ** step)) + TINY)
            val_loss = _evaluated(held, theta, l2, False)[0]
            losses.append({"pass": number_of_pass, "train_loss": float(np.mean(seen)), "val_loss": val_loss, "rate": rate})
            stale = 0 if val_loss < best - least_gain else stale + 1
            if val_loss < best:
                best, best_theta, best_pass = val_loss, theta.copy(), number_of_pass
            if stale:
                rate /= 2
            if stale >= patience:
                break
    finally:
        dropped(kept, held)
    return LogisticModel(list(columns), mean.tolist(), scale.tolist(), best_theta[:-1].tolist(), float(best_theta[-1]), losses, best_pass)


def loss(model: LogisticModel, df: DataFrame, label: str, l2: float = 1e-4, weights: dict[float, float] | None = None) -> float:
    """Mean loss of a model, with its penalty, over a table."""
    rows = _vectors(df, model.columns, label, np.array(model.mean), np.array(model.scale), weights or {})
    return _evaluated(rows, np.append(model.coefficients, model.intercept), l2, False)[0]
