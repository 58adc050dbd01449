"""Logistic models on feature blocks: matrices, class weights, ablation by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tracefold.functions.numbers import finite, number
from tracefold.operators.metrics import best_threshold, class_weights, sweep


def resolve(df: DataFrame, blocks: dict[str, Sequence[str]] | None = None, use: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), metadata: Sequence[str] = ()) -> list[str]:
    """Numeric feature columns: those of the blocks and `include`, else all that are no metadata; in order, once each."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    named = [c for b in use for c in (blocks or {}).get(b, ())] + list(include)
    named = named or [c for c in df.columns if c not in metadata]
    return [c for c in dict.fromkeys(named) if c in numeric and c not in exclude]


def matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    clean = df.withColumns({c: finite(number(F.col(c))) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(clean)


def require_binary(df: DataFrame, label: str) -> None:
    """Raises unless every label is 0 or 1."""
    value = F.col(label).try_cast("double")
    if not df.where(~F.coalesce(value.isin(0.0, 1.0), F.lit(False))).limit(1).isEmpty():
        raise ValueError(f"{label} must hold 0 and 1 only")


def fit(df: DataFrame, columns: Sequence[str], label: str, balanced: bool = True, l2: float = 1e-4) -> LogisticRegressionModel:
    """A logistic model of the columns; balanced: both classes weigh the same."""
    require_binary(df, label)
    rows, weight = matrix(df, columns), None
    if balanced:
        weight = "weight"
        while weight in df.columns:
            weight += "_"
        weights = class_weights(df, label).select(label, F.col("weight").alias(weight))
        rows = rows.join(F.broadcast(weights), label)  # a row per class
    model = LogisticRegression(labelCol=label, regParam=l2, maxIter=50)
    return (model.setWeightCol(weight) if weight else model).fit(rows)


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def score(model, df: DataFrame, columns: Sequence[str], name: str = "y_score") -> DataFrame:
    return model.transform(matrix(df, columns)).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model, columns: Sequence[str], k: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))[:k]


def ablation(train: DataFrame, val: DataFrame, blocks: dict[str, Sequence[str]], label: str, metric: str = "f1") -> list[dict]:
    """A model per block, and of all, with its best threshold on val; best first."""
    out = []
    for name, columns in (blocks | {"all": [c for b in blocks.values() for c in b]}).items():
        model = fit(train, columns, label)
        best = best_threshold(sweep(score(model, val, columns), label, "y_score"), metric).collect()[0]
        out.append({"block": name, "threshold": best["threshold"], metric: best[metric]})
    return sorted(out, key=lambda x: -x[metric])
