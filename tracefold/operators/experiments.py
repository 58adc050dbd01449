"""Train and evaluate loops: a model, a threshold chosen on the validation split and kept beside it, predictions and reports of a split."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators import api, findings, metrics, tabular
from tracefold.operators.retrieval import RetrievalModel
from tracefold.sources import sinks

# Thresholds tried for retrieval scores, which lie near 0 for most requests.
RETRIEVAL_THRESHOLDS = (*(round(0.005 * i, 3) for i in range(1, 11)), *(round(0.05 * i, 2) for i in range(2, 11)))
METADATA = ("event_id", "dataset_id", "source_file", "record_index", "event_timestamp", "endpoint_key", "method", "host", "path", "path_template", "query_key_set", "status_code")


def save_threshold(spark: SparkSession, threshold: float, path: str) -> None:
    sinks.report(spark, {"selected_threshold": threshold}, path)


def load_threshold(spark: SparkSession, path: str, default: float) -> float:
    """The threshold kept under a path; the default if there is none."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return default
    content = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    return float(content.get("selected_threshold", default))


def prediction_frame(model: RetrievalModel, df: DataFrame) -> DataFrame:
    """Metadata, scores, type, finding, explanation and, where there is a label, the truth of each row."""
    done = findings.with_explanation(findings.with_finding(model.predict(df)))
    truth = [F.col(a).alias(b) for a, b in (("label_binary", "y_true"), ("attack_type", "attack_type_true")) if a in df.columns]
    made = ["y_score", "nearest_benign_similarity", "y_pred", "predicted_attack_type", "attack_similarity", "security_finding", "explanation"]
    return done.select("id", *(F.col(c) for c in METADATA if c in df.columns), *made, *truth)


def evaluate(spark: SparkSession, model: RetrievalModel, df: DataFrame, name: str, path: str, hints: bool = True) -> dict:
    """Writes the predictions of a split and gives its report; without labels that of the findings only. hints=False: without signals."""
    sinks.predictions(prediction_frame(model, df if hints else api.bag(api.without_hints(df))), f"{path}/predictions", name)
    rows = spark.read.parquet(f"{path}/predictions/{name}.parquet")
    out = {"split": name, "num_rows": rows.count(), "finding_counts": {r["security_finding"]: r["rows"] for r in findings.finding_counts(rows).collect()}}
    if "y_true" not in rows.columns or not rows.where("y_true is null").limit(1).isEmpty() or not out["num_rows"]:
        return out | {"labeled": False}
    out |= metrics.confusion(rows, "y_true", "y_score", model.threshold).collect()[0].asDict()
    types = metrics.by_type(rows, "attack_type_true", "y_pred", "predicted_attack_type")
    out["attack_type_report"] = {r["attack_type_true"]: r.asDict() for r in types.collect()}  # a row per type
    out["attack_type_metrics"] = metrics.attack_type_accuracy(rows, "attack_type_true", "predicted_attack_type").collect()[0].asDict()
    out["by_attack_type"] = {r["attack_type"]: r.asDict() for r in metrics.attack_types(rows, "attack_type_true", "predicted_attack_type").collect()}
    out["warnings"] = [r["attack_type_true"] for r in metrics.missed_types(types, "attack_type_true").collect()]
    sinks.report(spark, out, f"{path}/reports/{name}_metrics")
    return out


def train(spark: SparkSession, train_rows: DataFrame, val: DataFrame, path: str, dimension: int = 2048, most: int = 80_000) -> tuple[RetrievalModel, dict]:
    """A retrieval model fitted on train, its threshold of the best F1 on val, both kept under a path, and the reports of both splits."""
    model = RetrievalModel.fit(train_rows, dimension, most)
    best = metrics.best_threshold(metrics.sweep(model.predict(val), "label_binary", "y_score", RETRIEVAL_THRESHOLDS)).collect()[0].asDict()
    model.threshold = float(best["threshold"])
    model.save(f"{path}/model")
    save_threshold(spark, model.threshold, f"{path}/threshold")
    sinks.report(spark, best, f"{path}/reports/threshold_search")
    return model, {name: evaluate(spark, model, df, name, path) for name, df in (("train", train_rows), ("val", val))}


def fit_and_score(train_rows: DataFrame, val: DataFrame, columns: list[str], label: str, metric: str = "f1") -> dict:
    """A logistic model on one set of features: its threshold, best on val, and the rates of both splits at it."""
    model = tabular.fit(train_rows, columns, label)
    scored = {name: tabular.score(model, df, columns) for name, df in (("train", train_rows), ("val", val))}
    best = metrics.best_threshold(metrics.sweep(scored["val"], label, "y_score"), metric).collect()[0]["threshold"]
    return {"threshold": best} | {name: metrics.confusion(df, label, "y_score", best).collect()[0].asDict() for name, df in scored.items()}
