"""Block risk of logins: robust profiles by block, fused scores, a threshold from a target rate, reports and their diagnosis."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.operators.metrics import alert_precision, alert_threshold, reference_metrics, risk_summary
from tracefold.operators.profiling import robust_profile


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: N.finite(N.number(F.col(c).cast("string"))) for c in columns})


@dataclass(frozen=True)
class BlockRiskModel:
    """Of each block its columns with median and scale; rows are scored by expressions, so it holds a few numbers only."""

    blocks: dict[str, dict[str, tuple[float, float]]]
    threshold: float = 1.0
    clip: float = 5.0

    @classmethod
    def fit(cls, train: DataFrame, blocks: dict[str, Sequence[str]], clip: float = 5.0, least_scale: float = 1e-6, threshold: float = 1.0) -> BlockRiskModel:
        columns = list(dict.fromkeys(c for b in blocks.values() for c in b))
        profile = robust_profile(_clean(train, columns), columns, least_scale)
        return cls({name: {c: profile[c] for c in columns} for name, columns in blocks.items()}, threshold, clip)

    def block_score(self, name: str) -> Column:
        parts = [F.least(F.abs((N.finite(N.number(F.col(c).cast("string"))) - mid) / scale), F.lit(self.clip)) for c, (mid, scale) in self.blocks[name].items()]
        return 1 - F.exp(-(sum(parts[1:], parts[0]) / float(len(parts))))

    def score(self, df: DataFrame) -> DataFrame:
        """df with a <block>_score of each block and their mean, risk_score."""
        df = df.withColumns({f"{name}_score": self.block_score(name) for name in self.blocks})
        return df.withColumn("risk_score", N.clip(sum((F.col(f"{name}_score") / float(len(self.blocks)) for name in self.blocks), F.lit(0.0)), 0.0, 1.0))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("alert", N.flag(F.col("risk_score") >= self.threshold))

    def calibrated(self, calibration: DataFrame, rate: float) -> BlockRiskModel:
        """The model with the threshold that the given share of calibration rows lies above."""
        found = alert_threshold(self.score(calibration), "risk_score", min(1.0, max(0.0, rate))).collect()[0]["threshold"]
        return BlockRiskModel(self.blocks, found, self.clip)

    def save(self, spark: SparkSession, path: str) -> None:
        content = {"blocks": self.blocks, "threshold": self.threshold, "clip": self.clip}
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockRiskModel:
        content = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
        blocks = {name: {c: (mid, scale) for c, (mid, scale) in columns.items()} for name, columns in content["blocks"].items()}
        return cls(blocks, content["threshold"], content["clip"])


def report(model: BlockRiskModel, df: DataFrame, name: str, label: str | None = None) -> dict:
    """Rows, risk summary and, if there is a binary reference column, rates against it, of one split."""
    scored = model.predict(df)
    out = {"split": name, "rows": scored.count(), "selected_threshold": model.threshold, "feature_blocks": {k: len(v) for k, v in model.blocks.items()}}
    out["risk_summary"] = risk_summary(scored, "risk_score", F.col("alert") == 1).collect()[0].asDict()
    found = reference_metrics(scored, label, "risk_score", model.threshold) if label else {}
    if found:
        found["alert_precision"] = alert_precision(scored, label, F.col("alert") == 1).collect()[0]["alert_precision"] or 0.0
    return out | {"reference_metrics": found}


def train(train_rows: DataFrame, calibration: DataFrame, blocks: dict[str, Sequence[str]], rate: float, label: str | None = None, clip: float = 5.0) -> tuple[BlockRiskModel, dict]:
    """A model fitted on one split, its threshold from another, and the reports of both."""
    model = BlockRiskModel.fit(train_rows, blocks, clip).calibrated(calibration, rate)
    return model, {"train": report(model, train_rows, "train", label), "val": report(model, calibration, "val", label), "alert_rate_target": rate}


def diagnose(rows: dict[str, int], val: dict, test: dict, target_rate: float | None, train: dict | None = None, mode: str = "unsupervised_block_risk") -> dict:
    """Findings and advice from the reports of a training run, and whether data or training comes first."""
    # The texts of findings and advice below, and the limits 100, 0.05 and 0.15 with their weights.
    found: list[tuple[str, str, str, int]] = []
    if mode != "unsupervised_block_risk":
        found.append((f"Target mode is `{mode}`, not the preferred unsupervised risk setup.", "Align training with block-risk scoring rather than current-outcome prediction.", "training", 2))
    if min(rows.get("val", 0), rows.get("test", 0)) < 100:
        found.append((f"Validation/test are still small for stable assessment (val={rows.get('val', 0)}, test={rows.get('test', 0)}).", "Process more data before treating metrics as stable.", "process_more_data", 2))
    rate, known = (val.get("risk_summary") or {}).get("alert_rate"), ((train or val).get("risk_summary") or {}).get("alert_rate")
    if None not in (rate, known, target_rate) and abs(rate - target_rate) > 0.05:
        found.append((f"Validation alert rate ({rate:.3f}) drifts away from the target alert budget ({target_rate:.3f}).", "Recalibrate thresholding or revisit block-score fusion.", "training", 1))
    a, b = val.get("reference_metrics") or {}, test.get("reference_metrics") or {}
    if a and b and abs(a.get("f1", 0.0) - b.get("f1", 0.0)) > 0.15:
        found.append((f"Reference-only F1 moves noticeably between val and test ({a.get('f1', 0.0):.3f} -> {b.get('f1', 0.0):.3f}).", "Inspect score stability across time slices and refine calibration.", "training", 1))
    priority = {k: sum(n for _, _, focus, n in found if focus == k) for k in ("training", "process_more_data")}
    texts = found or [("No major structural issue detected from the available reports.", "Next step: run slice analysis on high-novelty and failure-heavy events.", "", 0)]
    return {
        "row_counts": rows, "findings": [x[0] for x in texts], "recommendations": [x[1] for x in texts], "primary_focus": "training" if priority["training"] >= priority["process_more_data"] else "process_more_data",
        "process_priority": priority["process_more_data"], "training_priority": priority["training"],
    }
