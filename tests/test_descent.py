"""The mini-batch logistic fit against Spark ML's optimum and plain arithmetic."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tracefold.operators import descent, tabular


@pytest.fixture(scope="module")
def rows(spark):
    noise = np.random.default_rng(5)
    a, b = noise.normal(3, 2, 4000), noise.normal(0, 50, 4000)
    y = (noise.random(4000) < 1 / (1 + np.exp(-(0.8 * a - 0.03 * b - 3)))).astype(int)
    made = [(int(t), float(p), float(q), "7", 1.0, "x") for t, p, q in zip(y, a, b, strict=True)]
    df = spark.createDataFrame(made, "y int, a double, `b.c` double, same string, w double, batch string").repartition(4).persist()
    yield df
    df.unpersist()


COLUMNS = ["a", "b.c", "same"]


def plain_loss(rows, model, l2):
    got = np.array([(r.y, r.a, r["b.c"], 7.0) for r in rows.collect()])
    x = (got[:, 1:] - model.mean) / model.scale
    m = x @ model.coefficients + model.intercept
    return float(np.mean(np.logaddexp(0, m) - got[:, 0] * m) + l2 / 2 * np.dot(model.coefficients, model.coefficients))


def test_reaches_the_optimum_and_stops(spark, rows):
    model = descent.fit(rows, rows, COLUMNS, "y", balanced=False, l2=1e-3, batches=2)
    assert 0 < model.best_pass <= len(model.losses) - 1 < 50  # it ended before its last pass
    assert model.losses[-1]["rate"] < model.losses[0]["rate"]
    ours = plain_loss(rows, model, 1e-3)
    assert abs(ours - descent.loss(model, rows, "y", 1e-3)) < 1e-9
    assert abs(ours - min(x["val_loss"] for x in model.losses)) < 1e-9
    named = rows.withColumnRenamed("b.c", "b").withColumn("same", F.lit(7.0))
    ml = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=100).fit(tabular.matrix(named, ["a", "b", "same"]))
    optimum = plain_loss(rows, descent.LogisticModel(COLUMNS, model.mean, model.scale, (ml.coefficients.toArray() * model.scale).tolist(), ml.intercept + float(np.dot(ml.coefficients.toArray(), model.mean))), 1e-3)
    assert abs(ours - optimum) < 1e-3
    assert model.coefficients[2] == 0 and model.importance(1)[0][0] == "a"  # 0.8 x 2 against 0.03 x 50
    scored = model.score(rows).selectExpr("y_score", "a", "`b.c` AS b").collect()
    for r in scored[:50]:
        m = float(np.dot((np.array([r.a, r.b, 7.0]) - model.mean) / model.scale, model.coefficients)) + model.intercept
        assert abs(r.y_score - 1 / (1 + np.exp(-m))) < 1e-9


def test_warm_start_and_saved_model(spark, rows, tmp_path):
    model = descent.fit(rows, rows, COLUMNS, "y", batches=2, most_passes=12)
    model.save(spark, str(tmp_path / "model"))
    again = descent.LogisticModel.load(spark, str(tmp_path / "model"))
    assert again == model
    other = rows.withColumn("a", F.col("a") * 10 + 3)  # another standardisation of the same column
    shifted = again.in_units_of(COLUMNS, np.array(model.mean), np.array(model.scale))
    assert np.allclose(shifted, np.append(model.coefficients, model.intercept))
    warm = descent.fit(rows, rows, COLUMNS, "y", batches=2, most_passes=1, start=again)
    assert abs(warm.losses[0]["val_loss"] - min(x["val_loss"] for x in model.losses)) < 1e-9
    assert min(x["val_loss"] for x in warm.losses) <= warm.losses[0]["val_loss"]
    assert descent.fit(other, other, ["a"], "y", batches=1, most_passes=2).coefficients[0] > 0


def test_edges(spark, rows):
    empty = rows.limit(0)
    with pytest.raises(ValueError, match="no rows to fit"):
        descent.fit(empty, rows, COLUMNS, "y")
    with pytest.raises(ValueError, match="no rows to validate"):
        descent.fit(rows, empty, COLUMNS, "y", batches=1)
    with pytest.raises(ValueError, match="0 and 1"):
        descent.fit(rows.withColumn("y", F.lit(2)), rows, COLUMNS, "y")
    with pytest.raises(ValueError, match="batches"):
        descent.fit(rows, rows, COLUMNS, "y", batches=0)
    odd = spark.createDataFrame([(1, None, "x"), (1, float("nan"), None), (1, float("inf"), "2")], "y int, a double, b string")
    model = descent.fit(odd, odd, ["a", "b"], "y", batches=3, most_passes=3)
    assert all(0.5 <= r.y_score <= 1 for r in model.score(odd).collect())
