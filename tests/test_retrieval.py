"""The broadcast index of references against brute force and against joins."""

import numpy as np
import pandas as pd
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tracefold.operators import reference_index, retrieval


def made(rng, n, dimension=64, topics=None):
    """n sparse unit rows; those of a topic share most buckets."""
    out = []
    for i in range(n):
        pool = np.arange(dimension) if topics is None else (np.arange(12) + 5 * (i % topics)) % dimension
        b = rng.choice(pool, size=min(len(pool), rng.integers(3, 10)), replace=False)
        out.append(reference_index.unit(b, rng.integers(1, 9, size=len(b)).astype(float), dimension))
    return out


@pytest.mark.parametrize("topics", [None, 8])
def test_best_against_all_products(spark, topics):
    rng = np.random.default_rng(1)
    refs, queries = made(rng, 600, topics=topics), made(rng, 80, topics=topics)
    refs[10:20] = [refs[3]] * 10  # ties
    vectors = spark.createDataFrame(pd.DataFrame([(i, int(b), float(w)) for i, (bs, ws) in enumerate(refs) for b, w in zip(bs, ws, strict=True)], columns=["id", "bucket", "weight"]))
    heads = spark.createDataFrame([(i, f"e{i % 5}" if i % 7 else None, f"t{i % 3}") for i in range(600)], "id long, endpoint_key string, attack_type string")
    index = reference_index.ReferenceIndex.of(vectors, heads, 64)
    ids = heads.toPandas().sort_values(["endpoint_key", "id"], na_position="first", kind="stable")["id"].to_numpy()
    dense = np.zeros((600, 64))
    for i, (b, w) in enumerate(refs):
        dense[i, b] = w
    read = whole = 0
    for j, (b, w) in enumerate(queries):
        q = np.zeros(64)
        q[b] = w
        sims = dense @ q
        for k, endpoint in ((1, None), (15, None), (1, f"e{j % 5}"), (15, "unseen")):
            allowed = [i for i in range(600) if endpoint not in {f"e{x}" for x in range(5)} or (i % 7 and f"e{i % 5}" == endpoint)]
            want = sorted((i for i in allowed if sims[i] > 0), key=lambda i: (-round(sims[i], 12), i))[:k]
            places, near, n = index.best(b, w, k, endpoint)
            assert list(ids[places]) == want and np.allclose(near, sims[want], atol=1e-12)
            read, whole = read + n, whole + int((dense[np.ix_(allowed, b)] > 0).sum())
    if topics:
        assert read < whole  # bounds leave lists unread


def test_prediction_by_index_equals_joins_and_shuffles_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"e{rng.integers(9)}" if i % 5 else None, int(i % 2), f"t{i % 4}", [(f"k{rng.integers(40)}", float(rng.integers(1, 9))) for _ in range(rng.integers(0, 12))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, endpoint_key string, label_binary int, attack_type string, bag array<struct<token: string, weight: double>>")
    train, test = df.where("id < 150 and endpoint_key <> 'e3'"), df.withColumns({"row": F.lit("clash"), "y_score": F.lit(7.0), "a.b": F.lit(1)})
    columns = ["id", "y_pred", "predicted_attack_type", "nearest_benign_similarity", "y_score", "attack_similarity"]

    def found(model):
        got = model.predict(test)
        assert {"row", "a.b", "bag"} <= set(got.columns) and got.columns.count("y_score") == 1
        return got, sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.select(*columns).collect())

    for by in ("xxhash64", "md5"):
        fitted = retrieval.RetrievalModel.fit(train, 32, threshold=0.2, by=by)
        plan, quick = found(fitted)
        assert "Exchange" not in plan.select(*columns)._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        _, joined = found(retrieval.RetrievalModel.fit(train, 32, threshold=0.2, by=by, most_bytes=100))
        assert quick == joined and len(quick) == 300
    nobody = retrieval.RetrievalModel.fit(train.limit(0), 32, threshold=0.2).predict(test).collect()
    assert {(r.y_pred, r.predicted_attack_type, r.y_score) for r in nobody} == {(1, "Unknown", 1.0)}
    with pytest.raises(ValueError, match="hash"):
        retrieval.bucket(F.col("id"), by="crc")


def test_md5_buckets_are_those_of_the_column(spark):
    """The tokens of a batch are hashed once each, to the bucket that SQL gives."""
    tokens = ["a", "", "naïve", "日本", "a", "x" * 70, "a"]
    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").orderBy("i").select(retrieval.bucket(F.col("t"), 2048, "md5")).collect()]
    known: dict[bytes, int] = {}
    for _ in range(2):
        assert retrieval.md5_buckets(pa.array([t.encode() for t in tokens], pa.binary()), 2048, known).tolist() == want
    assert len(known) == 5
    assert retrieval.md5_buckets(pa.array([], pa.binary()), 2048, known).tolist() == []
