"""Scores by retrieval: hashed token vectors, nearest benign reference, votes of the nearest attacks.

Token vectors are sparse rows (id, bucket, weight). A model's references, whose number is bounded, become one sparse matrix that every task holds
(`reference_index`), so rows are scored where they are and no pair is shuffled; a matrix beyond its size, and `similarities` in general, are joins on the bucket.
Dense vectors, which would meet in every bucket, are rows (id, v) and multiplied in blocks inside tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tracefold.names import fresh
from tracefold.operators.reference_index import MOST_BYTES, ReferenceIndex, unit
from tracefold.operators.split import balanced_sample
from tracefold.session import bound_batches
from tracefold.storage import written


def weighted(tokens: Column, weight: float, most: int | None = None) -> Column:
    """Tokens as (token, weight) structs; `most` cuts the list."""
    tokens = F.slice(tokens, 1, most) if most else tokens
    return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("weight")))


def bucket(token: Column, dimension: int = 2048, by: str = "xxhash64") -> Column:
    """A token's bucket. by: xxhash64, or md5, whose first 8 hexadecimal digits other engines can take too."""
    if by not in ("xxhash64", "md5"):
        raise ValueError(f"no hash {by}")
    number = F.xxhash64(token) if by == "xxhash64" else F.conv(F.left(F.md5(token), F.lit(8)), 16, 10).cast("long")
    return F.pmod(number, F.lit(dimension)).cast("int")


MOST_KNOWN = 500_000  # tokens whose bucket a task keeps


def md5_buckets(tokens: pa.Array, dimension: int, known: dict[bytes, int]) -> np.ndarray:
    """`bucket` by md5 of tokens as bytes: each distinct token of a batch is looked up once, and hashed if it isn't known."""
    distinct = tokens.dictionary_encode()
    if len(known) > MOST_KNOWN:
        known.clear()
    names = distinct.dictionary.to_pylist()
    for t in names:
        if t not in known:
            known[t] = int.from_bytes(hashlib.md5(t, usedforsecurity=False).digest()[:4], "big") % dimension
    return np.array([known[t] for t in names], dtype=np.int32)[distinct.indices.to_numpy()]


def hashed(df: DataFrame, id_col: str, bag: str, dimension: int = 2048, by: str = "xxhash64") -> DataFrame:
    """(id, bucket, weight) of unit length; rows without tokens have none."""
    flat = df.select(F.col(id_col).alias("id"), F.explode(bag).alias("t")).select("id", bucket(F.col("t.token"), dimension, by).alias("bucket"), F.col("t.weight").alias("weight"))
    sums = flat.groupBy("id", "bucket").agg(F.sum("weight").alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return sums.withColumn("weight", F.col("weight") / F.when(norm > 0, norm).otherwise(1.0))


def similarities(rows: DataFrame, refs: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(id, ref, similarity) of pairs with a bucket in common (and equal `on` columns)."""
    on = on or []
    other = refs.select(F.col("id").alias("ref"), "bucket", F.col("weight").alias("w"), *on)
    return rows.join(other, ["bucket", *on]).groupBy("id", "ref").agg(F.sum(F.col("weight") * F.col("w")).alias("similarity"))


BLOCK = 16_384


def dense(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is there and all finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def nearest(rows: DataFrame, refs: DataFrame, k: int, others: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, ref, similarity): of each row the k references of the largest cosine, ties (to 12 digits) to the smaller ref.

    rows, refs: as of `dense`, ids unique. `others`: a row is no reference of itself. Every row meets every reference, in tasks of a block
    of each; only the k best of a block leave a task.
    """
    a, b = (max(1, math.ceil(x.count() / block)) for x in (rows, refs))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ref {refs.schema['id'].dataType.simpleString()}, similarity double"

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["v"].map(len).max())
            x, y, ids, names = _unit(left["v"], width), _unit(right["v"], width), left["id"].to_numpy(), right["ref"].to_numpy()
            for start in range(0, len(x), 256):
                for i, s in zip(ids[start : start + 256], np.round(x[start : start + 256] @ y.T, 12), strict=True):
                    at = np.flatnonzero(names != i) if others else np.arange(len(names))
                    if len(at) > k:
                        least = np.partition(s[at], len(at) - k)[len(at) - k]
                        at = at[s[at] >= least]
                    at = at[np.lexsort((names[at], -s[at]))[:k]]
                    out.append(pd.DataFrame({"id": i, "ref": names[at], "similarity": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "ref": [], "similarity": []}).astype({"id": left["id"].dtype, "ref": right["ref"].dtype})

    left = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    right = refs.select(F.col("id").alias("ref"), "v", F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a"), F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("b"))
    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, schema)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "ref")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def scores(ids: DataFrame, best: DataFrame, none: bool = False) -> DataFrame:
    """(id, nearest_benign_similarity, y_score) from best (id, s); `none`: there are no references."""
    got = ids.join(best, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("nearest_benign_similarity"))
    return got.withColumn("y_score", F.lit(1.0) if none else F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("nearest_benign_similarity"))))


def nearest_benign(ids: DataFrame, rows: DataFrame, refs: DataFrame, keys: DataFrame, ref_keys: DataFrame) -> DataFrame:
    """(id, nearest_benign_similarity, y_score): against benign references of the same endpoint, against all if it has none.

    ids: (id). rows, refs: sparse vectors. keys: (id, endpoint_key). ref_keys: (id, endpoint_key) of the references.
    """
    known = keys.join(ref_keys.select("endpoint_key").distinct(), "endpoint_key", "left_semi")
    same = similarities(rows.join(known, "id"), refs.join(ref_keys, "id"), ["endpoint_key"])
    rest = similarities(rows.join(known, "id", "left_anti"), refs)
    best = same.unionByName(rest).groupBy("id").agg(F.max("similarity").alias("s"))
    return scores(ids, best, ref_keys.limit(1).isEmpty())


def votes(pairs: DataFrame, types: DataFrame, k: int = 15) -> DataFrame:
    """(id, predicted_attack_type, attack_similarity): types of the k nearest attacks by the sum of positive similarities, ties to the smaller name.

    pairs: (id, ref, similarity). types: (ref, attack_type).
    """
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "ref"))).where(F.col("rank") <= k)
    per = top.join(types, "ref").groupBy("id", "attack_type").agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("score"))
    first = Window.partitionBy("id").orderBy(F.desc("score"), "attack_type")
    return per.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("id", F.col("attack_type").alias("predicted_attack_type"), F.col("score").alias("attack_similarity"))


class RetrievalModel:
    """References of benign and attack rows; a table each, so it saves and loads as Parquet.

    df needs id, endpoint_key, bag (array of (token, weight)); to fit also label_binary and attack_type.
    """

    def __init__(self, vectors: DataFrame, refs: DataFrame, dimension: int, threshold: float = 0.5, by: str = "xxhash64", most_bytes: int = MOST_BYTES):
        self.vectors, self.refs, self.dimension, self.threshold, self.by, self.most_bytes = vectors, refs, dimension, threshold, by, most_bytes
        self._held: tuple | None = None

    @classmethod
    def fit(cls, df: DataFrame, dimension: int = 2048, most: int = 80_000, threshold: float = 0.5, by: str = "xxhash64", most_bytes: int = MOST_BYTES, bags: Callable[[DataFrame], DataFrame] | None = None) -> RetrievalModel:
        """At most `most` references of a kind, drawn by a hash of the id; attacks evenly by type.

        They are drawn by narrow rows; only the bags of those drawn are then taken, from df or by `bags`, which gets
        their ids, a small table, and returns (id, bag), so that no other row's bag is made.
        """
        heads = df.select("id", "endpoint_key", "label_binary", "attack_type", (F.xxhash64("id") if by == "xxhash64" else F.md5(F.col("id").cast("string"))).alias("drawn"))
        benign = heads.where("label_binary = 0").orderBy("drawn").limit(most)
        attack = balanced_sample(heads.where("label_binary = 1"), "attack_type", most, "drawn")
        chosen = written(benign.unionByName(attack).drop("drawn"), "references")
        own = F.broadcast(chosen.select("id").distinct())  # twice `most` ids at most
        found = bags(own) if bags else df.select("id", "bag").join(own, "id", "left_semi")
        vectors = written(hashed(found, "id", "bag", dimension, by), "vectors")
        return cls(vectors, chosen, dimension, threshold, by, most_bytes)

    def _broadcast(self) -> tuple | None:
        """(benign, attack) references on every executor, or None if a part is too large; made once."""
        if self._held is None:
            parts = [ReferenceIndex.of(self.vectors, self.refs.where(f"label_binary = {x}"), self.dimension, self.most_bytes) for x in (0, 1)]
            self._held = (None,) if None in parts else (self.refs.sparkSession.sparkContext.broadcast(parts),)
        return self._held[0]

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """df, or the columns of it to keep, with nearest_benign_similarity, y_score, y_pred, predicted_attack_type, attack_similarity; columns of these names are replaced.

        Benign references of the row's endpoint count, all if it has none; the types of the 15 nearest attacks vote. One pass over the rows, without a shuffle.
        """
        made = ("nearest_benign_similarity", "y_score", "y_pred", "predicted_attack_type", "attack_similarity")
        df = df.drop(*made)
        held = self._broadcast()
        if held is None:
            return self._predict_by_joins(df).select(*(F.col(f"`{c}`") for c in keep or df.columns), *made)
        bound_batches(df)
        kept = [F.col(f"`{c}`") for c in keep or df.columns]
        dimension, threshold, by = self.dimension, self.threshold, self.by

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benign, attack = held.value
            known: dict[bytes, int] = {}
            for batch in batches:
                out: list[tuple] = []
                ends = batch.column(2).offsets.to_numpy()
                tokens, given = batch.column(2).values, batch.column(3).values.to_numpy(zero_copy_only=False)
                tokens = md5_buckets(tokens, dimension, known) if by == "md5" else tokens.to_numpy(zero_copy_only=False)
                for row, endpoint in enumerate(batch.column(1).to_pylist()):
                    own = slice(ends[row], ends[row + 1])
                    buckets, weights = unit(tokens[own], given[own], dimension)
                    _, near, _ = benign.best(buckets, weights, 1, endpoint)
                    similar = float(near[0]) if len(near) else 0.0
                    risk = min(1.0, max(0.0, 1.0 - similar))
                    kind, total = "Benign", 0.0
                    if risk >= threshold:
                        places, votes, _ = attack.best(buckets, weights, 15)
                        kind, total = attack.vote(places, votes)
                    out.append((similar, risk, int(risk >= threshold), kind or "Unknown", total))
                kinds = (pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["row", *made])

        tokens = F.filter(F.coalesce("bag", F.array().cast(df.schema["bag"].dataType)), lambda t: t["token"].isNotNull())
        packed = df.select(
            F.struct(*kept).alias("row"), F.col("endpoint_key").cast("string").alias("endpoint"),
            F.transform(tokens, lambda t: t["token"].cast("binary") if by == "md5" else bucket(t["token"], dimension, by)).alias("buckets"), F.transform(tokens, lambda t: t["weight"].cast("double")).alias("weights"),
        )
        schema = StructType([packed.schema["row"], *(StructField(n, t) for n, t in zip(made, (DoubleType(), DoubleType(), IntegerType(), StringType(), DoubleType()), strict=True))])
        scored = packed.mapInArrow(score, schema)
        return scored.select(*(F.col("row").getField(c).alias(c) for c in keep or df.columns), *made)

    def _predict_by_joins(self, df: DataFrame) -> DataFrame:
        """The same for references that are too many for every task to hold: pairs that share a bucket."""
        rows = hashed(df, "id", "bag", self.dimension, self.by)
        benign, attack = self.refs.where("label_binary = 0"), self.refs.where("label_binary = 1")
        of = lambda x: self.vectors.join(x.select("id"), "id", "left_semi")
        scored = nearest_benign(df.select("id"), rows, of(benign), df.select("id", "endpoint_key"), benign.select("id", "endpoint_key"))
        scored = scored.withColumn("y_pred", (F.col("y_score") >= self.threshold).cast("int"))
        flagged = scored.where("y_pred = 1").select("id")
        voted = votes(similarities(rows.join(flagged, "id", "left_semi"), of(attack)), attack.select(F.col("id").alias("ref"), "attack_type"))
        out = df.join(scored, "id").join(voted, "id", "left")
        kind = F.when(F.col("y_pred") == 0, F.lit("Benign")).otherwise(F.coalesce("predicted_attack_type", F.lit("Unknown")))
        return out.withColumns({"predicted_attack_type": kind, "attack_similarity": F.when(F.col("y_pred") == 1, F.coalesce("attack_similarity", F.lit(0.0))).otherwise(0.0)})

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.refs.write.mode("overwrite").parquet(f"{path}/refs")
        meta = self.refs.sparkSession.createDataFrame([(self.dimension, self.threshold, self.by)], "dimension int, threshold double, hash string")
        meta.write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> RetrievalModel:
        meta = spark.read.schema("dimension int, threshold double, hash string").json(f"{path}/meta").collect()[0]
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/refs"), meta["dimension"], meta["threshold"], meta["hash"] or "xxhash64")
