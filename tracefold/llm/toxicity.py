"""Toxicity scores: gradient-boosted trees over dense features of the text, with isotonic calibration.

1. From labelled rows (a sample of at most `most_rows`, by a hash of the id) two folds come: trees and calibration.
2. The lexicon is learned from the first fold: words and word beginnings of 4 to 8 letters that occur in many toxic and
   next to no clean texts. It is no larger than the terms of those at most `most_rows` texts, whatever the input, so it is broadcast.
3. Features of every whole text, in numpy over code points: lexicon densities (plain and of disguised spellings), hits
   near second-person words, capitals, punctuation, obfuscation and repetition rates.
4. Spark ML fits boosted trees on the first fold and an isotonic regression of their probability on the second.
   The score is the calibrated value, with a thousandth of the trees' probability to order what it makes equal.

Only the text enters a score, and nothing of the texts beside it in a batch: windows and repeats end with the text (and, in one of
over CHUNK_CHARS characters, at the space where it is cut). Null and empty texts have all features 0. Rows without a label, and labels other than 0
and 1, train nothing. With labels of a single class, or none, every score is that class's share (0 without labels).
Repeated rows and rows of one id get scores by their own texts; other columns, also of names used here, play no part; null ids count as not held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tracefold.llm.common import bound_batches, chunks, codepoints, packed, prefix_sums, scratch, slice_hashes, unpacked

MOST_ROWS = 20_000
THRESHOLD = 0.3
NEAR = 4
STRONG = 3.5
BEGINNINGS = (4, 5, 6, 7, 8)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros os".split()
FEATURES = (
    "words", "hits_share", "hits", "weight_share", "near_second", "second_share", "disguised_hits", "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "repeated", "strong", "strong_share",
)
_SAFE = re.compile(r"\w ")
_DISGUISE = dict(zip("013457@$", "oieastas", strict=True))
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
        plain = np.arange(0x110000, dtype=np.uint32)
        for a, b in _DISGUISE.items():
            plain[ord(a)] = ord(b)
        _tables["plain"] = plain
    return _tables["letters"]


def _plain() -> np.ndarray:
    """Code points with usual disguises undone."""
    _letters()
    return _tables["plain"]


def _words(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, digits, @ and $ that hold a letter; none runs over a text's end."""
    letters = _letters()[cp]
    solid = letters | ((cp >= 48) & (cp <= 57)) | (cp == 64) | (cp == 36)
    edge = np.zeros(len(cp) + 1, dtype=bool)
    edge[bounds] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    count = np.concatenate([[0], np.cumsum(letters)])
    keep = count[ends] > count[starts]
    return starts[keep], ends[keep]


def _terms(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word and of its beginnings (0 where the word is no longer), a column each."""
    prefix = prefix_sums(cp)
    out = [slice_hashes(cp, starts, ends, prefix)]
    for n in BEGINNINGS:
        out.append(np.where(ends - starts > n, slice_hashes(cp, starts, np.minimum(ends, starts + n), prefix) + np.uint64(n), 0))
    return np.stack(out, axis=1)


def learn_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of terms, weights) from rows (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            last, before = -1, np.zeros(0, dtype=np.uint64)  # a text cut into chunks counts its terms once
            for joined, owner, lengths in chunks([(x or "").lower() for x in batch.column(0).to_pylist()], _SAFE):
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                cp = _plain()[codepoints(joined)]
                starts, ends = _words(cp, bounds)
                terms = _terms(cp, starts, ends)
                doc = np.repeat(owner[np.searchsorted(bounds, starts, side="right") - 1][:, None], terms.shape[1], axis=1)
                pairs = np.unique(np.stack([terms.ravel(), doc.ravel().astype(np.uint64)]), axis=1)
                if len(owner) and owner[0] == last:
                    pairs = pairs[:, (pairs[1] != last) | ~np.isin(pairs[0], before)]
                if len(owner):
                    own = pairs[0][pairs[1] == owner[-1]]
                    before = np.concatenate([before, own]) if owner[-1] == last else own
                    last = int(owner[-1])
                keys, inverse = np.unique(pairs[0], return_inverse=True)
                toxic = labels[pairs[1].astype(np.int64)]
                a = np.bincount(inverse, weights=toxic, minlength=len(keys)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(n.astype(np.int64) - a)], ["term", "toxic", "clean"])

    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.select("text", "label").mapInArrow(count, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    support = max(4, n_toxic // 150)
    kept = counts.where((F.col("term") != 0) & (F.col("toxic") >= support) & ((F.col("clean") * 20 <= F.col("toxic")) | (F.col("toxic") >= 2 * support)))
    got = kept.select("term", weight.alias("weight"), "toxic").where("weight > 2").toPandas()
    keys = got["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["weight"].to_numpy(float)[order]


def _lookup(terms: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each word: the largest of those of its terms, 0 without any."""
    if not len(keys):
        return np.zeros(len(terms))
    at = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
    return np.where(keys[at] == terms, weights[at], 0.0).max(axis=1)


def text_features(texts: list[str], keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(texts)
    second = np.sort(np.concatenate([slice_hashes(codepoints(w), np.zeros(1, dtype=np.int64), np.array([len(w)])) for w in SECOND_PERSON]))
    sums = {k: np.zeros(n) for k in ("chars", "words", "hits", "weight", "near", "second", "disguised", "letters", "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "repeated", "strong")}
    for joined, owner, lengths in chunks(texts, _SAFE):
        if not joined:
            continue
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        raw = codepoints(joined)
        lower = joined.lower()
        small = codepoints(lower) if len(lower) == len(joined) else codepoints("".join(x.lower() if len(x.lower()) == 1 else x for x in joined))
        letters = _letters()[raw]
        plain = _plain()[small]
        starts, ends = _words(raw, bounds)
        part = np.searchsorted(bounds, starts, side="right") - 1
        doc = owner[part]
        weight = _lookup(_terms(plain, starts, ends), keys, weights)
        hit = weight > 0
        prefix = np.concatenate([[0], np.cumsum(~letters)])
        odd = prefix[ends] > prefix[starts]  # digits or signs among the letters
        words = slice_hashes(small, starts, ends)
        you = second[np.minimum(np.searchsorted(second, words), len(second) - 1)] == words
        seen = np.concatenate([[0], np.cumsum(you)])
        at = np.arange(len(words))
        low, high = np.searchsorted(part, part), np.searchsorted(part, part, side="right")  # the words of the same text
        near = hit & (seen[np.minimum(at + NEAR + 1, high)] > seen[np.maximum(at - NEAR, low)])
        upper = letters & (raw != small)
        ups = np.concatenate([[0], np.cumsum(upper)])
        shouted = (ends - starts > 2) & (ups[ends] - ups[starts] == ends - starts)
        per_char = np.repeat(owner, lengths)
        same = np.zeros(len(raw), dtype=bool)
        since = np.arange(len(raw)) - np.repeat(bounds[:-1], lengths)
        same[2:] = letters[2:] & (small[2:] == small[1:-1]) & (small[2:] == small[:-2]) & (since[2:] >= 2)
        sign = ~letters & (raw > 32) & ~((raw >= 48) & (raw <= 57))
        for name, mask in (("letters", letters), ("capitals", upper), ("exclamations", raw == 33), ("questions", raw == 63), ("punctuation", sign), ("repeated", same)):
            sums[name] += np.bincount(per_char[mask], minlength=n)
        sums["chars"] += np.bincount(owner, weights=lengths, minlength=n)
        sums["words"] += np.bincount(doc, minlength=n)
        sums["weight"] += np.bincount(doc, weights=weight, minlength=n)
        for name, mask in (("hits", hit), ("near", near), ("second", you), ("disguised", hit & odd), ("strong", weight > STRONG), ("shouted", shouted), ("obfuscated", odd)):
            sums[name] += np.bincount(doc[mask], minlength=n)
    words, chars, some = np.maximum(sums["words"], 1), np.maximum(sums["chars"], 1), np.maximum(sums["letters"], 1)
    return np.stack(
        [
            np.log1p(sums["words"]), sums["hits"] / words, np.log1p(sums["hits"]), sums["weight"] / words, sums["near"] / words, sums["second"] / words, np.log1p(sums["disguised"]),
            sums["capitals"] / some, sums["shouted"] / words, sums["exclamations"] / chars, sums["questions"] / chars, sums["punctuation"] / chars, sums["obfuscated"] / words, sums["repeated"] / chars,
            np.log1p(sums["strong"]), sums["strong"] / words,
        ],
        axis=1,
    )


def with_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and last `features`, a vector."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    bound_batches(docs)
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    name = "features"
    while name in {c.lower() for c in keep}:
        name += "_"
    where = keep.index(text_col) if text_col in keep else len(keep)
    count = len(keep)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = text_features([x or "" for x in batch.column(where).to_pylist()], *shared.value)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(count)), vectors], [*keep, name])

    schema = StructType([*kept.schema.fields, StructField(name, ArrayType(DoubleType()))])
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text_col in keep else [F.col(f"`{text_col}`").alias(f"{name}_text")]))
    return rows.mapInArrow(features, schema).withColumn(name, array_to_vector(name))


def fold(id_column: Column) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4))


class ToxicityModel:
    """A fitted lexicon, trees and calibration; `score` gives a number from 0 to 1 for each row."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, trees: int = 20, depth: int = 3):
        usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
        usable = usable.withColumn("fold", fold(F.col("id"))).where("fold <> 2")
        total = usable.count()
        share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.95 * most_rows / max(1, total)) + (total <= most_rows))
        sample = usable.where(share).limit(most_rows)
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        rows = scratch(texts.join(F.broadcast(sample), "id").select("text", "label", "fold"), "labelled")  # at most most_rows short rows
        sizes = {(r["fold"] == 1, r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()} if total else {}
        by_label = [sum(v for k, v in sizes.items() if k[1] == x) for x in (0, 1)]
        self.constant = None if min((sizes.get((False, x), 0) for x in (0, 1))) > 0 else by_label[1] / max(1, sum(by_label))
        if self.constant is not None:
            return
        self.lexicon = learn_lexicon(rows.where("fold <> 1").select("text", "label"))
        made = scratch(with_features(rows, self.lexicon, "text", ["label", "fold"]).select("label", "fold", vector_to_array("features").alias("features")), "features")
        made = made.withColumn("features", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
        self.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxMemoryInMB=64).fit(made.where("fold <> 1").coalesce(4))
        scored = self.trees.transform(made.where("fold = 1")).select("label", vector_to_array("probability")[1].alias("raw"))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored) if not scored.isEmpty() else None

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
        """docs, without the text unless keep_text, with the score as its last column."""
        keep = [c for c in docs.columns if keep_text or c != text_col]
        if self.constant is not None:
            return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(self.constant)).alias(name))
        got = with_features(docs, self.lexicon, text_col, keep)
        vector = got.columns[-1]
        model = self.trees.copy().setFeaturesCol(vector)
        raw, even, chance = (f"{vector}_{x}" for x in ("raw", "even", "chance"))
        model.setPredictionCol(f"{vector}_class").setRawPredictionCol(f"{vector}_sums").setProbabilityCol(chance)
        got = model.transform(got).withColumn(raw, vector_to_array(chance)[1])
        value = F.col(raw)
        if self.calibration is not None:
            got = self.calibration.copy().setFeaturesCol(raw).setPredictionCol(even).transform(got)
            value = 0.999 * F.col(even) + 0.001 * F.col(raw)
        return got.select(*(F.col(f"`{c}`") for c in keep), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias(name))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = ToxicityModel(docs, labels, id_col, text_col)
    got = model.score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored at the threshold or above."""
    model = ToxicityModel(docs, labels, id_col, text_col)
    got = model.score(packed(docs, text_col), text_col="text", keep_text=True)  # whatever the names of docs are, they're inside a struct
    return unpacked(got.where(F.col("score") < threshold), docs, text_col)
