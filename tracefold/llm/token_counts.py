"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

1. Every task counts its pre-tokens; those that repeat within a stretch of text are summed over the corpus, and the
   most frequent ones, at most `most_broadcast`, get their number of pieces and are broadcast (12 bytes each, so the
   bound holds at any input size). The bound comes from a histogram of frequencies, not from a sort.
2. Every document's pre-token frequencies meet that table in the task. The other pre-tokens go as
   (row, pre-token, frequency) to the partition of their pre-token, where each distinct one is counted once; frequency
   times pieces is then summed by row.

Pre-tokens are matched by a 64-bit hash in step 1 and by their text in step 2.
Null texts count as empty; repeated rows and ids each keep their own result; texts of any length are counted whole, in chunks;
other columns, also of names used here, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches, codepoints, scratch, slice_hashes
from tracefold.llm.pieces import default_tokenizer, piece_table, plain_parts, pretokens

MOST_BROADCAST = 500_000
HISTOGRAM_STEPS = 8
STRETCH = 1 << 23  # characters within which a pre-token that repeats counts as frequent; other rows come once per stretch at most
FLUSH = 1_000_000


def frequent_pretokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(piece, n) of pre-tokens that occur at least twice in some stretch of text."""

    def repeats(held: list) -> Iterator[tuple[str, int]]:
        hashes = np.concatenate([x[3] for x in held])
        part = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
        at = np.concatenate([np.arange(len(x[3])) for x in held])
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        first, counts = first[counts > 1], counts[counts > 1]
        for p, i, n in zip(part[first].tolist(), at[first].tolist(), counts.tolist(), strict=True):
            joined, starts, ends, _ = held[p]
            yield joined[starts[i] : ends[i]], n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held, size = [], 0
        for batch in batches:
            for joined, starts, ends, hashes, _ in pretokens([x for x in batch.column(0).to_pylist() if x]):
                held.append((joined, starts, ends, hashes))
                size += len(joined)
                if size >= STRETCH:
                    seen.update(dict(repeats(held)))
                    held, size = [], 0
                if len(seen) >= FLUSH:
                    yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())})
                    seen.clear()
        if held:
            seen.update(dict(repeats(held)))
        if seen:
            yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())})

    return docs.select(text_col).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """All pre-tokens above the lowest frequency step at which at most `most` remain."""
    step = F.floor(F.log2("n") * HISTOGRAM_STEPS).cast("int")
    kept, least = 0, 1 << 30
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 64 * 8 rows
        if kept + row["count"] > most:
            break
        kept, least = kept + row["count"], row["step"]
    return counts.where(step >= least).select("piece")


def _pieces_of(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_table(path).tokenizer
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            hashes = np.zeros(len(texts), dtype=np.uint64)
            for i, text in enumerate(texts):
                cp = codepoints(text)
                hashes[i] = slice_hashes(cp, np.zeros(1, dtype=np.int64), np.array([len(cp)]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sizes, pa.int64())], ["hash", "pieces"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    bound_batches(docs)
    counts = scratch(frequent_pretokens(docs, text_col), "pretokens")
    frequent = most_frequent(counts, most_broadcast).mapInArrow(_pieces_of(path), "hash long, pieces long").toArrow()
    keys = frequent["hash"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], frequent["pieces"].to_numpy()[order].astype(np.uint32)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        keys, pieces = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            texts = [x or "" for x in batch.column(2).to_pylist()]
            parts, owner, special = plain_parts(texts, table)
            owner = np.array(owner, dtype=np.int64)
            total = np.zeros(len(texts), dtype=np.int64)
            for i, _, _ in special:
                total[i] += 1
            rare_row, rare_piece, rare_n = [], [], []
            for joined, starts, ends, hashes, of in pretokens(parts):
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
                of = owner[of]
                if known.any():
                    total += np.bincount(of[known], weights=pieces[at[known]], minlength=len(texts)).astype(np.int64)
                rare = np.flatnonzero(~known)
                if len(rare):
                    _, inverse = np.unique(hashes[rare], return_inverse=True)
                    _, first, n = np.unique(of[rare] * (len(rare) + 1) + inverse, return_index=True, return_counts=True)
                    at = rare[first]
                    rare_row.append(of[at])
                    rare_n.append(n)
                    rare_piece += [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"row": rows, "doc_id": batch.column(1), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "piece": pa.nulls(len(texts), pa.string()), "n": total})
            if rare_row:
                rare_rows = rows[np.concatenate(rare_row)]
                yield pa.RecordBatch.from_pydict({"row": rare_rows, "doc_id": pa.nulls(len(rare_rows), batch.column(1).type), "n_bytes": pa.nulls(len(rare_rows), pa.int64()), "piece": pa.array(rare_piece, pa.string()), "n": np.concatenate(rare_n).astype(np.int64)})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_table(path).tokenizer
        last: dict[str, int] = {}
        for batch in batches:  # sorted by piece, so those of one piece follow each other
            texts = batch.column(3).to_pylist()
            new = [x for x in dict.fromkeys(texts) if x is not None and x not in last]
            sizes = dict(zip(new, (len(x.ids) for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)) | last
            sizes[None] = 1
            n = batch.column(4).to_numpy() * np.array([sizes[x] for x in texts], dtype=np.int64)
            if texts and texts[-1] is not None:
                last = {texts[-1]: sizes[texts[-1]]}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n)], ["row", "doc_id", "n_bytes", "n"])

    id_type = docs.schema[id_col].dataType.simpleString()
    kind = f"row long, doc_id {id_type}, n_bytes long"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    flat = rows.mapInArrow(frequencies, f"{kind}, piece string, n long")
    # a row's own line needs no particular partition
    dealt = flat.repartition(F.coalesce("piece", F.col("row").cast("string"))).sortWithinPartitions("piece")
    return dealt.mapInArrow(multiply, f"{kind}, n long").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).drop("row")
