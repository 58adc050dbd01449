"""Packing of documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids (with the end id) are cut into full sequences and one rest; the pieces of `group_docs` documents on
average, dealt to a group by a hash of their row, are packed by one task. Groups don't depend on each other, so the
padding of the last sequences of each group (well under one sequence in a hundred) is the price of no shared state.

Null texts are empty documents (the end id alone); repeated ids and rows are packed each on their own;
texts of any length are cut whole, a full sequence at a time; ties of size go by place in the group; an empty table gives no rows;
other columns, also of names used here, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches
from tracefold.llm.pieces import END_ID, default_tokenizer, encode

SEQUENCE = 1024
GROUP_DOCS = 4096


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; items in decreasing size go to the lowest-numbered bin with room.

    A tournament tree over the bins holds the largest free capacity of each subtree, so a bin is found in log2 steps.
    Sizes are between 1 and capacity.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    for i in rest:
        size = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        offsets[i] = capacity - tree[node]
        bins[i] = full + node - leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    bound_batches(docs)
    groups = max(1, math.ceil(docs.count() / group_docs))
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            at, start, length, crc, tokens = [], [], [], [], []
            for i, got in enumerate(encode([x or "" for x in batch.column(2).to_pylist()], path)):
                raw = np.append(got, np.uint32(END_ID)).astype("<u4").tobytes()
                n = len(raw) // 4
                for a in range(0, n, sequence):
                    b = min(n, a + sequence)
                    at.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    tokens.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), ids.take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def place(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["row", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(got["length"].to_numpy(np.int64), sequence)
        got["sequence_id"] = (np.int64(key[0]) << 32) + bins
        got["offset"] = offsets
        return got[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = "start long, length long, ids_crc32 long, doc_tokens long"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(cut, f"row long, doc_id {id_type}, {kind}")
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    return pieces.groupBy(group).applyInPandas(place, f"doc_id {id_type}, {kind}, sequence_id long, offset long")
