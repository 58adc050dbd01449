"""Substring dedup: duplicate spans by a relative Lempel-Ziv parse of every document against all earlier text.

The reference is all text that comes earlier (smaller id, or same document and earlier start). It is indexed in blocks by
anchor: the least hash of the 5-word grams of a window of `window` words. Equal windows have equal anchors, so all copies of a
window stand in one block, and a document meets those blocks only that its own anchors name, and not every block.

1. Anchors that stand at one place only have no copy. A first pass counts the places of each anchor, and a bitmap of at most
   BITMAP_BITS bits, broadcast, tells a second pass which windows may have a copy (if it fills up, more windows do, with the
   same result).
2. In the second pass a task looks up each window in the index of its own stretch of text; what is found there travels as one
   factor, so a passage that a third of all documents share meets others once per stretch and not once per document.
   The other windows go to the block of their anchor, runs of neighbours as one row, and are looked up there: a window that stands
   earlier is part of a factor. A block gets each window once per stretch at most.
3. Each document is parsed greedily: a factor starts at the first window found and is as long as the following windows continue
   in the same source. Windows that lie across the end of a factor are checked as well: each that is found starts a further
   factor, which overlaps the one before. The words of all factors are the duplicate spans.

Windows are told apart by two hashes of 64 bits. Texts of any length are factored whole.

Null texts and texts of fewer words than the window have no windows and stay whole. Null ids come last. Rows that share
an id are one document: of their windows those with the smaller start come first, and equal starts leave each other alone.
Repeated rows get equal results. Other columns, also of names used here, are kept or play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches, fresh, gram_hashes, mix, packed, portions, unpacked, word_hashes

WINDOW = 20
GRAM = 5
STRETCH = 1 << 22  # characters within which a repeat becomes a factor at once
MOST_WINDOWS = 64  # in a row of windows with one anchor
BITMAP_BITS = 1 << 26


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def runs(keys: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of neighbouring positions `at` with one key, of at most `most`."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (keys[1:] != keys[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % most == 0)
    return begin, np.diff(np.append(begin, len(at)))


def _windows(texts: list[str], window: int) -> tuple[np.ndarray, ...] | None:
    """Of one stretch of texts: text and place of each word, hash and anchor of the window that starts there, and which of these lie in one text."""
    words, counts = word_hashes(texts, lower=False)
    if len(words) < window:
        return None
    doc = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = gram_hashes(words, window)
    anchors = sliding_min(gram_hashes(words, GRAM), window - GRAM + 1)
    at = np.flatnonzero(doc[: len(hashes)] == doc[window - 1 :])
    return (doc, start, hashes, anchors, at) if len(at) else None


def _places(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(anchor, places) of one stretch: neighbouring windows of one anchor are one place, or several if a window among them repeats."""
    if (got := _windows(texts, window)) is None:
        return None
    _, _, hashes, anchors, at = got
    begin, _ = runs(anchors[at], at, 1 << 30)
    again = np.zeros(len(hashes), dtype=bool)
    for shift in range(1, min(window, len(hashes))):
        again[shift:] |= hashes[shift:] == hashes[:-shift]
    return np.unique(np.concatenate([anchors[at[begin]], anchors[at[again[at]]]]), return_counts=True)


def _window_rows(texts: list[str], ids: list, window: int, bitmap: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Of one stretch: (text, start, length, anchor, window hashes) of runs to look up elsewhere, and factors (text, start, length, text and start of the source)."""
    if (got := _windows(texts, window)) is None:
        return None
    doc, start, hashes, anchors, at = got
    at = at[_hit(bitmap, anchors[at])]
    rank = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}))}
    ranks = np.array([rank.get(x, len(rank)) for x in ids], dtype=np.int64)
    order = at[np.lexsort((start[at], ranks[doc[at]], hashes[at]))]
    head = np.ones(len(order), dtype=bool)
    head[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    source = np.full(len(hashes), -1, dtype=np.int64)
    source[order] = np.where((ranks[doc[order]] > ranks[doc[first]]) | (start[order] > start[first]), first, -1)
    new, old = at[source[at] < 0], at[source[at] >= 0]
    begin, length = runs(anchors[new], new, MOST_WINDOWS)
    known, known_length = runs(source[old] - old, old, 1 << 30)
    of = source[old][known]
    return doc[new][begin], start[new][begin], length, anchors[new][begin], hashes[new], doc[old][known], start[old][known], known_length, doc[of], start[of]


def _hit(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    bit = (anchors % np.uint64(len(bitmap) * 64)).astype(np.int64)
    return (bitmap[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _shared_anchors(rows: DataFrame, window: int) -> np.ndarray:
    """A bitmap of the anchors that stand at several places."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for part in portions(texts, STRETCH):
                if got := _places(texts[part], window):
                    yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), pa.array(got[1].astype(np.int64))], ["anchor", "places"])

    counts = rows.select("text").mapInArrow(places, "anchor long, places long").groupBy("anchor").agg(F.sum("places").alias("places"))
    # pmod of the anchor as an unsigned number: BITMAP_BITS is a power of two, so the low bits
    bit = F.col("anchor").bitwiseAND(F.lit(BITMAP_BITS - 1))
    words = counts.where("places > 1").groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("bits"))
    got = words.toArrow()  # at most BITMAP_BITS / 64 rows of 16 bytes
    out = np.zeros(BITMAP_BITS // 64, dtype=np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _lookups(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """doc_id, tie (a hash of the text) and, for each document that repeats anything, `found`: an array of (start, n, bits, source, shift):
    n windows from start on, or if n is 0 those of the bits set, that stand in an earlier document or place, shift words further on."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_shared_anchors(rows, window))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            ids = batch.column(0).to_pylist()
            for part in portions(texts, STRETCH):
                if (got := _window_rows(texts[part], ids[part], window, shared.value)) is None:
                    continue
                doc, start, length, anchor, hashes, known_doc, known_start, known_length, source, source_start = got
                none = len(known_doc)
                offsets = np.concatenate([[0], np.cumsum(length), np.full(none, length.sum())]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
                rows = pa.array(np.concatenate([doc, known_doc]) + part.start)
                sources = pa.array(np.concatenate([np.zeros(len(doc), dtype=np.int64), source]) + part.start)
                elsewhere = np.concatenate([np.ones(len(doc), dtype=bool), np.zeros(none, dtype=bool)])
                own = mix(known_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + known_start.astype(np.uint64))  # needs no block, so any will do
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([anchor, own]).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([start, known_start]).astype(np.int32)),
                        pa.array(np.concatenate([length, known_length]).astype(np.int32)), values, pa.array(elsewhere), batch.column(0).take(sources), pa.array(np.concatenate([np.zeros(len(doc)), source_start - known_start]).astype(np.int32)),
                    ],
                    ["anchor", "doc_id", "tie", "start", "n", "hashes", "elsewhere", "source", "shift"],
                )

    kind = f"anchor long, doc_id {id_type}, tie long, start int, n int, hashes array<long>, elsewhere boolean, source {id_type}, shift int"
    blocks = rows.mapInArrow(windows, kind).repartition("anchor")  # what follows needs no further exchange by window
    each = blocks.select("anchor", "doc_id", "tie", "start", "n", "elsewhere", "source", "shift", F.posexplode_outer("hashes").alias("i", "hash")).withColumn("i", F.coalesce("i", F.lit(0)))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), (F.col("start") + F.col("i")).alias("at"))
    each = each.withColumn("place", place).withColumn("first", F.min("place").over(Window.partitionBy("anchor", "hash"))).where("not elsewhere or first < place")
    each = each.withColumns({"source": F.when(F.col("elsewhere"), F.col("first.id")).otherwise(F.col("source")), "shift": F.when(F.col("elsewhere"), F.col("first.at") - F.col("place.at")).otherwise(F.col("shift"))})
    runs_of = each.groupBy("anchor", "doc_id", "tie", "start", "n", "elsewhere", "source", "shift").agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits"))
    run = F.struct("start", F.when(F.col("elsewhere"), 0).otherwise(F.col("n")).alias("n"), "bits", "source", "shift")
    return runs_of.groupBy("doc_id", "tie").agg(F.collect_list(run).alias("found"))  # as long as the document at most


def _spans(found: list[dict]) -> list[tuple[int, int, object, int]]:
    """(start, windows, source, shift) of what was found, from the left."""
    out = []
    for x in found:
        start, n, bits = x["start"], x["n"], x["bits"] & (1 << MOST_WINDOWS) - 1
        if n:
            out.append((start, n, x["source"], x["shift"]))
            continue
        while bits:
            low = (bits & -bits).bit_length() - 1
            length = (~(bits >> low) & (bits >> low) + 1).bit_length() - 1  # of the ones from there on
            out.append((start + low, length, x["source"], x["shift"]))
            bits &= ~(((1 << length) - 1) << low)
    return sorted(out, key=lambda x: (x[0], -x[1]))


def parse(found: list[dict], window: int = WINDOW) -> list[tuple[int, int, object, int]]:
    """Factors (start, words, source, start in the source) of one document, greedily from the left."""
    out: list[tuple[int, int, object, int]] = []
    end = 0  # of the windows of the last factor
    for start, n, source, shift in _spans(found):
        if out and start <= end and (source, shift) == (out[-1][2], out[-1][3] - out[-1][0]):
            end = max(end, start + n)  # the source goes on
            out[-1] = (out[-1][0], end - out[-1][0] + window - 1, *out[-1][2:])
        elif not out or start + n > end:  # a window across the end of the factor, or beyond it
            skip = max(0, end - start) if out else 0
            out.append((start + skip, n - skip + window - 1, source, start + skip + shift))
            end = start + n
    return out


def removed_words(found: list[dict], n_words: int, window: int) -> np.ndarray:
    """True for each word of a factor."""
    delta = np.zeros(n_words + 1, dtype=np.int64)
    for start, words, _, _ in parse(found, window):
        delta[start] += 1
        delta[start + words] -= 1
    return np.cumsum(delta[:-1]) > 0


def _with_factors(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """All columns of docs, and last what was found of each."""
    i, t, r = (fresh(docs, x) for x in ("factor_id", "factor_tie", "factor_runs"))
    found = _lookups(docs, id_col, text_col, window).select(F.col("doc_id").alias(i), F.col("tie").alias(t), F.col("found").alias(r))
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(t)), "left").drop(i, t)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, n_words, source, source_start: the factors of every document, in words from 0. Rows of one id and text share theirs."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(x, window) for x in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made]))
            flat = [y for x in made for y in x]
            columns = [pa.array([y[k] for y in flat], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, batch.column(0).type), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], ["doc_id", "start", "n_words", "source", "source_start"])

    found = _lookups(docs, id_col, text_col, window).select("doc_id", "found")
    return found.mapInArrow(run, f"doc_id {id_type}, start int, n_words int, source {id_type}, source_start int")


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the words kept, joined by one space."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes split at space and \t-\r only
                n_words.append(len(words))
                if found:
                    gone = removed_words(found, len(words), window)
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return _with_factors(docs.select(id_col, text_col), id_col, text_col, window).mapInArrow(digest, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the words of repeats taken out of the text, the rest joined by one space; texts without any stay as they are."""
    rows = packed(docs, text_col).withColumn("doc_id", F.col("rest").getField(id_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, found in enumerate(batch.column(2).to_pylist()):
                if found:
                    words = texts[i].encode().split()
                    gone = removed_words(found, len(words), window)
                    texts[i] = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type)], ["rest", "text"])

    found = _with_factors(rows, "doc_id", "text", window).drop("doc_id")
    return unpacked(found.mapInArrow(cut, rows.select("rest", "text").schema), docs, text_col)
