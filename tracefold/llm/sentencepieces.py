"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and their decoding.

A text with a space before it is cut into units where no piece can lie across: before each space that follows another
character. A unit is any number of spaces and what follows up to the next one, of any length. Over a unit's characters the pieces of
the model form a lattice, with byte pieces for characters it lacks. The forward pass sums, in logarithms, the weights of
all segmentations of each beginning, once per distinct unit; the backward pass draws one segmentation per occurrence from its
end, with numbers that are a hash of (seed, row key, place of the unit, step). So the same row gets the same pieces on any
cluster and partitioning, and no state is kept. Both passes run in numpy over all units of a stretch of text at once; they take
a step for each character of the longest unit, so text without spaces costs time in proportion to its length, and nothing else.

Weights are `alpha` times the log-probability of a piece. The default model was made by byte-pair encoding: its scores are ranks
and no probabilities, so they count as -log(2 + rank), Zipf's rule. Pieces with a space after another character would lie
across units and aren't used; the default model has none. A literal U+2581 goes to byte pieces, which keeps decoding lossless.

Null texts are empty and have the one unit of a lone space; null keys count as one key; repeated rows get the same pieces;
an empty table gives no rows; other columns are kept, also those of names used here.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracefold.llm.common import bound_batches, chunks, codepoints, fresh, mix, portions, powers, prefix_sums, ranges, slice_hashes

ALPHA = 1.0
STRETCH = 1 << 21  # characters whose distinct units share one lattice pass
_SAFE = re.compile(r"[^ ] ")
_ACROSS = re.compile(r"[^ ] ")
_models: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        keys, sizes, ids, weights = [], [], [], []
        raw: list[bytes] = []
        ranks = min((sp.get_score(i) for i in range(size)), default=0.0) < -200
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                raw.append(bytes([int(piece[3:-1], 16)]))
                continue
            text = piece.replace("▁", " ")
            raw.append(text.encode())
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or not text or _ACROSS.search(text):
                continue
            cp = codepoints(text)
            keys.append(prefix_sums(cp)[-1])
            sizes.append(len(cp))
            ids.append(i)
            weights.append(-np.log(2.0 - sp.get_score(i)) if ranks else sp.get_score(i))
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path} has no byte pieces, so decoding couldn't be lossless")
        order = np.argsort(np.array(keys, dtype=np.uint64))
        self.raw_keys = np.array(keys, dtype=np.uint64)[order]
        self.sizes = np.array(sizes)[order]
        self.ids = np.array(ids, dtype=np.int32)[order]
        self.weights = np.array(weights)[order]
        self.bitmap = np.zeros(1 << 21, dtype=bool)
        self.bitmap[(self.raw_keys >> np.uint64(43)).astype(np.int64)] = True  # by the high 21 bits
        self.longest = max((len(sp.id_to_piece(int(i))) for i in ids), default=1)
        self.fallback = min(weights) - 2.0
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_lengths = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _lattice(m: Model, cp: np.ndarray, prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alpha: float) -> tuple[np.ndarray, ...]:
    """Of units: the first state of each (a state is a place in a unit); then edges, those that end in one state together:
    lengths, codes, running sum of their chances, and for each state where its edges start. Codes of byte pieces are -1
    less the code point."""
    base = np.cumsum(lengths + 1) - (lengths + 1)
    place = ranges(np.zeros(len(lengths), dtype=np.int64), lengths + 1)
    at = np.repeat(starts, lengths + 1) + place  # the character after the state
    kind = next(t for t in (np.uint8, np.uint16, np.int64) if lengths.max(initial=0) <= np.iinfo(t).max)  # small kinds sort by digits
    by_place = np.argsort(place.astype(kind), kind="stable").astype(np.int32)
    rank = np.empty(len(place), dtype=np.int32)
    rank[by_place] = np.arange(len(place), dtype=np.int32)
    raw = prefix[at]  # one lookup for each place; differences are hashes of what lies between
    scale = powers(len(cp) + 1, inverse=True)[at]
    ranks: list[np.ndarray] = []
    backs: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    before = np.concatenate([[0], np.cumsum(np.bincount(place))])  # states with a lesser place
    for n in range(1, min(m.longest, int(lengths.max(initial=1))) + 1):
        first = int(before[min(n, len(before) - 1)])
        ends = by_place[first:]
        if not len(ends):
            break
        hashes = (raw[ends] - raw[ends - n]) * scale[ends - n]
        maybe = np.flatnonzero(m.bitmap[(hashes >> np.uint64(43)).astype(np.int64)])
        row = np.minimum(np.searchsorted(m.raw_keys, hashes[maybe]), len(m.raw_keys) - 1)
        hit = (m.raw_keys[row] == hashes[maybe]) & (m.sizes[row] == n)
        found, row = maybe[hit], row[hit]
        ranks.append((found + first).astype(np.int32))
        backs.append(np.full(len(found), n, dtype=np.int32))
        rows.append(row.astype(np.int32))
        if n == 1:
            lacks = np.ones(len(ends), dtype=bool)
            lacks[found] = False
            missing = np.flatnonzero(lacks)
            ranks.append((missing + first).astype(np.int32))
            backs.append(np.ones(len(missing), dtype=np.int32))
            rows.append(np.full(len(missing), -1, dtype=np.int32))
    edge_rank, back, row = np.concatenate(ranks), np.concatenate(backs), np.concatenate(rows)
    order = np.argsort(edge_rank, kind="stable")  # a merge of the sorted parts
    state, back, row = by_place[edge_rank[order]], back[order], row[order]
    weight, code = alpha * m.weights[row], m.ids[row]
    missing = np.flatnonzero(row < 0)
    if len(missing):
        points = cp[at[state[missing]] - 1].astype(np.int64)
        weight[missing] = alpha * m.fallback * _utf8_lengths(points)
        code[missing] = (-1 - points).astype(np.int32)
    forward = np.zeros(len(place))
    head = np.flatnonzero(np.diff(state, prepend=-1))
    edge_start = np.zeros(len(place), dtype=np.int64)
    edge_start[state[head]] = head
    edge_end = np.zeros(len(place), dtype=np.int64)
    edge_end[state[head]] = np.append(head[1:], len(state))
    cuts = np.searchsorted(place[state[head]], np.arange(1, int(lengths.max(initial=0)) + 2))
    for j in range(len(cuts) - 1):
        heads = head[cuts[j] : cuts[j + 1]]
        if len(heads):
            a, b = heads[0], edge_end[state[heads[-1]]]
            reach = forward[state[a:b] - back[a:b]] + weight[a:b]
            many = np.diff(np.append(heads, b))
            top = np.maximum.reduceat(reach, heads - a)
            chance = np.exp(reach - np.repeat(top, many))
            total = np.add.reduceat(chance, heads - a)
            forward[state[heads]] = top + np.log(total)
            weight[a:b] = chance / np.repeat(total, many)
    return base, back, code, np.concatenate([[0.0], np.cumsum(weight)]), edge_start, edge_end


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _expand(m: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each code gave), with byte pieces for the negative codes."""
    many = np.ones(len(codes), dtype=np.int64)
    missing = np.flatnonzero(codes < 0)
    if not len(missing):
        return codes, many
    points = -1 - codes[missing].astype(np.int64)
    many[missing] = _utf8_lengths(points)
    ids = np.repeat(codes, many)
    at = np.cumsum(many) - many
    raw = np.frombuffer("".join(map(chr, points.tolist())).encode(), dtype=np.uint8)
    ids[ranges(at[missing], many[missing])] = m.byte_ids[raw]
    return ids, many


def sample_pieces(texts: list[str], row_keys: np.ndarray, path: str, seed: int = 0, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    m = model(path)
    seen = np.zeros(len(texts), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for joined, owner, parts in chunks([f" {x}" for x in texts], _SAFE, STRETCH):
        cp = codepoints(joined)
        bounds = np.concatenate([[0], np.cumsum(parts)])
        first = cp == 32
        first[1:] &= cp[:-1] != 32
        first[bounds[:-1]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(cp)))
        part = np.searchsorted(bounds, starts, side="right") - 1
        text = owner[part]
        number = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[part] + seen[text]  # a text cut into parts counts its units on
        seen += np.bincount(text, minlength=len(texts))
        prefix = prefix_sums(cp)
        _, head, unit = np.unique(slice_hashes(cp, starts, starts + lengths, prefix), return_index=True, return_inverse=True)
        base, back, code, running, edge_start, edge_end = _lattice(m, cp, prefix, starts[head], lengths[head], alpha)
        key = mix(row_keys[text] ^ mix(np.full(len(text), seed, dtype=np.uint64) + np.uint64(99))) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        left, state = lengths.copy(), base[unit] + lengths
        active = np.arange(len(starts))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            here = state[active]
            u = (mix(key[active] + np.uint64((len(steps) + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)).astype(np.float64) / (1 << 24)
            low, high = edge_start[here], edge_end[here]
            target = running[low] + u * (running[high] - running[low])
            edge, more = low.copy(), np.arange(len(low))
            while len(more):  # a state has few edges
                more = more[(running[edge[more] + 1] <= target[more]) & (edge[more] < high[more] - 1)]
                edge[more] += 1
            steps.append((active, code[edge]))
            state[active] -= back[edge]
            left[active] -= back[edge]
            active = active[left[active] > 0]
        count = np.bincount(np.concatenate([a for a, _ in steps]), minlength=len(starts))
        end = np.cumsum(count)
        codes = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.int32)
        for s, (a, c) in enumerate(steps):
            codes[end[a] - 1 - s] = c
        ids, many = _expand(m, codes)
        found.append((ids, np.bincount(np.repeat(text, count), weights=many, minlength=len(texts)).astype(np.int64)))
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.sum([x for _, x in found], axis=0)


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The UTF-8 text of each run of ids, without the space put before it."""
    m = model(path)
    lengths = m.raw_lengths[ids]
    raw = m.raw[ranges(m.raw_starts[ids], lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)].tolist()
    return [raw[a + 1 : b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(docs: DataFrame, model_path: str | None = None, key_col: str = "doc_id", text_col: str = "text", name: str = "pieces", seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """docs with an array of piece ids as the last column."""
    path = model_path or default_model()
    bound_batches(docs)
    columns, where = docs.columns, docs.columns.index(text_col)
    key = fresh(docs, "piece_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(len(columns)).to_numpy().view(np.uint64)
            ids, counts = sample_pieces([x or "" for x in batch.column(where).to_pylist()], keys, path, seed, alpha)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [*columns, name])

    return docs.withColumn(key, F.xxhash64(F.col(f"`{key_col}`"))).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode(pieces: DataFrame, model_path: str | None = None, pieces_col: str = "pieces", name: str = "decoded") -> DataFrame:
    """pieces with the text of the ids as the last column; null for null."""
    path = model_path or default_model()
    columns, where = pieces.columns, pieces.columns.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = [x.decode() if ok else None for x, ok in zip(decode_ids(lists.flatten().to_numpy(), counts, path), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, name])

    return pieces.mapInArrow(run, StructType([*pieces.schema.fields, StructField(name, StringType())]))


def round_trips(docs: DataFrame, model_path: str | None = None, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 and lossless: each text encoded, decoded and compared, in one pass."""
    path = model_path or default_model()
    bound_batches(docs)
    id_type = docs.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in portions(texts, STRETCH):
                own = texts[part]
                ids, counts = sample_pieces(own, batch.column(2).to_numpy()[part].view(np.uint64), path, seed, alpha)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                back = decode_ids(ids, counts, path)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(part.start, len(own)), "n_pieces": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
                        "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back], "lossless": [x == t.encode() for x, t in zip(back, own, strict=True)],
                    }
                )

    rows = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{key_col}`")).alias("key"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
