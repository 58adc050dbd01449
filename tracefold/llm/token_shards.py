"""Token ids in sorted-string-table shards: written by key range, read back by block, looked up by binary search.

File: blocks, index, Bloom filter, footer. An entry of a block is varint(shared), varint(unshared), varint(value
bytes), unshared key bytes, value; keys share prefixes with the one before, and a block starts with a whole key. A key
is \\x00 for a null id, else \\x01 and the id as 8 big-endian bytes with the sign bit flipped, so byte order is id
order. A value is the document's ids with the end id, in 2 or 4 little-endian bytes each as the footer says. The
sparse index has (first key, offset, size) of every block; the footer is of fixed size.

Shards are the partitions of a range partitioning by (id), written as a stream with one block and the index in memory.
A task writes under a name of its own, and only names of tasks that ended are in the table of shards, so a task that
runs twice does no harm. Files go through Arrow's filesystems (local, HDFS, S3) to the shared folder.

Null texts are empty documents; null ids sort first; repeated ids are entries of their own, in the order of their
texts; a long text is one entry, whole in memory while it is written; an empty table gives no rows; other columns, also of names
used here, play no part.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches, mix, scratch, scratch_dir
from tracefold.llm.pieces import END_ID, default_tokenizer, encode, piece_table

BLOCK_BYTES = 1 << 16
DOCS_PER_SHARD = 8192
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MAGIC = b"TFSST001"
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, size; bloom at, size; entries, blocks; bytes an id, hashes; magic


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def bloom_bits(keys: list[bytes], bits: int) -> np.ndarray:
    """Positions of each key's bits, a row per key, by double hashing."""
    base = mix(np.array([int.from_bytes(k[-8:], "big") ^ len(k) for k in keys], dtype=np.uint64))
    step = mix(base) | np.uint64(1)
    return (base[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.entries = 0
        self.block, self.last = bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.first: bytes | None = None
        self.keys: list[bytes] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        if len(self.block) >= self.block_bytes:
            self.end_block()

    def end_block(self) -> None:
        if self.first is not None:
            self.sink.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block)))
            self.at += len(self.block)
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self.end_block()
        index = b"".join(varint(len(k)) + k + struct.pack("<QQ", at, size) for k, at, size in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_PER_KEY // 8) * 8)
        mask = np.zeros(bits, dtype=bool)
        if self.keys:
            mask[bloom_bits(self.keys, bits).ravel()] = True
        bloom = np.packbits(mask).tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, len(self.index), self.width, BLOOM_HASHES, MAGIC)
        self.sink.write(index + bloom + footer)
        self.sink.close()


class ShardReader:
    """Reads a shard by its footer; blocks are read one at a time."""

    def __init__(self, path: str):
        filesystem, name = fs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(name)
        self.file.seek(self.file.size() - FOOTER.size)
        at, size, bloom_at, bloom_size, self.entries, self.blocks, self.width, _, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.file.seek(at)
        raw, pos = self.file.read(size), 0
        self.index: list[tuple[bytes, int, int]] = []
        while pos < size:
            n, pos = read_varint(raw, pos)
            key, pos = raw[pos : pos + n], pos + n
            self.index.append((key, *struct.unpack_from("<QQ", raw, pos)))
            pos += 16
        self.file.seek(bloom_at)
        self.bloom = np.unpackbits(np.frombuffer(self.file.read(bloom_size), dtype=np.uint8)).astype(bool)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[k]
        self.file.seek(at)
        raw, pos, key = self.file.read(size), 0, b""
        while pos < size:
            shared, pos = read_varint(raw, pos)
            unshared, pos = read_varint(raw, pos)
            length, pos = read_varint(raw, pos)
            key = key[:shared] + raw[pos : pos + unshared]
            pos += unshared
            yield key, np.frombuffer(raw, dtype=f"<u{self.width}", count=length // self.width, offset=pos)
            pos += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of the key: none, one, or more if the id repeats."""
        key = key_of(doc_id)
        if not self.index or not self.bloom[bloom_bits([key], len(self.bloom))].all():
            return []
        low, high = 0, len(self.index)  # the first block whose first key is not below key
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for got, ids in self.block(k) if got == key]
        return found


def write_shards(docs: DataFrame, directory: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Writes the shards and returns their table: shard (in key order), path, n_docs, n_tokens."""
    path = tokenizer or default_tokenizer()
    bound_batches(docs)
    shards = max(1, math.ceil(docs.count() / docs_per_shard))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        tokens = 0
        shard = TaskContext.get().partitionId()
        uri = f"{directory}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        width = 2 if piece_table(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()], path), strict=True):
                if writer is None:
                    filesystem, name = fs.FileSystem.from_uri(uri)
                    filesystem.create_dir(name.rpartition("/")[0], recursive=True)
                    writer = ShardWriter(filesystem.open_output_stream(name), width)
                writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                tokens += len(ids) + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [writer.entries], "n_tokens": [tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return scratch(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids before it over all shards), n_tokens, ids_crc32 of every entry, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, ids in ShardReader(uri):
                    for k, v in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        out[k].append(v)
                    start += len(ids)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    based = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return based.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shards_directory(docs: DataFrame) -> str:
    return f"{scratch_dir(docs.sparkSession)}/sst-{uuid.uuid4().hex}"
