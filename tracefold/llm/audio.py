"""Telephony audio columns: bytes in mu-law, A-law or ADPCM form, expanded to 16-bit PCM and resampled.

`store_audio` writes both as tables. `store_payloads` keeps each text's bytes as the samples of a WAV file (mu-law and A-law: a byte a sample; IMA ADPCM:
two 4-bit samples a byte, in blocks of 64 bytes behind a 4-byte block header); `expand_media` reads the stored files
back and gives resampled PCM, `pcm_features` what the stored PCM holds. mu-law and A-law expand by tables of 256 values; ADPCM decodes one
step of all blocks of a batch at a time, so the loop is as long as a block and not as the audio.

Null texts are empty (64 zero bytes are stored); texts of any length are one file each; repeated rows keep their own, equal values; an empty table gives no
rows; other columns play no part. The form of a payload follows from its bytes, so equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracefold.llm.common import bound_batches

UNIT = 64
RATE, RESAMPLED_RATE = 8000, 16000
FORMS = {"mulaw": 7, "alaw": 6, "adpcm": 17}  # WAV format tags
TAPS = 16
BLOCKS_AT_ONCE = 1 << 15
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(1 << 23)}
STORED_PCM = STORED | {"parquet.compression.codec.zstd.level": "12"}

# Fixed values of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279,
        307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment = (code & 0x70) >> 4
    size = ((code & 0x0F) << 4) + np.where(segment > 0, 0x108, 8) << np.maximum(segment - 1, 0)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16, a row per block) of IMA ADPCM blocks: little-endian predictor, step index, a spare byte, then nibbles, low first."""
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), dtype=np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[:, 0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * len(columns)):
        code = (columns[k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        change = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out


def wav(form: str, data: bytes, block: int, samples: int) -> bytes:
    bits = 4 if form == "adpcm" else 8
    extra = struct.pack("<HH", 2, samples) if form == "adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMS[form], 1, RATE, RATE * block // samples, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[str, int, memoryview]:
    """Form, bytes a block and data of a file made by `wav`."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("no WAV file")
    (size,) = struct.unpack_from("<I", media, 16)
    tag, _, _, _, block, _ = struct.unpack_from("<HHIIHH", media, 20)
    at = 20 + size
    (length,) = struct.unpack_from("<I", media, at + 4)
    return next(k for k, v in FORMS.items() if v == tag), block, memoryview(media)[at + 8 : at + 8 + length]


def encode_payload(payload: bytes, form: str) -> bytes:
    if form != "adpcm":
        return wav(form, payload, 1, 1)
    blocks = np.zeros((len(payload) // UNIT, UNIT + 4), dtype=np.uint8)
    blocks[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    return wav(form, blocks.tobytes(), UNIT + 4, 1 + 2 * UNIT)


def payload_of(form: str, block: int, data: memoryview) -> bytes:
    if form != "adpcm":
        return bytes(data)
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, block)[:, 4:].tobytes()


def _filters(up: int) -> np.ndarray:
    """A windowed-sinc filter for each phase, each of sum 1."""
    at = np.arange(TAPS) - TAPS // 2
    out = np.stack([np.sinc(at + p / up) * np.hamming(TAPS + 1)[:TAPS] if p else np.where(at == 0, 1.0, 0.0) for p in range(up)])
    return out / out.sum(axis=1, keepdims=True)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """int16 samples at up / down times the rate, by polyphase windowed-sinc filters."""
    padded = np.concatenate([np.zeros(TAPS // 2), pcm, np.zeros(TAPS // 2)])
    out = np.empty((len(pcm), up), dtype=np.int16)
    for p, taps in enumerate(_filters(up)):
        out[:, p] = pcm if p == 0 else np.clip(np.rint(np.convolve(padded, taps, "valid")[: len(pcm)]), -32768, 32767)
    return np.ascontiguousarray(out.reshape(-1)[::down])


def features_of(form: str, pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt(float((wide * wide).sum()) / max(1, len(pcm))))
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm))))
    return f"{form};samples={len(pcm)};rms={rms};peak={int(np.abs(wide).max(initial=0))};crossings={crossings}"


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text: its UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    forms = list(FORMS)
    bound_batches(docs)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                payload = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
                sizes.append(len(raw))
                media.append(encode_payload(payload, forms[zlib.crc32(payload) % len(forms)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, f"doc_id {id_type}, n_bytes long, media binary")


def decoded(files: list[bytes]) -> Iterator[tuple[int, str, bytes, np.ndarray]]:
    """(index, form, payload, PCM at RATE) of each file; ADPCM blocks of many files are decoded together."""
    waiting: list[tuple[int, bytes, np.ndarray]] = []

    def together() -> Iterator[tuple[int, str, bytes, np.ndarray]]:
        if waiting:
            pcm, at = decode_adpcm(np.concatenate([x[2] for x in waiting])), 0
            for i, payload, blocks in waiting:
                yield i, "adpcm", payload, pcm[at : at + len(blocks)].reshape(-1)
                at += len(blocks)
            waiting.clear()

    size = 0
    for i, media in enumerate(files):
        form, block, data = parse_wav(media)
        payload = payload_of(form, block, data)
        if form == "adpcm":
            waiting.append((i, payload, np.frombuffer(data, dtype=np.uint8).reshape(-1, block)))
            size += len(waiting[-1][2])
            if size >= BLOCKS_AT_ONCE:
                yield from together()
                size = 0
        else:
            yield i, form, payload, TABLES[form][np.frombuffer(payload, dtype=np.uint8)]
    yield from together()


def expand_media(media: DataFrame) -> DataFrame:
    """Reads the stored files back: digests, form and resampled PCM (int16, little-endian)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            out: list = [None] * len(files)
            for i, form, payload, pcm in decoded(files):
                out[i] = {
                    "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                    "media_bytes": len(files[i]), "media_sha256": hashlib.sha256(files[i]).hexdigest(), "form": form, "pcm": resample(pcm, RESAMPLED_RATE // RATE, 1).astype("<i2").tobytes(),
                }
            made = pa.Table.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(x.combine_chunks() for x in made.columns)], ["doc_id", "n_bytes", *made.column_names])

    names = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "form": "string", "pcm": "binary"}
    schema = pa.schema([(k, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[v]) for k, v in names.items()])
    id_type = media.schema["doc_id"].dataType.simpleString()
    bound_batches(media)
    return media.mapInArrow(expand, f"doc_id {id_type}, n_bytes long, " + ", ".join(f"{k} {v}" for k, v in names.items()))


def pcm_features(expanded: DataFrame) -> DataFrame:
    """Reads stored PCM back: the other columns, and `feature` instead of the PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, pcm = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            made = [features_of(f, np.frombuffer(p, dtype="<i2")) for f, p in zip(form, pcm, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made, pa.string())], [*batch.schema.names[:-2], "feature"])

    bound_batches(expanded)
    kept = expanded.drop("form", "pcm")
    return expanded.select(*kept.columns, "form", "pcm").mapInArrow(run, StructType([*kept.schema.fields, StructField("feature", StringType())]))


INVERSE = {form: np.full(1 << 16, -1, dtype=np.int16) for form in TABLES}
for _form, _table in TABLES.items():
    INVERSE[_form][_table.astype(np.int32) + 32768] = np.arange(256)


ENDS = {32767: 257, -32768: -257}  # differences that stand for a sample at an end of the range; no step of ADPCM is that


def _differences(samples: np.ndarray) -> tuple[int, np.ndarray]:
    """(kind, int16): differences modulo 2**16, of kind 3 with those to a sample at an end, where loud ADPCM mostly is, as ENDS; of kind 2 if those occur themselves."""
    plain = np.diff(samples, prepend=np.int16(0))
    high, low = samples == 32767, samples == -32768
    if (((plain == ENDS[32767]) | (plain == ENDS[-32768])) & ~(high | low)).any():
        return 2, plain
    return 3, np.where(high, np.int16(ENDS[32767]), np.where(low, np.int16(ENDS[-32768]), plain))


def _summed(kind: int, differences: np.ndarray) -> np.ndarray:
    """The samples of `_differences`."""
    if kind == 2:
        return np.cumsum(differences, dtype=np.int16)
    high, low = differences == ENDS[32767], differences == ENDS[-32768]
    fixed = high | low
    sums = np.cumsum(np.where(fixed, np.int16(0), differences), dtype=np.int16)
    start = np.where(high, np.int16(32767), np.int16(-32768)) - sums  # modulo 2**16, as all here
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(sums)), -1))
    return sums + np.where(last >= 0, start[last], np.int16(0)) if len(sums) else sums


def pack_pcm(pcm: np.ndarray) -> bytes:
    """Any int16 samples without loss, from the samples alone: a byte of kinds, a checksum, every other sample, and what the rest differ from the resampling filter.

    The former are codes of a table if all stand in it, else differences; the latter are left out only if all are zero.
    """
    base, rest = pcm, b""
    doubled = len(pcm) % 2 == 0
    if doubled:
        base = np.ascontiguousarray(pcm[::2])
        differ = pcm - resample(base, 2, 1)  # modulo 2**16
        rest = differ[1::2].astype("<i2").tobytes() if differ.any() else b""
    for kind, form in enumerate(TABLES):
        codes = INVERSE[form][base.astype(np.int32) + 32768]
        if (codes >= 0).all():
            data = codes.astype(np.uint8).tobytes()
            break
    else:
        kind, differences = _differences(base)
        data = differences.astype("<i2").tobytes()
    return struct.pack("<BI", kind | doubled << 2 | bool(rest) << 3, zlib.crc32(pcm.astype("<i2").tobytes())) + data + rest


def unpack_pcm(stored: bytes) -> np.ndarray:
    """The samples of `pack_pcm`."""
    kinds, checksum = struct.unpack_from("<BI", stored)
    data = stored[5:]
    rest = b""
    if kinds & 8:
        cut = len(data) // 3 if kinds & 3 < len(TABLES) else len(data) // 2
        data, rest = data[:cut], data[cut:]
    form = [*TABLES, None, None][kinds & 3]
    base = TABLES[form][np.frombuffer(data, dtype=np.uint8)] if form else _summed(kinds & 3, np.frombuffer(data, dtype="<i2").astype(np.int16))
    pcm = resample(base, 2, 1) if kinds & 4 else base
    if rest:
        pcm[1::2] += np.frombuffer(rest, dtype="<i2")
    if zlib.crc32(pcm.astype("<i2").tobytes()) != checksum:
        raise ValueError("stored PCM does not come back as it was")
    return pcm


def _recoded(expanded: DataFrame, code: Callable[[bytes], bytes]) -> DataFrame:
    """The table with another form of its last column, the PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([code(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())], batch.schema.names)

    bound_batches(expanded)
    return expanded.mapInArrow(run, expanded.schema)


def store_audio(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the audio files of all texts and their resampled PCM (without loss, see `pack_pcm`) as Parquet under a path, and reads the PCM's table back."""
    spark = docs.sparkSession
    media = store_payloads(docs, id_col, text_col)
    media.write.options(**STORED).parquet(f"{path}/media")
    expanded = expand_media(spark.read.schema(media.schema).parquet(f"{path}/media"))
    _recoded(expanded, lambda x: pack_pcm(np.frombuffer(x, dtype="<i2"))).write.options(**STORED_PCM).parquet(f"{path}/pcm")
    return _recoded(spark.read.schema(expanded.schema).parquet(f"{path}/pcm"), lambda x: unpack_pcm(x).astype("<i2").tobytes())
