"""What several operators share: tables, scratch tables, and hashing of code points in numpy.

Scratch tables are those of `tracefold.storage`: Parquet under ``spark.checkpoint.dir``, a folder that every executor and the
driver reach. ``storage.dropped_at_the_end`` removes them when a result has been written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.names import every, fresh  # noqa: F401
from tracefold.storage import dropped  # noqa: F401
from tracefold.storage import shared_dir as scratch_dir  # noqa: F401
from tracefold.storage import written as scratch  # noqa: F401

CHUNK_CHARS = 1 << 19
WORD_SPACE = "\x20\x09-\x0D"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_cached: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(df: DataFrame, most_bytes: int = 1 << 23) -> None:
    """Keeps the Arrow batches that a task holds at once to a size, whatever the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most_bytes:
        conf.set(name, f"{most_bytes}b")


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """(rest, text): all other columns in one struct, so that names in it, with dots or like those of an operator, meet no other."""
    others = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    return docs.select((F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("rest"), docs[f"`{text_col}`"].alias("text"))


def unpacked(got: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of docs from `packed` ones."""
    return got.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... of each length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least n powers of the odd multiplier modulo 2**64, or of its inverse."""
    key = f"powers{inverse}"
    if key not in _cached or len(_cached[key]) < n:
        base = pow(int(_MULTIPLIER), -1, 1 << 64) if inverse else int(_MULTIPLIER)
        size = (n + n // 8 >> 16) + 1 << 16
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        _cached[key] = np.multiply.accumulate(factors)
    return _cached[key][:n]


def codepoint_hashes() -> np.ndarray:
    """A 64-bit value for each code point."""
    if "cp" not in _cached:
        _cached["cp"] = mix(np.arange(0x110000, dtype=np.uint64) * _MULTIPLIER + np.uint64(12345))
    return _cached["cp"]


def prefix_sums(cp: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(codepoint_hashes()[cp] * powers(len(cp)), out=prefix[1:])
    return prefix


def slice_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of cp[start:end] for each pair, from one prefix sum of a polynomial modulo 2**64.

    Coefficients are random 64-bit values of the code points. Distinct slices collide with a chance of about 2**-64.
    """
    if prefix is None:
        prefix = prefix_sums(cp)
    return mix((prefix[ends] - prefix[starts]) * powers(len(cp) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def chunks(texts: list[str], safe: re.Pattern, most: int | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts joined into strings of about `most` characters, CHUNK_CHARS if not given: (string, index of each text's part, length of each part).

    A longer text is cut where `safe` matches, at the match's start + 1, or stays whole if it never matches.
    """
    most = most or CHUNK_CHARS
    part: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            found = safe.search(text, at + most // 2)
            if not found:
                break
            part.append(text[at : found.start() + 1])
            owner.append(i)
            yield "".join(part), np.array(owner), np.array([len(x) for x in part])
            at, part, owner, size = found.start() + 1, [], [], 0
        part.append(text[at:] if at else text)
        owner.append(i)
        size += len(part[-1])
        if size >= most:
            yield "".join(part), np.array(owner), np.array([len(x) for x in part])
            part, owner, size = [], [], 0
    if part:
        yield "".join(part), np.array(owner), np.array([len(x) for x in part])


_SAFE_WORD = re.compile(rf"[^{WORD_SPACE}][{WORD_SPACE}]")


def word_hashes(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other than space and \\t-\\r) of all texts, and the number of words of each.

    lower: A-Z count as a-z. Work is in chunks, so memory follows the number of words and not of characters.
    """
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for joined, owner, lengths in chunks(texts, _SAFE_WORD):
        cp = codepoints(joined)
        if lower:
            cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        solid = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = bounds[1:-1]
        inner = inner[inner < len(cp)]
        first[inner] |= solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        prev = inner[inner > 0] - 1
        last[prev] |= solid[prev]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        out.append(slice_hashes(cp, starts, ends))
        np.add.at(counts, owner, np.diff(np.searchsorted(starts, bounds)))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes (across texts too: the caller picks those inside one)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(len(words)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(n, inverse=True) + np.uint64(k))


def portions(texts: list[str], most_chars: int) -> Iterator[slice]:
    """Slices of the texts of about most_chars each; a longer text is one of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most_chars:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))
