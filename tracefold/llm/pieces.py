"""Byte-level BPE without a match per pre-token in Python: boundaries in numpy, merges once per distinct pre-token.

The split is that of the byte-level pre-tokeniser ('s 't 're 've 'm 'll 'd, an optional space before letters, before
numbers or before other signs, white space short of the last before a word). Boundaries come from the classes of
neighbouring code points; each distinct pre-token's ids come from the tokenizers library once and are kept by
its 64-bit hash and length, up to MOST_KEPT per Python worker.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata

import numpy as np

from tracefold.llm.common import chunks, codepoints, ranges, slice_hashes

MOST_KEPT = 1_000_000
STRETCH = 1 << 21  # characters whose distinct pre-tokens are looked up together
END_ID = 0
_SAFE = re.compile(r"[A-Za-z.,] [A-Za-z]")
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = _SPACE
    return out


_class_table: list[np.ndarray] = []


def boundaries(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of the joined texts."""
    if not _class_table:
        _class_table.append(_classes())
    n = len(cp)
    kind = _class_table[0][cp]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[text_starts] = True
    text_start[n] = True
    space = kind == _SPACE
    # a white-space character directly before a word of its own text
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~text_start[1:n]
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start |= before_word  # the last one of a run stands alone or leads the word
    lead = before_word & (cp == 32)
    led = np.zeros(n, dtype=bool)
    led[1:] = lead[:-1]
    start &= ~led
    # contractions, where the apostrophe starts a pre-token
    quote = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~text_start[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    if len(quote):
        a = cp[quote + 1]
        one = np.isin(a, [115, 116, 109, 100])
        third = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~text_start[np.minimum(quote + 2, n)], cp[third], 0)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for hits, length in ((quote[one], 2), (quote[two], 3)):
            start[hits + 1] = False
            after = hits + length
            after = after[after < n]
            start[after[~led[after]]] = True
    return np.flatnonzero(start)


class PieceTable:
    """Ids of pre-tokens by hash, made once per distinct pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_re = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def rows(self, keys: np.ndarray, piece) -> np.ndarray:
        """Rows of the table for distinct sorted keys; piece(i) is the text of the i-th."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > MOST_KEPT and len(self.keys):
                self.clear()
                return self.rows(keys, piece)
            found = [x.ids for x in self.tokenizer.encode_batch_fast([piece(i) for i in new], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, np.fromiter((x for y in found for x in y), dtype=np.uint32, count=int(lengths.sum()))])
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.starts = np.insert(self.starts, where, starts)
            self.lengths = np.insert(self.lengths, where, lengths)
            at = np.searchsorted(self.keys, keys)
        return at


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def plain_parts(texts: list[str], table: PieceTable) -> tuple[list[str], list[int], list[tuple[int, int, int]]]:
    """Texts cut at special strings: (parts, text of each part, (text, parts before it, id) of each special string)."""
    if table.special_re is None or not any(table.special_re.search(x) for x in texts):
        return texts, list(range(len(texts))), []
    parts, owner, special = [], [], []
    for i, text in enumerate(texts):
        at = 0
        for m in table.special_re.finditer(text):
            parts.append(text[at : m.start()])
            owner.append(i)
            special.append((i, len(parts), table.special[m[0]]))
            at = m.end()
        parts.append(text[at:])
        owner.append(i)
    return parts, owner, special


def pretokens(texts: list[str]):
    """(string, starts, ends, hashes, index of the text of each pre-token) of chunks of the texts."""
    for joined, owner, lengths in chunks(texts, _SAFE, STRETCH):
        if not joined:
            continue
        cp = codepoints(joined)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        starts = boundaries(cp, bounds[:-1][lengths > 0])
        ends = np.append(starts[1:], len(cp))
        yield joined, starts, ends, slice_hashes(cp, starts, ends), owner[np.searchsorted(bounds, starts, side="right") - 1]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids (uint32) of each text as the library's encode(text, add_special_tokens=False) gives them."""
    table = piece_table(path)
    parts, owner, special = plain_parts(texts, table)
    pieces: list[list[np.ndarray]] = [[] for _ in parts]
    for joined, starts, ends, hashes, of in pretokens(parts):
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        rows = table.rows(keys, lambda i: joined[starts[first[i]] : ends[first[i]]])
        lengths = table.lengths[rows][inverse]
        ids = table.ids[ranges(table.starts[rows][inverse], lengths)]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        texts_here, begin = np.unique(of, return_index=True)
        for i, a, b in zip(texts_here.tolist(), cuts[begin].tolist(), [*cuts[begin[1:]].tolist(), len(ids)], strict=True):
            pieces[i].append(ids[a:b])
    joined_parts = [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, dtype=np.uint32) for x in pieces]
    if not special:
        return joined_parts
    out: list[list[np.ndarray]] = [[] for _ in texts]
    marks = {before: token for _, before, token in special}
    for k, part in enumerate(joined_parts):
        out[owner[k]].append(part)
        if k + 1 in marks:
            out[owner[k]].append(np.array([marks[k + 1]], dtype=np.uint32))
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint32) for x in out]
