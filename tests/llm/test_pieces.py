import random

import numpy as np
import pytest

from tracefold.llm import common, pieces

BITS = ["'", "'s", "'re", "'ll", "'x", " ", "  ", "\n", "\t", "a", "b", "é", "1", "²", "٣", "中", "一", "!", "?", "<|endoftext|>", "　", "\xa0", "\x1c", "\x85", "▁", "😀", "​", "re", "ll", "Word"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pieces.default_tokenizer())


def test_ids_are_the_librarys(tokenizer):
    random.seed(3)
    texts = ["", *("".join(random.choice(BITS) for _ in range(random.randint(0, 20))) for _ in range(5000))]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in pieces.encode(texts, pieces.default_tokenizer())] == want


def test_long_texts_are_cut_safely(tokenizer, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 50)
    text = "It's a long text, isn't it?  Yes\nwe'll see 123 things. " * 40
    assert pieces.encode([text], pieces.default_tokenizer())[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_table_may_fill_up(tokenizer, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KEPT", 5)
    table = pieces.PieceTable(pieces.default_tokenizer())
    monkeypatch.setitem(pieces._tables, pieces.default_tokenizer(), table)
    texts = ["one two three", "four five six seven", "eight nine ten one"]
    assert [x.tolist() for x in pieces.encode(texts, pieces.default_tokenizer())] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_hashes_split_at_ascii_white_space_only():
    texts = ["a b\tc", "", "  x  ", "a b a b", "A a"]
    hashes, counts = common.word_hashes(texts, lower=True)
    assert counts.tolist() == [3, 0, 1, 2, 2]
    assert hashes[4] == hashes[5] and hashes[6] == hashes[7] == hashes[0]
    grams = common.gram_hashes(np.concatenate([hashes[:3], hashes[:3]]), 3)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3
