"""Lookup of ids in several shards against all entries read in turn."""

import random

import pyarrow as pa

from tracefold.llm import shard_lookup, token_shards
from tracefold.llm.pieces import END_ID, default_tokenizer, encode


def entries(rows):
    ids = encode([t or "" for _, t in rows], default_tokenizer())
    return sorted(((k, [*map(int, x), END_ID]) for (k, _), x in zip(rows, ids, strict=True)), key=repr)


def test_lookup_over_shards(spark, tmp_path):
    draw = random.Random(4)
    rows = [(k * 7 - 900, f"text {k} " * draw.randrange(0, 9)) for k in range(400)]
    rows += [(7 * 30 - 900, "again"), (7 * 30 - 900, None), (None, "no id"), (None, ""), (2**63 - 1, "last"), (-(2**63), "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = token_shards.write_shards(docs, str(tmp_path / "sst"), docs_per_shard=40)
    assert shards.count() > 4
    some = [k for k, _ in rows if k is None or draw.random() < 0.4] + [7 * 30 - 900, 2**63 - 1, -(2**63)]
    absent = [4, -5000, 10**12, 2]
    wanted = spark.createDataFrame([(k, "x") for k in [*some, *some, *absent]], "id long, path string")
    got = shard_lookup.lookup(shards, wanted, "id").collect()
    want = entries([(k, t) for k, t in rows if k in set(some)])
    assert sorted(((r.doc_id, list(r.ids)) for r in got if r.entry is not None), key=repr) == want
    assert sorted(r.doc_id for r in got if r.entry is None) == sorted(absent) and all(r.n_tokens is None and r.ids is None for r in got if r.entry is None)
    assert sorted(r.entry for r in got if r.doc_id == 7 * 30 - 900) == [0, 1, 2] and all(r.n_tokens == len(r.ids) for r in got if r.ids is not None)
    assert shard_lookup.lookup(shards, wanted.limit(0), "id").count() == 0
    none = shards.limit(0)
    assert {(r.doc_id, r.entry) for r in shard_lookup.lookup(none, wanted.where("id = 4"), "id").collect()} == {(4, None)}


def test_long_answers_come_in_batches(tmp_path, monkeypatch):
    from pyarrow import fs

    import numpy as np

    monkeypatch.setattr(shard_lookup, "MOST_IDS", 50)
    name = str(tmp_path / "x.sst")
    writer = token_shards.ShardWriter(fs.LocalFileSystem().open_output_stream(name), 2, block_bytes=64)
    for k in range(30):
        writer.add(k, np.arange(k, dtype=np.uint32))
    writer.close()
    asked = pa.RecordBatch.from_pydict({"id": list(range(35)), "path": [name] * 35})
    out = list(shard_lookup._found(iter([asked])))
    assert len(out) > 5 and [x for b in out for x in b.column(2).to_pylist()] == [*range(30), *[None] * 5]
