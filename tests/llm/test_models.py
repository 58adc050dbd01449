"""Search, toxicity and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import documents, empty
from tracefold.llm import components, mtree, toxicity


def brute(rows, k):
    out = set()
    sound = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {i: min(w for j, w in sound if j == i) for i, _ in sound if i % 10 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize(("n", "dim", "tree"), [(300, 8, 50), (40, 3, 4096), (700, 2, 300)])
def test_top_k(spark, n, dim, tree):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in (rng.normal(size=dim) * (3 if i % 7 else 0.1) if i % 4 else np.ones(dim))]) for i in range(n)]  # a quarter of one vector
    rows += [(n + 1, None), (n + 2, [1.0, None, *[0.0] * (dim - 2)]), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim), (None, [1.0] * dim), (n * 10, [0.5] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, pivot string").repartition(4)
    got = mtree.top_k(df, df.where("vec_id % 10 = 0"), k=5, tree_size=tree, query_block=7).collect()
    assert {tuple(r) for r in got} == brute(rows, 5) and len(got) == len(brute(rows, 5))
    assert mtree.top_k(df.limit(0), df, k=5).count() == 0


def test_top_k_of_more_lengths_than_pivots(spark):
    draw = random.Random(5)
    rows = [(n * 3 + i, [draw.uniform(-1, 1) for _ in range(n)]) for n in range(1, 301) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 3 = 0").unionByName(spark.createDataFrame([(5000, [0.5] * 400)], df.schema))
    got = mtree.top_k(df, asked, k=2, most_pivots=4, tree_size=2)
    by = {r.vec_id: [int(np.floor(1024 * x)) for x in r.embedding] for r in df.collect()}
    want = set()
    for n in range(1, 301):
        scores = sorted((-sum(a * b for a, b in zip(by[3 * n], by[3 * n + i], strict=True)), 3 * n + i) for i in (1, 2))
        want |= {(3 * n, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def test_top_k_of_empty_and_large_vectors(spark):
    """Empty vectors meet each other with score 0; sums beyond a long count as its end, ties to the smaller id."""
    rows = [(0, []), (1, []), (2, []), (10, [4e6, 0.0]), (11, [4e6, 1.0]), (12, [4e6, 4e6]), (13, [-4e6, 0.0]), (14, [1e300, 1.0]), (15, [1.0, 2.0]), (16, None), (17, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id in (0, 10, 15)"), k=3).collect()}
    end = (1 << 63) - 1
    whole = {i: [int(np.floor(max(-(2.0**62), min(2.0**62, 1024.0 * x)))) for x in v] for i, v in rows if i in range(10, 16)}
    want = {(0, 1, 1, 0), (0, 2, 2, 0)}
    for q in (10, 15):
        found = sorted((-max(-end - 1, min(end, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:3]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)}
    assert got == want and any(s == end for *_, s in got)


def test_a_tree_skips_most_of_clustered_data():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 1000 + rng.normal(size=(4000, 16))).astype(np.int64)
    m2 = int((vectors**2).sum(axis=1).max())
    import pandas as pd

    tree = mtree.Tree(pd.DataFrame(mtree.build_pages(np.arange(4000), vectors, m2)), m2)
    scores = vectors @ vectors[0]
    want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != 0))[:10]
    assert tree.search(0, vectors[0], 10, None) == [(-s, i) for s, i in want]
    assert tree.computed < 2000


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {v: find(v) for v in root}
    got = {r.v: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: c for v, c in want.items() if any(v in x for x in links if x[0] != x[1] and x[0] is not None)}


def toxic_table(spark, n=900):
    random.seed(4)
    words = [f"{a}{b}{c}" for a in "blorn trea wist" .split() for b in "aeiou" for c in ("n", "st", "m", "rd")]
    rows, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randint(20, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(random.randint(2, 5)):
                text[random.randrange(len(text))] = random.choice(["vilescum", "grubber", "grubby", "slobhead", "sl0bhead", "you vilescum"])
        rows.append((i, " ".join(text) + ".", "en", "s", len(" ".join(text))))
        labels.append((i, int(bad), 1, "clash"))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "you grubber", "en", "s", 1)]
    labels += [(n, None, 1, "x"), (None, 1, 1, "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, kind).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int, score string")


def test_toxicity(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    clean = toxicity.keep_clean(docs.withColumn("features", F.lit("clash")), labels)
    assert clean.columns == [*docs.columns, "features"] and 700 < clean.count() < 800
    odd = docs.withColumns({"toxicity_score": F.lit(0.9), "score": F.lit("s"), "rest": F.lit(1), "a.b": F.lit("dot"), "features_raw": F.lit(2)})
    again = toxicity.keep_clean(odd, labels)
    assert again.columns == odd.columns and again.count() == clean.count() and again.select("toxicity_score", "score", "rest", "`a.b`").distinct().collect() == [(0.9, "s", 1, "dot")]
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_features_by_hand():
    from tracefold.llm.common import codepoints, slice_hashes

    keys = slice_hashes(codepoints("idiot"), np.zeros(1, dtype=np.int64), np.array([5]))
    row = dict(zip(toxicity.FEATURES, toxicity.text_features(["YOU are an 1d10t! Idiot??", ""], keys, np.array([5.0]))[0], strict=True))
    assert row["hits_share"] == 2 / 5 and row["near_second"] == 2 / 5 and row["second_share"] == 1 / 5 and row["disguised_hits"] == np.log1p(1)
    assert row["shouted"] == 1 / 5 and row["exclamations"] == 1 / 25 and row["obfuscated"] == 1 / 5
    assert not toxicity.text_features([""], keys, np.array([5.0])).any()


def features_by_hand(text, weights):
    disguise = dict(zip("013457@$", "oieastas", strict=True))
    small = text.lower()
    words, at = [], 0
    solid = lambda x: x.isalpha() or x in "0123456789@$"
    while at < len(text):
        end = at
        while end < len(text) and solid(text[end]):
            end += 1
        if any(x.isalpha() for x in text[at:end]):
            words.append((at, end))
        at = max(end, at + 1)
    weight = [weights.get("".join(disguise.get(x, x) for x in small[a:b]), 0.0) for a, b in words]
    you = [small[a:b] in toxicity.SECOND_PERSON for a, b in words]
    odd = [any(not x.isalpha() for x in text[a:b]) for a, b in words]
    hit = [w > 0 for w in weight]
    upper = [x.isalpha() and x != y for x, y in zip(text, small, strict=True)]
    n, chars, letters = max(1, len(words)), max(1, len(text)), max(1, sum(x.isalpha() for x in text))
    near = sum(h and any(you[max(0, i - 4) : i + 5]) for i, h in enumerate(hit))
    strong = sum(w > toxicity.STRONG for w in weight)
    return [
        np.log1p(len(words)), sum(hit) / n, np.log1p(sum(hit)), sum(weight) / n, near / n, sum(you) / n, np.log1p(sum(h and o for h, o in zip(hit, odd, strict=True))), sum(upper) / letters,
        sum(b - a > 2 and all(upper[a:b]) for a, b in words) / n, text.count("!") / chars, text.count("?") / chars, sum(not x.isalpha() and ord(x) > 32 and x not in "0123456789" for x in text) / chars,
        sum(odd) / n, sum(small[i].isalpha() and small[i] == small[i - 1] == small[i - 2] for i in range(2, len(text))) / chars, np.log1p(strong), strong / n,
    ]


def test_features_by_hand_in_any_batch():
    from tracefold.llm.common import codepoints, slice_hashes

    weights = {"grubber": 5.0, "toad": 3.0, "straße": 2.5}
    hashes = {w: slice_hashes(codepoints(w), np.zeros(1, dtype=np.int64), np.array([len(w)]))[0] for w in weights}
    keys = np.array(sorted(hashes.values()), dtype=np.uint64)
    values = np.array([weights[w] for w in sorted(hashes, key=hashes.get)])
    random.seed(2)
    parts = ["you", "are", "Grubber", "t0ad", "TOAD", "Straße", "aaa", "!!", "??", "x1y", "so", "a", "ti", "vous", "SHOUT", "12", "é", "..."]
    texts = ["", "grubber aa", "are you ", "aa b", "aaa", "a", "you", *(" ".join(random.choice(parts) for _ in range(random.randrange(30))) for _ in range(300)), "grubber", "you", "grubber", ("toad and more " * 50_000)]
    want = np.array([features_by_hand(t, weights) for t in texts])
    for _ in range(3):
        order = list(range(len(texts)))
        random.shuffle(order)
        got = toxicity.text_features([texts[i] for i in order], keys, values)
        assert np.allclose(got, want[order], atol=1e-12)
        assert (got[[order.index(i) for i, t in enumerate(texts) if t == "grubber"]] == got[order.index(texts.index("grubber"))]).all()


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_pipeline_stages(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("row"), F.lit(2).alias("a.b"), F.lit(3).alias("rest"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    before = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda x: (x[0] is None, x[0] or 0))
    sets = [shingles(t, 5) for _, t in before]
    group = list(range(len(before)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if x == group[i] else x for x in group]
    want = Counter(before[i][0] for i, g in enumerate(group) if g not in group[:i])  # the least id of each group
    assert Counter(i for i, _ in rows) == want and len(set(rows)) == len(rows) and set(rows) <= set(before)
    assert {(4010, "shared id first"), (4010, "shared id second one"), (None, None), (4000, None)} <= set(rows)
    cut = corpus_pipeline.cut_repeats(spark, kept, "")
    assert cut.columns == docs.columns and cut.count() == len(rows) and cut.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, cut, "")
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(i for i, _ in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]
    nothing = empty(spark).select(*docs.columns[:4], F.lit(0).cast("long").alias("n_chars"))
    assert corpus_pipeline.cut_repeats(spark, corpus_pipeline.drop_near_copies(spark, nothing, ""), "").count() == 0


def test_pipeline_runs(spark, tmp_path):
    docs, labels = toxic_table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) < 0.05 * len(toxic) and len(ids) > 700
