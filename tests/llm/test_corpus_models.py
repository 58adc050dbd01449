"""Source divergence, ball k-means and Order MinHash against plain forms."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tracefold.llm import ballmeans, divergence, orderhash


def plain_audit(rows, least=3, most=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), all in Python integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        counts[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in df.items()}
    out = []
    for lang in {r[1] for r in rows}:
        sources, words = sorted({r[2] for r in rows if r[1] == lang}), kept.get(lang, [])
        v = len(words)

        def share(count, words=words, v=v):
            n = sum(count[t] for t in words)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + v) for t in words}

        shares = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda p, q: (p - q) ** 2 // q
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in words), o) for o in sources if o != s]
            own = [(f(shares[s][t], whole[t]), t) for t in words if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", own, most)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def audited(df, **more):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **more).collect())


def test_divergence_against_plain_integers(spark):
    random.seed(3)
    words = ["alpha", "Beta", "BETA", "gamma", "été", "ÉTÉ", "漢字", "x1y", "don't", "_", "zz"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(40)]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 60))), random.choice(["en", "en", "de", None]), random.choice(["s0", "s0", "s1", "s2", None])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "fr", "a"), ("lonely words", "fr", "b"), ("alpha " * 5000, "en", "s1"), (rows[0]), (rows[0])]
    df = spark.createDataFrame([(t, lang, s, 1, "clash") for t, lang, s in rows], "text string, lang string, source string, term int, value string").repartition(6)
    assert audited(df) == plain_audit(rows)
    assert audited(df, least_docs=1, most_terms=5) == plain_audit(rows, 1, 5)
    fr = [r for r in audited(df) if r[0] == "fr"]
    assert fr == [("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)]
    assert audited(df.limit(0)) == []


def test_terms_of_long_texts_are_counted_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 7}x" for i in range(3000)) + "é" * 50
    df = spark.createDataFrame([(text, "en", "a"), (text, "en", "b")], "text string, lang string, source string")
    whole = sorted(map(tuple, divergence.term_counts(df).collect()), key=repr)
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "HELD", 2)
    assert sorted(map(tuple, divergence.term_counts(df).collect()), key=repr) == whole


def test_postings_emit_corrections_only(spark):
    """A term that all sources use alike changes no pair and leaves the join of postings."""
    rows = [("common words here", "en", f"s{i % 4}") for i in range(40)]
    groups, posted = divergence.postings(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert posted.count() == 12 and groups.count() == 4
    assert {r.value for r in divergence.pair_values(groups, posted).collect()} == {0}


def plain_means(vectors, k, rounds, dims, seed=2):
    q = {i: np.array([int(np.floor(256.0 * float(x))) for x in v]) for i, v in vectors}
    order = sorted(q, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [q[i] for i in order[:k]]
    for r in range(rounds + 1):
        d = {i: [int(((v - c) ** 2).sum()) for c in centroids] for i, v in q.items()}
        cluster = {i: min(range(len(x)), key=lambda j, x=x: (x[j], j)) for i, x in d.items()}
        if r < rounds:
            members = [[q[i] for i in q if cluster[i] == j] for j in range(len(centroids))]
            centroids = [np.array([int(s) // len(m) for s in np.sum(m, axis=0)]) if m else c for m, c in zip(members, centroids, strict=True)]
    return {i: (cluster[i], d[i][cluster[i]], hashlib.sha256(",".join(map(str, centroids[cluster[i]].tolist())).encode()).hexdigest()) for i in q}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_ball_means_against_plain_rounds(spark, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 8))
    vectors = [(i, (middles[i % 6] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(240)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(60)]  # ties
    odd = [(2000, None), (2001, [1.0] * 7), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, cluster long, q string").repartition(5)
    got = ballmeans.clusters(df, k=12, rounds=4, dims=8).collect()
    want = plain_means(vectors, 12, 4, 8)
    assert {r.vec_id: (r.cluster, r.distance, r.centroid_sha256) for r in got} == want
    own = Counter()
    for c, d, _ in want.values():
        own[c] += d
    assert all(r.cluster_inertia == own[r.cluster] and r.inertia == sum(own.values()) for r in got)


def test_balls_leave_out_far_neighbours():
    rng = np.random.default_rng(5)
    middles = rng.integers(-5000, 5000, size=(40, 16))
    q = np.concatenate([m + rng.integers(-20, 20, size=(50, 16)) for m in middles])
    cluster = np.repeat(np.arange(40), 50)
    radii = [float(np.sqrt(ballmeans.distances(q[cluster == i], middles[i : i + 1]).max())) for i in range(40)]
    out, best, work = ballmeans.assign(q, cluster, ballmeans.Balls(middles, radii))
    d = ballmeans.distances(q, middles)
    assert (out == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert work == len(q)  # all members are in the stable core: one distance each
    assert all(len(near) == 0 for near, _ in ballmeans.Balls(middles, radii).neighbours)


def test_ball_means_of_few_large_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5] * 4), (2, [1e30] * 4), (3, [-1e30] * 4), (3, [-1e30] * 4), (None, [0.5] * 4)], "vec_id long, embedding array<double>")
    got = ballmeans.clusters(few, k=10, dims=4).collect()
    assert len(got) == 5 and all(r.distance == 0 for r in got)
    assert ballmeans.clusters(few.limit(0), k=10, dims=4).count() == 0
    exact = ballmeans.distances(np.array([[1 << 27] * 64]), np.array([[-(1 << 27)] * 64]))
    assert exact[0, 0] == 64 << 56


def plain_fingerprint(text, k=orderhash.K, length=orderhash.LENGTH, signatures=orderhash.SIGNATURES):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def xx(values, seed=42):
        for v in values:
            raw = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little") if not isinstance(v, bool) else v
            seed = xxhash.xxh64(raw, seed=seed & (1 << 64) - 1).intdigest()
        return seed

    wide = "⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff"
    tokens = re.findall(rf"[{wide}]|[^{wide}\t-\r ]{{1,{orderhash.RUN}}}", text or "")
    grams = [tokens[i : i + k] for i in range(len(tokens) - k + 1)] if len(tokens) >= k else [tokens] if tokens else []
    seen, elements = Counter(), []
    for place, g in enumerate(grams):
        h = xx(g) >> 31
        seen[h] += 1
        number = xxhash.xxh64(seen[h].to_bytes(4, "little"), seed=xx([h])).intdigest()
        elements.append((number >> 31, place))
    if not elements:
        return [0] * signatures
    elements.sort()
    span, out = (1 << 33) // signatures, []
    for i in range(signatures):
        turned = sorted(elements, key=lambda e: ((e[0] - i * span) % (1 << 33), e[1]))[:length]
        out.append(signed(xx([h for h, _ in sorted(turned, key=lambda e: (e[1], e[0]))])) & 0x7FFFFFFF)
    return out


def test_fingerprints_against_a_plain_form(spark):
    random.seed(6)
    words = [f"word{i}" for i in range(60)]
    texts = [None, "", "  ", "one", "one two", "one two three", "same " * 200, "漢字かな交じり文を繰り返す漢字かな", "x" * 500, " ".join(random.choices(words, k=2500))]
    texts += [" ".join(random.choices(words, k=n)) for n in (3, 5, 9, 20, 60, 200, 700)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, fp_tokens int")
    for p in ({}, {"k": 3, "length": 3, "signatures": 20}, {"k": 1, "length": 1, "signatures": 7}):
        got = {r.id: r.fp for r in orderhash.fingerprint(df, "text", "fp", **p).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain_fingerprint(t, **p), (i, p)


def test_fingerprints_follow_order_and_edits(spark):
    random.seed(7)
    words = [f"w{random.randrange(10**6)}" for _ in range(400)]
    texts = [words, words[:300] + [f"n{i}" for i in range(100)], words[200:] + words[:200], [x for i in range(0, 400, 4) for x in words[i : i + 4][::-1]], [f"o{i}" for i in range(400)]]
    rows = orderhash.fingerprint(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string"), "text", "fp").orderBy("id").collect()
    like = [sum(a == b for a, b in zip(rows[0].fp, r.fp, strict=True)) / 64 for r in rows]
    assert like[0] == 1 and like[1] > 0.25 and like[4] == 0
    assert 0.2 < like[2] < 0.9  # the same k-mers but two halves swapped: a plain MinHash would give 1
    assert like[3] < like[1]


def test_edits_take_the_next_document(spark):
    docs = cases.documents(spark)
    got = orderhash.fingerprints_of_edits(docs)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    texts = defaultdict(set)
    for i, t in set(rows):
        texts[i].add(t)
    single = {i: next(iter(t)) for i, t in texts.items() if len(t) == 1 and i is not None}
    order = sorted({i for i in texts if i is not None}, reverse=True)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        at = order.index(r.doc_id) if r.doc_id in single else -1
        if at < 0 or at + 1 >= len(order) or order[at + 1] not in single:
            continue  # null ids and ids of several texts are ordered by a hash
        text, following = single[r.doc_id], single[order[at + 1]]
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, nxt = (plain_fingerprint(t) for t in (text, edited, following))
        assert r.fingerprint == "".join(f"{x:08x}" for x in own) and r.edited_fingerprint == "".join(f"{x:08x}" for x in other)
        assert r.near_edited == sum(map(int.__eq__, own, other)) / 64 and r.near_next == sum(map(int.__eq__, own, nxt)) / 64
    assert orderhash.fingerprints_of_edits(cases.empty(spark)).count() == 0
    lone = orderhash.fingerprints_of_edits(docs.where("doc_id = 5")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_fingerprints_use_functions_only(spark):
    plan = orderhash.fingerprints_of_edits(cases.documents(spark).withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
