import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.cases import documents, empty, rows_of
from tracefold.llm import audio, jaccard, licenses, packing, pieces, sentencepieces, substring, token_counts, token_shards


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pieces.default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


@pytest.mark.parametrize("most", [0, 10, 500_000])
def test_token_counts(spark, ids, most):
    df = documents(spark)
    got = Counter(map(tuple, token_counts.count_tokens(df, most_broadcast=most).collect()))
    assert got == Counter((i, len((t or "").encode()), len(ids(t))) for i, t in rows_of(df))


def test_packing(spark, ids):
    df = documents(spark)
    want = Counter((i, len(ids(t)) + 1, crc([*ids(t), 0])) for i, t in rows_of(df))
    got = packing.pack(df, group_docs=40).collect()
    assert {r.doc_tokens for r in got} == {n for _, n, _ in want}
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens) == Counter({k: v for k, v in want.items() if k[1] <= 1024})
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(n * c for (_, n, _), c in want.items())


def test_first_fit_decreasing_is_that_of_a_scan():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100):
        sizes = rng.integers(1, 101, n)
        bins, _ = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= sizes[i]
            assert bins[i] == k


def test_token_shards(spark, ids):
    df = documents(spark)
    shards = token_shards.write_shards(df, token_shards.shards_directory(df), docs_per_shard=30)
    got = sorted(token_shards.read_shards(shards).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids(t)) + 1, crc([*ids(t), 0])) for i, t in rows_of(df))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    readers = [token_shards.ShardReader(r.path) for r in shards.orderBy("shard").collect()]
    by_id = defaultdict(list)
    for i, t in rows_of(df):
        by_id[i].append([*ids(t), 0])
    for i in [0, 57, 2004, 4009, 4010, None, -5, 999_999]:
        found = [x.tolist() for reader in readers for x in reader.get(i)]
        assert sorted(found) == sorted(by_id.get(i, []))


def test_shard_blocks_share_prefixes(tmp_path):
    with open(tmp_path / "x.sst", "wb") as sink:
        writer = token_shards.ShardWriter(sink, 2, block_bytes=64)
        for i in range(500):
            writer.add(i - 100, np.arange(i % 7, dtype=np.uint32))
        writer.close()
    reader = token_shards.ShardReader(str(tmp_path / "x.sst"))
    assert reader.blocks > 10 and reader.entries == 500
    assert [k for k, _ in reader] == list(range(-100, 400))
    assert all(reader.get(i)[0].tolist() == list(range((i + 100) % 7)) for i in range(-100, 400, 13)) and reader.get(400) == []


def test_audio_round_trip(spark, tmp_path):
    df = documents(spark)
    stored = audio.store_audio(df, str(tmp_path / "audio"))
    assert {p.name for p in (tmp_path / "audio").iterdir()} == {"media", "pcm"}
    got = audio.pcm_features(stored).collect()
    want = Counter()
    for i, t in rows_of(df):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert {r.feature.split(";")[0] for r in got} == set(audio.FORMS)
    held = {(r.doc_id, r.media_sha256): r for r in stored.collect()}
    for r in got:  # features by hand from what is stored
        pcm = np.frombuffer(held[r.doc_id, r.media_sha256].pcm, dtype="<i2").astype(int).tolist()
        rms = int((sum(x * x for x in pcm) / len(pcm)) ** 0.5)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        assert r.feature == f"{held[r.doc_id, r.media_sha256].form};samples={len(pcm)};rms={rms};peak={max(map(abs, pcm))};crossings={crossings}"


def test_resampling_is_a_sum_over_neighbours():
    rng = np.random.default_rng(1)
    pcm = rng.integers(-20000, 20000, 50).astype(np.int16)
    taps = [np.sinc(k - audio.TAPS // 2 + 0.5) * (0.54 - 0.46 * np.cos(2 * np.pi * k / audio.TAPS)) for k in range(audio.TAPS)]
    padded = [0] * (audio.TAPS // 2) + pcm.tolist() + [0] * (audio.TAPS // 2)
    got = audio.resample(pcm, 2, 1)
    for i in range(50):
        want = sum(t / sum(taps) * padded[i + audio.TAPS - 1 - k] for k, t in enumerate(taps))
        assert abs(got[2 * i + 1] - max(-32768, min(32767, want))) <= 1 and got[2 * i] == pcm[i]


def test_stored_pcm_is_small_and_comes_back():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, 640, dtype=np.uint8)
    for base in (audio.TABLES["mulaw"][codes], audio.TABLES["alaw"][codes], audio.decode_adpcm(codes.reshape(10, 64)).reshape(-1)):
        pcm = audio.resample(base, 2, 1)
        stored = audio.pack_pcm(pcm)
        assert (audio.unpack_pcm(stored) == pcm).all() and len(stored) <= 5 + len(pcm)
        pcm[7] -= 3  # no longer what the filter gives
        assert (audio.unpack_pcm(audio.pack_pcm(pcm)) == pcm).all()
    for n in (0, 1, 2, 5, 64, 1001):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        assert (audio.unpack_pcm(audio.pack_pcm(pcm)) == pcm).all()


def test_samples_at_an_end_of_the_range_are_stored_alike():
    random.seed(3)
    loud = np.array([random.choice((32767, -32768, 100 * k)) for k in range(300)], dtype=np.int16)
    kind, stored = audio._differences(loud)
    assert kind == 3 and set(stored[(loud == 32767) | (loud == -32768)].tolist()) == {257, -257}
    for samples in (loud, loud[:1], loud[:0], np.array([0, 257, 514, 32767, 32510, -32768], dtype=np.int16), np.array([-32768, 32767, -32768, 5, 5], dtype=np.int16)):
        assert (audio._summed(*audio._differences(samples)) == samples).all()
        assert (audio.unpack_pcm(audio.pack_pcm(audio.resample(samples, 2, 1))) == audio.resample(samples, 2, 1)).all()
    assert audio._differences(np.array([0, 257, 514], dtype=np.int16))[0] == 2
    text = b"words and words of a text, " * 64
    blocks = np.frombuffer(audio.encode_payload(text[:1664], "adpcm")[-1768:], dtype=np.uint8).reshape(-1, 68)
    assert audio._differences(audio.decode_adpcm(blocks).reshape(-1))[0] == 3


def test_audio_tables_and_adpcm():
    assert audio.TABLES["mulaw"][[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert audio.TABLES["alaw"][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 20), dtype=np.uint8)
    got = audio.decode_adpcm(blocks)
    for row, block in zip(got, blocks, strict=True):
        value, index = struct.unpack("<h", block[:2].tobytes())[0], min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
                want.append(value)
        assert row.tolist() == want
    tone = (8000 * np.sin(np.arange(800) * 2 * np.pi * 300 / 8000)).astype(np.int16)
    assert np.array_equal(audio.resample(tone, 2, 1)[::2], tone)


def test_sentencepieces(spark):
    df = documents(spark)
    one = sentencepieces.encode(df)
    decoded = sentencepieces.decode(one).select("doc_id", "text", "pieces", "decoded", "row").collect()
    assert all(r.decoded == (r.text or "") and r.row == "clash" for r in decoded)
    trips = sentencepieces.round_trips(df).collect()
    assert all(r.lossless for r in trips)
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_sha256) for r in trips) == Counter((r.doc_id, len(r.pieces), crc(r.pieces), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in decoded)
    again = sentencepieces.encode(df.repartition(2))
    key = lambda x: Counter((r.doc_id, r.text, tuple(r.pieces)) for r in x.select("doc_id", "text", "pieces").collect())
    assert key(one) == key(again) != key(sentencepieces.encode(df, seed=5))


def test_sampled_segmentations_follow_their_weights():
    import math

    import sentencepiece

    path = sentencepieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def all_of(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            i = sp.piece_to_id(rest[:n].replace(" ", "▁"))
            if i != sp.unk_id():
                for more, w in all_of(rest[n:]):
                    yield (i, *more), w - 0.3 * math.log(2 - sp.get_score(i))

    weights = {k: math.exp(w) for k, w in all_of(" then")}
    n = 20_000
    ids, counts = sentencepieces.sample_pieces(["then"] * n, np.arange(n, dtype=np.uint64), path, alpha=0.3)
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True))
    total = sum(weights.values())
    for k, w in weights.items():
        assert abs(seen[k] / n - w / total) < 0.015


@pytest.mark.parametrize("text", ["thenwithoutanyspace" * 9, "a" + " " * 40 + "b", "x" * 70 + "yz"])
def test_segmentations_of_long_units(text):
    """How often a piece ends at each character, against sums over all segmentations; beyond 64 characters and in runs of spaces."""
    import math

    import sentencepiece

    path = sentencepieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).replace("▁", " "): -math.log(2 - sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    full = f" {text}"
    longest = max(map(len, pieces))

    def sums(t):
        out = [1.0] + [0.0] * len(t)
        for e in range(1, len(t) + 1):
            out[e] = sum(out[s] * math.exp(0.3 * pieces[t[s:e]]) for s in range(max(0, e - longest), e) if t[s:e] in pieces)
        return out

    fore = sums(full)
    back = [1.0] + [0.0] * len(full)  # of the ends of the text
    for n in range(1, len(full) + 1):
        s = len(full) - n
        back[n] = sum(back[n - k] * math.exp(0.3 * pieces[full[s : s + k]]) for k in range(1, min(longest, n) + 1) if full[s : s + k] in pieces)
    want = [fore[i] * back[len(full) - i] / fore[-1] for i in range(len(full) + 1)]
    n = 3000
    ids, counts = sentencepieces.sample_pieces([text] * n, np.arange(n, dtype=np.uint64), path, alpha=0.3)
    seen = np.zeros(len(full) + 1)
    ends = np.cumsum(counts)
    for e, c in zip(ends, counts, strict=True):
        at = 0
        for i in ids[e - c : e].tolist():
            at += len(sp.id_to_piece(i))
            seen[at] += 1
    got = seen / n
    got[0] = 1
    assert max(abs(g - w) for g, w in zip(got, want, strict=True)) < 0.06


def jaccard_by_hand(rows, k, t):
    sets = []
    for _, text in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "t", "pairs"), [(3, Fraction(9, 10), 8), (5, Fraction(4, 5), 0), (2, Fraction(1, 2), 0)])
def test_near_duplicates(spark, monkeypatch, k, t, pairs):
    if not pairs:  # rounds of leaders even where there are few pairs
        monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", -1_000_000)
    df = documents(spark)
    got = Counter(map(tuple, jaccard.near_duplicates(df, k=k, similarity=t, most_frequent=50).collect()))
    assert got == jaccard_by_hand(rows_of(df), k, t)


def test_a_family_around_the_threshold(spark):
    """Copies of one text with a few words changed each: their lists are long, and about half of the pairs are links."""
    random.seed(5)
    base = [f"w{random.randrange(5000)}" for _ in range(150)]
    rows = [(4, None)]
    for i in range(60):
        own = list(base)
        for at in random.sample(range(150), random.randint(1, 5)):
            own[at] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5))):
        want = jaccard_by_hand(rows, k, t)
        assert Counter(map(tuple, jaccard.near_duplicates(df, k=k, similarity=t).collect())) == want
        assert 2 < len({c for _, _, c in want}) < 50


def test_leaders_are_central_members(spark, monkeypatch):
    """Most of a family differs too much from one another, but not from its few members with the fewest changes."""
    random.seed(11)
    base = [f"w{random.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in random.sample(range(150), 1 if i % 20 == 0 else random.randint(3, 5)):
            own[at] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    left, every = [], jaccard._all_pairs

    def counted(*args):
        got = every(*args)
        left.append(got.count())
        return got

    monkeypatch.setattr(jaccard, "_all_pairs", counted)
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", -1_000_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, jaccard.near_duplicates(df, k=5, similarity=Fraction(4, 5)).collect()))
    assert got == jaccard_by_hand(rows, 5, Fraction(4, 5))
    assert left[0] < 800  # of 79,800


def test_few_pairs_left_need_no_second_round(spark, monkeypatch):
    """Near copies of which hardly any two link: a second round of leaders would cost as much as the first and find nothing."""
    random.seed(12)
    base = [f"w{random.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(200):
        own = list(base)
        for at in random.sample(range(150), 1 if i % 50 == 0 else random.randint(3, 6)):
            own[at] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rounds, lead = [], jaccard._leader_pairs

    def counted(*args):
        rounds.append(args[-1])
        return lead(*args)

    monkeypatch.setattr(jaccard, "_leader_pairs", counted)
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", -1_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, jaccard.near_duplicates(df, k=3, similarity=Fraction(9, 10)).collect()))
    assert got == jaccard_by_hand(rows, 3, Fraction(9, 10))
    assert rounds == [0]


def test_keys_that_stand_for_several_values_are_told_apart(spark):
    df = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (1, 7, 2), (1, 8, 3), (0, 7, 9)], "n int, v long, second long")
    got = [r.v for r in jaccard._told_apart(df, "v", "second")(df).where("n > 0").orderBy("second").collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and got[3] == 8 and 7 not in got


def test_signatures_differ_in_no_more_bits_than_sets_in_shingles():
    words = [f"w{i}" for i in range(60)]
    texts = ["", "one", " ".join(words), " ".join(words[:30] + ["new"] + words[31:]), " ".join(words[:10] * 200), " ".join(f"x{i}" for i in range(3000))]
    ((_, values, bounds),) = jaccard.shingle_sets(texts, 3)
    sets = [set(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    bits = [sum((x & (1 << 64) - 1) << 64 * i for i, x in enumerate(row)) for row in zip(*(x.to_pylist() for x in jaccard._signatures(values, bounds)), strict=True)]
    assert bits[0] == 0
    for x, p in zip(sets, bits, strict=True):
        for y, q in zip(sets, bits, strict=True):
            assert (p ^ q).bit_count() <= len(x ^ y)
    assert len(sets[2] ^ sets[3]) == 6 and (bits[2] ^ bits[3]).bit_count() in (2, 4, 6)


def test_substring(spark):
    df = documents(spark)
    rows = rows_of(df)
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for s in range(len(w) - 19):
            place = (doc is None, doc or 0, s)
            first[tuple(w[s : s + 20])] = min(place, first.get(tuple(w[s : s + 20]), place))
    want = Counter()
    for doc, text in rows:
        w = words_of(text)
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (doc is None, doc or 0, s):
                gone |= set(range(s, s + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring.dedup_digests(df).collect())) == want
    assert sum(n for _, _, n, _ in want.elements()) > 500
    cut = substring.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    words = {doc: words_of(text) for doc, text in rows}
    made = substring.factors(df).where("doc_id is not null and source is not null and doc_id < 4009").collect()
    for x in made:  # each is a copy of what stands at its source
        assert (x.source, x.source_start) < (x.doc_id, x.start) and x.n_words >= 20
        assert words[x.doc_id][x.start : x.start + x.n_words] == words[x.source][x.source_start : x.source_start + x.n_words]
    assert {x.doc_id for x in made} >= set(range(1000, 1010)) & {d for (d, _, n, _) in want if n}


def test_factors_are_greedy_and_checked_at_their_ends():
    row = lambda start, n, source, at: {"start": start, "n": n, "bits": 0, "source": source, "shift": at - start}
    assert substring.parse([]) == []
    bits = {"start": 10, "n": 0, "bits": 0b1011_0110 - (1 << 63), "source": 4, "shift": -5}
    assert substring._spans([bits]) == [(11, 2, 4, -5), (14, 2, 4, -5), (17, 1, 4, -5), (73, 1, 4, -5)]
    assert substring.parse([row(5, 1, 1, 9), row(3, 1, 1, 7), row(4, 1, 1, 8)]) == [(3, 22, 1, 7)]
    assert substring.parse([row(3, 4, 1, 7), row(7, 1, 2, 0), row(30, 1, 1, 34)]) == [(3, 23, 1, 7), (7, 20, 2, 0), (30, 20, 1, 34)]
    assert substring.parse([row(3, 4, 1, 7), row(5, 4, 2, 0)]) == [(3, 23, 1, 7), (7, 21, 2, 2)]


def test_substring_of_long_and_periodic_texts(spark):
    random.seed(3)
    long = [f"v{random.randrange(10**6)}" for _ in range(90_000)]  # over a chunk of characters
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_060])), (3, "same " * 21), (4, "a b c " * 9), (5, " ".join(long[:19])), (6, " ".join([*long[89_950:], *long[:50]]))]
    got = {r.doc_id: r.n_removed for r in substring.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: 0, 2: 60, 3: 20, 4: 24, 5: 0, 6: 100}


def test_licenses(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    texts = {1: "Released CC BY 4.0 and cc-by again", 2: f"x {mit} y", 3: mit.replace("any", "any single"), 4: None, 5: "", 6: "ALL RIGHTS RESERVED. All rights, reserved", 7: "rights all reserved general license public", 8: "GNU General Public License"}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, label int")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "cc-by")
    assert got[2].labels == got[3].labels == "mit" and got[2].score == 1.0 and 0.6 < got[3].score < 1 and got[2].n_base == 0
    assert (got[4].n_words, got[4].n_base, got[4].labels, got[4].score, got[4].first_word) == (0, 0, "", 0.0, None) == (got[5].n_words, got[5].n_base, got[5].labels, got[5].score, got[5].first_word)
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 0, 3) and got[7].n_base == 0 and got[8].base_labels == "gpl"


def test_license_passages_stand_in_order(spark):
    passages = sorted(licenses.PASSAGES)
    texts = {n: f"Some words first. {p} and some after" for n, p in enumerate(passages)}
    turned = {}  # every passage with its words in another order: pairs of words change places
    for n, p in enumerate(passages):
        w = p.split()
        turned[100 + n] = " ".join(x for i in range(0, len(w), 4) for x in (*w[i + 2 : i + 4], *w[i : i + 2]))
    names = {200 + n: f"it is {p.upper()}." for n, p in enumerate(sorted(licenses.NAMES))}
    others = {
        300: "This work is licensed under the GNU General Public License, version 2.",
        301: "Licensed under CC BY 4.0",
        302: "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        303: " ".join(["free of charge to any person"] * 2000),
        304: passages[0] + " " + " ".join(f"w{i}" for i in range(50)) + " " + passages[0],
    }
    rows = [(k, v, "own") for k, v in (texts | turned | names | others).items()]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    for n, p in enumerate(passages):
        label = licenses.PASSAGES[p]
        assert label in got[n].labels.split(",") and got[n].score == 1.0
        assert f"{label}:3-{2 + len(p.split())}" in got[n].spans.split(",")
        assert (got[100 + n].labels, got[100 + n].spans) == ("", ""), turned[100 + n]
    for n, p in enumerate(sorted(licenses.NAMES)):
        assert licenses.NAMES[p] in got[200 + n].labels.split(",")
    assert got[300].labels == "gpl,gpl-2.0" and got[301].labels == "cc-by" and got[302].labels == "apache-2.0" and got[303].labels == ""
    label, size = licenses.PASSAGES[passages[0]], len(passages[0].split())
    assert got[304].spans == f"{label}:0-{size - 1},{label}:{size + 50}-{2 * size + 49}"


def test_licenses_count_only_words_in_order(spark):
    """Two words moved behind the next two vote on diagonals near the others, but lie behind them."""
    words = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer".split()
    moved = [*words[:4], *words[6:8], *words[4:6], *words[8:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved))], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    in_text = sum(moved[i : i + 2] in [words[j : j + 2] for j in range(len(words) - 1)] for i in range(len(moved) - 1))
    assert got[1].score == 1.0 and got[2].score < in_text / (len(words) - 1) and got[2].labels == "bsd"


def test_empty_tables(spark):
    df = empty(spark)
    assert token_counts.count_tokens(df).count() == 0
    assert packing.pack(df).count() == 0
    assert token_shards.read_shards(token_shards.write_shards(df, token_shards.shards_directory(df))).count() == 0
    assert audio.pcm_features(audio.expand_media(audio.store_payloads(df))).count() == 0
    assert sentencepieces.decode(sentencepieces.encode(df)).count() == 0
    assert jaccard.near_duplicates(df).count() == 0
    assert substring.dedup_digests(df).count() == 0
    assert licenses.scan(df).count() == 0
