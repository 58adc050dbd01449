"""N-gram Jaccard join: a grouped prefix join on sets of word shingles, to components of linked documents.

A set's shingles are ordered by (frequent or not, frequency, hash). If two sets have similarity t or more, they share at
least SHARED shingles (all, if they are smaller) among the first n - ceil(t n) + SHARED of each. Frequent shingles
(those that repeat within a stretch of text, at most `most_frequent` of them, the most frequent ones) come last and so
out of nearly all prefixes. Any order gives the same links; this one keeps the posting lists short.

1. Documents with one set are one vertex. Vertices with the same prefix and size are one group.
2. Groups meet at shared prefix shingles. In a round of leaders every group meets only LEADERS of each posting list
   and size band, and every member those of its group, which is linear; pairs that share enough of their prefixes are
   verified on whole sets. Links found contract to components. There is no such round if the pairs are few anyway (up to
   PAIRS_PER_POSTING for each posting), else two at least, and another one while the last has taken a tenth of the pairs left.
   But no more once the pairs left are so few (PAIRS_OF_A_ROUND) that comparing them in the last join costs less than a round.
   Each leader is the most central of an eighth of its list, drawn by a hash: the one with most of its prefix in lists,
   that is, with the fewest shingles of its own. A leader drawn by the hash alone may link with hardly any other of its family.
3. The last round meets all groups of a list, unless all their members are of one component, expands the pairs of
   groups that share enough to members of different components, and verifies them. So no link between components is lost,
   and a group of near copies costs no square.
   A pair of groups leaves the join of lists about once, however many shingles they share, and only if it may be a link:
   - at the first shingle that both share, what follows in either set must still reach the similarity (positions);
   - a row is dropped if the EARLIER prefix shingles before it already meet, as the pair leaves at one of those;
   - signatures, SIGNATURE bits with the parity of the shingles that fall on each, of sets that differ in d shingles differ
     in d bits at most. A group of several members has the signature of one and the radius of the others around it.
   The pairs left count what their prefixes share before any member is expanded.
4. Documents get the least id of their component.

Whole sets are made only for vertices of a pair to verify; a bitmap of at most BITMAP_BITS bits, broadcast, keeps other
texts from being read into sets (if it fills up, more texts are, with the same result).
Shingles are told apart by 64-bit hashes. So are sets and groups at first; the few whose digests meet by chance, seen by a second
digest, go by that instead.

Texts that are null or without words have an empty set, link with nothing, and are their own component. Texts of fewer
words than the shingle are one shingle. Null ids take no part in the least id of a component, and a component of null ids
alone has null. Repeated rows are copies of one another, and different texts under one id are documents of that id each. Texts of any
length are whole sets; a stretch of them is in memory at once. Other columns, also of names used here, play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches, dropped, gram_hashes, mix, portions, scratch, word_hashes
from tracefold.llm.components import components

MOST_FREQUENT = 1_000_000
MOST_ROUNDS = 4
LEADERS = 3  # of each posting list in a round
DRAWN = 8  # of so many candidates one is drawn, and the most central of the drawn leads
LITTLE = 0.9  # a round that leaves more of the pairs is the last, from the second on
PAIRS_PER_POSTING = 8
PAIRS_OF_A_ROUND = 10_000_000  # a round is dozens of jobs, whatever it finds; so many pairs are seconds of one core in the join of lists
STRETCH = 1 << 23  # characters within which a repeated shingle counts as frequent
SHARED = 4
BITMAP_BITS = 1 << 24
SIGNATURE = 256  # bits; a multiple of 64
BITS = [f"b{i}" for i in range(SIGNATURE // 64)]
EARLIER = ["p0", "p1"]  # of a posting, the prefix shingles just before it


def shingle_sets(texts: list[str], k: int, most: int = STRETCH // 4) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, shingles, bounds) of stretches of texts: sorted distinct hashes of each text."""
    for part in portions(texts, most):
        words, counts = word_hashes(texts[part], lower=True)
        grams = gram_hashes(words, k)
        ends = np.cumsum(counts).tolist()
        sets, at = [], 0
        for end in ends:
            n = end - at
            if n >= k:
                values = np.sort(grams[at : end - k + 1])
                new = np.ones(len(values), dtype=bool)
                np.not_equal(values[1:], values[:-1], out=new[1:])
                sets.append(values[new])
            elif n:
                sets.append(mix(gram_hashes(words[at:end], n)))
            else:
                sets.append(grams[:0])
            at = end
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        yield part.start, np.concatenate(sets) if sets else grams[:0], bounds


def frequent_shingles(docs: DataFrame, text_col: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks by rising frequency) of at most `most` shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, _ in shingle_sets([x or "" for x in batch.column(0).to_pylist()], k, STRETCH):
                keys, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    counts = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = scratch(counts, "shingles")
    step = F.floor(F.log2("n") * 8).cast("int")
    kept, least = 0, 1 << 30
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 64 * 8 rows
        if kept + row["count"] > most:
            break
        kept, least = kept + row["count"], row["step"]
    got = counts.where(step >= least).toArrow()  # at most `most` rows of 16 bytes
    keys, n = (got[c].to_numpy().astype(np.int64) for c in ("shingle", "n"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    ranks = np.empty(len(keys), dtype=np.uint32)
    ranks[np.lexsort((keys, n))] = np.arange(1, len(keys) + 1, dtype=np.uint32)
    return keys[order], ranks[order]


def _digests(values: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit digest of each set, by its sum and size."""
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values + np.uint64(salt)), out=prefix[1:])
    return mix(mix(prefix[bounds[1:]] - prefix[bounds[:-1]]) + np.diff(bounds).astype(np.uint64))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """For each set the parity of its shingles on SIGNATURE bits, a column for each 64 of them."""
    out = np.zeros((len(bounds) - 1, len(BITS)), dtype=np.int64)
    for a in range(0, len(out), 4096):  # bounded, however many short texts there are
        b = min(a + 4096, len(out))
        owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        bit = (values[bounds[a] : bounds[b]] >> np.uint64(32)).astype(np.int64) % SIGNATURE
        odd = (np.bincount(owner * SIGNATURE + bit, minlength=(b - a) * SIGNATURE) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd, bitorder="little").view("<i8").reshape(b - a, -1)
    return [pa.array(np.ascontiguousarray(x)) for x in out.T]


def _ranks(values: np.ndarray, keys: np.ndarray, ranks: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The rank of each frequent shingle, 0 for others; the bitmap of the keys' low bits spares most lookups."""
    out = np.zeros(len(values), dtype=np.uint32)
    maybe = np.flatnonzero(bitmap[values & np.uint64(len(bitmap) - 1)])
    if len(maybe):
        at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
        out[maybe] = np.where(keys[at] == values[maybe], ranks[at], 0)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: Fraction | float = Fraction(4, 5), most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; documents link at |A and B| >= similarity |A or B|."""
    ratio = Fraction(similarity).limit_denominator(1000)
    num, den = ratio.numerator, ratio.denominator
    bound_batches(docs)
    keys, ranks = frequent_shingles(docs, text_col, k, most_frequent)
    shared = docs.sparkSession.sparkContext.broadcast((keys, ranks))
    id_type = docs.schema[id_col].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        bitmap = np.zeros(1 << 24, dtype=bool)
        bitmap[keys & np.uint64(len(bitmap) - 1)] = True
        for batch in batches:
            for first, values, bounds in shingle_sets([x or "" for x in batch.column(1).to_pylist()], k):
                sizes = np.diff(bounds)
                least = -(-sizes * num // den)  # ceil(t n): what a partner shares at least
                length = np.where(sizes > 0, sizes - least + np.minimum(SHARED, least), 0)
                rank = _ranks(values, keys, ranks, bitmap)
                chosen = []
                for a, b, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), length.tolist(), strict=True):
                    common = rank[a:b]
                    got = values[a:b][common == 0][:p]
                    if len(got) < p:
                        often = np.flatnonzero(common)
                        got = np.concatenate([got, values[a:b][often[np.argsort(common[often])[: p - len(got)]]]])
                    chosen.append(got)
                prefix = np.concatenate(chosen) if chosen else values[:0]
                offsets = np.concatenate([[0], np.cumsum(length)])
                group = _digests(prefix, offsets, 3) ^ mix(sizes.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(_digests(values, bounds, 1).view(np.int64)), pa.array(group.view(np.int64)),
                        pa.array(_digests(values, bounds, 2).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(prefix.view(np.int64))), *_signatures(values, bounds),
                    ],
                    ["doc_id", "n", "v", "group", "second", "prefix", *BITS],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = scratch(rows.mapInArrow(prefixes, f"doc_id {id_type}, n long, v long, `group` long, second long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)), "prefixes")
    of_set = _told_apart(found, "v", "second")
    of_group = _told_apart(found, "group", "n", "get(prefix, 0)", "get(prefix, size(prefix) - 1)")
    found = of_group(of_set(found)).drop("second")
    some = found.where("n > 0")
    vertices = scratch(some.groupBy("v").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "group", *BITS))), "vertices")
    groups = some.groupBy("group").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))
    earlier = [F.get("prefix", F.col("i") - 1 - k).alias(p) for k, p in enumerate(EARLIER)]
    postings = groups.select("group", "n", "prefix", F.posexplode("prefix").alias("i", "shingle")).select("group", "n", "i", "shingle", *earlier)
    met = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    lists = scratch(postings.withColumn("met", met).where("met > 1"), "lists")
    n_postings, between = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("met") - 1) / 2), F.lit(0.0))).collect()[0]
    links = labels = None
    few, before = PAIRS_PER_POSTING * n_postings + 1_000_000, float("inf")
    for turn in range(MOST_ROUNDS + 1):
        state = vertices if labels is None else vertices.join(labels, "v", "left")
        state = state.select("v", "n", "group", *BITS, (F.col("v") if labels is None else F.coalesce("component", "v")).alias("component"))
        state = scratch(state, "state")
        spread = scratch(_spread(state), "spread")
        left = _pairs_inside(spread) + (between if labels is None else _pairs_between(lists, spread))
        last = turn == MOST_ROUNDS or left <= few + (turn and PAIRS_OF_A_ROUND) or turn > 1 and left > LITTLE * before
        before = left
        made = _all_pairs(lists, some, state, spread, num, den, labels is None) if last else _leader_pairs(lists, state, spread, num, den, turn)
        pairs = scratch(made, "pairs")
        dropped(state, spread)
        if last:
            dropped(lists)
        new = scratch(_verified(pairs, vertices, rows, of_set, k, num, den), "verified")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            labels = components(links)
        if last:
            break
    return _labelled(found.select("doc_id", "n", "v"), labels)


def _told_apart(rows: DataFrame, key: str, *by: str) -> Callable[[DataFrame], DataFrame]:
    """Gives rows another key, a hash of key and `by`, where the key stands for several values of `by`."""
    other = F.xxhash64(F.col(key), *map(F.expr, by))
    mixed = rows.where("n > 0").groupBy(key).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo <> hi")
    keys = [r[0] for r in mixed.select(key).collect()]  # chance meetings of 64-bit digests: about ten of 2 * 10^10 documents
    return lambda rows: rows.withColumn(key, F.when(F.col(key).isin(keys), other).otherwise(F.col(key))) if keys else rows


def _differing(x: list[str], y: list[str]) -> str:
    return "(" + " + ".join(f"bit_count({a} ^ {b})" for a, b in zip(x, y, strict=True)) + ")"


def _spread(state: DataFrame) -> DataFrame:
    """Of each group: least and largest component, members, and a signature with the radius of its members around it."""
    one = F.struct(*(F.col(b) for b in BITS))
    spread = state.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), F.min_by(one, "v").alias("x"))
    spread = spread.select("group", "lo", "hi", "members", *(F.col(f"x.{b}").alias(b) for b in BITS))
    centre = spread.where("members > 1").select("group", *(F.col(b).alias(f"c{b}") for b in BITS))
    around = state.join(centre, "group").groupBy("group").agg(F.max(F.expr(_differing(BITS, [f"c{b}" for b in BITS]))).alias("radius"))
    return spread.join(around, "group", "left").withColumn("radius", F.coalesce("radius", F.lit(0)).cast("int"))


def _pairs_inside(spread: DataFrame) -> float:
    """Pairs of members that groups hold, where not all are known to be of one component."""
    return spread.where("lo <> hi").agg(F.sum(F.col("members") * F.col("members") / 2.0)).collect()[0][0] or 0


def _pairs_between(lists: DataFrame, spread: DataFrame) -> float:
    """Pairs of groups that the lists hold, not known to be of one component. While each vertex is its own, all pairs are."""
    at = lists.join(spread, "group").groupBy("shingle", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("one")).agg(F.count(F.lit(1)).alias("c"))
    per = at.groupBy("shingle").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("one").isNotNull(), F.col("c") * F.col("c")).otherwise(F.col("c"))).alias("same"))
    return per.agg(F.sum((F.col("c") * F.col("c") - F.col("same")) / 2)).collect()[0][0] or 0


def _sharing(num: int, den: int) -> str:
    """Of a pair with c prefix shingles in common and sizes n, m: it may still reach the similarity."""
    part = lambda x: f"ceil({num} * {x} / {den})"
    beyond = lambda x: f"({part(x)} - least({SHARED}, {part(x)}))"
    return f"c >= least({SHARED}, {part('n')}, {part('m')}) and (c + greatest({beyond('n')}, {beyond('m')})) * {num + den} >= {num} * (n + m)"


def _near(x: list[str], y: list[str], total: str, num: int, den: int, slack: str = "0") -> str:
    """Signatures x and y differ in no more bits, beyond the slack, than sets of so many shingles in total may differ."""
    return f"(({_differing(x, y)} - {slack}) * {num + den} <= ({total}) * {den - num})"


def _leader_pairs(lists: DataFrame, state: DataFrame, spread: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """Pairs (a, b) of vertices of different components: members with their group's leader, groups with their lists' leader. A few stand twice."""
    seeds = [LEADERS * turn + i for i in range(LEADERS)]
    drawn = lambda s: F.xxhash64("v", F.lit(s))
    leaders = lambda row: F.array_distinct(F.array(*(F.min_by(row, F.struct(F.pmod(drawn(s), F.lit(DRAWN)) > 0, -F.col("central"), drawn(s))) for s in seeds)))
    central = lists.groupBy("group").agg((F.count(F.lit(1)) / F.first("n")).alias("central"))
    theirs = [f"{b}_a" for b in BITS]
    bits_a = [F.col(f"x.{b}").alias(t) for b, t in zip(BITS, theirs, strict=True)]
    open_groups = spread.where("lo <> hi").select("group")
    members = state.join(open_groups, "group", "left_semi")
    first = members.withColumn("central", F.lit(0)).groupBy("group").agg(leaders(F.struct("v", "component", *BITS)).alias("x")).select("group", F.explode("x").alias("x"))
    first = first.select("group", F.col("x.v").alias("a"), F.col("x.component").alias("of_a"), *bits_a)
    inside = members.join(first, "group").where(f"of_a <> component and {_near(BITS, theirs, '2 * n', num, den)}").select("a", F.col("v").alias("b"))
    stand = state.groupBy("group", "component").agg(F.min_by(F.struct("v", *BITS), "v").alias("x")).select("group", "component", "x.*")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))).cast("int").alias("band")
    at = lists.join(stand.join(central, "group"), "group").select("shingle", band, "n", "v", "component", "central", *BITS)
    lead = at.groupBy("shingle", "band").agg(leaders(F.struct("v", "component", "n", *BITS)).alias("x"), F.count(F.lit(1)).alias("members")).where("members > 1").select("shingle", "band", F.explode("x").alias("x"))
    lead = lead.select("shingle", "band", F.col("x.v").alias("a"), F.col("x.component").alias("of_a"), F.col("x.n").alias("m"), *bits_a)
    met = at.drop("central").withColumnRenamed("v", "b").join(lead, ["shingle", "band"]).where(f"of_a <> component and {den} * least(n, m) >= {num} * greatest(n, m) and {_near(BITS, theirs, 'n + m', num, den)}")
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m")).where(_sharing(num, den))
    # of a vertex's leaders, at most a few for each of its lists, those that share most
    best = counted.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), asc=False), 1, LEADERS).alias("x")).select("b", F.explode("x").alias("x"))
    return inside.union(best.select(F.col("x.a").alias("a"), "b"))


def _group_pairs(lists: DataFrame, found: DataFrame, spread: DataFrame, num: int, den: int, all_apart: bool) -> DataFrame:
    """Pairs (group, g) that share enough of their prefixes, with members of different components."""
    at = lists.where(f"i <= n - ceil({num} * n / {den})").join(spread, "group")  # a first shared shingle stands no later
    at = at.select("shingle", "group", "n", "i", "lo", "hi", "radius", *EARLIER, *BITS)
    if not all_apart:
        apart = at.groupBy("shingle").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").select("shingle")
        at = at.join(apart, "shingle", "left_semi")
    at = scratch(at, "at")
    x, y = (at.select(*(F.col(c).alias(f"{side}_{c}") for c in at.columns)) for side in "xy")  # alike, so they share an exchange
    of = lambda side, names: [f"{side}_{c}" for c in names]
    seen = " or ".join(f"{p} in ({', '.join(of('y', EARLIER))})" for p in of("x", EARLIER))
    met = x.join(y, F.col("x_shingle") == F.col("y_shingle")).where(
        f"x_group < y_group and {den} * least(x_n, y_n) >= {num} * greatest(x_n, y_n) and least(x_n - x_i, y_n - y_i) * {num + den} >= {num} * (x_n + y_n)"
        f" and not (x_lo = x_hi and y_lo = y_hi and x_lo = y_lo) and not coalesce({seen}, false) and {_near(of('x', BITS), of('y', BITS), 'x_n + y_n', num, den, '(x_radius + y_radius)')}"
    )
    met = scratch(met.select(F.col("x_group").alias("group"), F.col("y_group").alias("g"), F.col("x_n").alias("n"), F.col("y_n").alias("m")).distinct(), "met")
    dropped(at)
    named = scratch(met.select("group").union(met.select("g")).distinct(), "named")
    near = _maybe(found.select("group", "prefix"), named, "group").join(named, "group", "left_semi")
    held = scratch(near.groupBy("group").agg(F.first("prefix").alias("prefix")), "held")
    other = held.select(F.col("group").alias("g"), F.col("prefix").alias("prefix_g"))
    shared = met.join(held, "group").join(other, "g").withColumn("c", F.size(F.array_intersect("prefix", "prefix_g")))
    return shared.where(_sharing(num, den)).select("group", "g")


def _all_pairs(lists: DataFrame, found: DataFrame, state: DataFrame, spread: DataFrame, num: int, den: int, all_apart: bool) -> DataFrame:
    """All pairs (a, b) of vertices of different components that share enough prefix shingles, each once, as a vertex is of one group."""
    theirs = [f"{b}_a" for b in BITS]
    members = state.select("group", "v", "component", "n", *BITS)
    open_groups = spread.where("lo <> hi").select("group")
    other = members.select("group", F.col("v").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("m"), *(F.col(b).alias(t) for b, t in zip(BITS, theirs, strict=True)))
    near = _near(BITS, theirs, "n + m", num, den)
    inside = members.join(open_groups, "group", "left_semi").join(other, "group").where(f"of_a < component and {near}").select("a", F.col("v").alias("b"))
    pairs = _group_pairs(lists, found, spread, num, den, all_apart)
    expanded = pairs.join(members, "group").join(other.withColumnRenamed("group", "g"), "g").where(f"component <> of_a and {near}")
    return inside.union(expanded.select("a", F.col("v").alias("b")))


def _maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, and some more: a bitmap of hashes, of at most BITMAP_BITS bits, is broadcast."""
    word, bit = f"cast(pmod(xxhash64({key}), {BITMAP_BITS}) div 64 as int)", f"cast(pmod(xxhash64({key}), 64) as int)"
    bitmap = wanted.groupBy(F.expr(word).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("wanted_bits"))
    return rows.withColumn("word", F.expr(word)).join(F.broadcast(bitmap), "word").where(f"(shiftright(wanted_bits, {bit}) & 1L) = 1").drop("word", "wanted_bits")


def _verified(pairs: DataFrame, vertices: DataFrame, rows: DataFrame, of_set: Callable[[DataFrame], DataFrame], k: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets are similar enough."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, bounds in shingle_sets([x or "" for x in batch.column(0).to_pylist()], k):
                content = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(_digests(values, bounds, 1).view(np.int64)), pa.array(_digests(values, bounds, 2).view(np.int64)), content], ["v", "second", "content"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    wanted = scratch(vertices.join(wanted, "v", "left_semi").select("v", "doc_id"), "wanted")
    near = _maybe(rows, wanted, "doc_id")
    contents = of_set(near.select("text").mapInArrow(whole, "v long, second long, content binary"))
    contents = contents.join(wanted.select("v"), "v", "left_semi").groupBy("v").agg(F.first("content").alias("content"))
    left = contents.select(F.col("v").alias("a"), F.col("content").alias("x"))
    right = contents.select(F.col("v").alias("b"), F.col("content").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _labelled(membership: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The least document id of each document's component."""
    named = membership.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("least"))
    if labels is None:
        by_set = named.select("v", F.col("least").alias("component_id"))
    else:
        named = named.join(labels, "v", "left").select("v", "least", F.coalesce("component", "v").alias("component"))
        name = named.groupBy("component").agg(F.min("least").alias("component_id"))
        by_set = named.join(name, "component").select("v", "component_id")
    joined = membership.join(by_set.withColumnRenamed("v", "of"), (F.col("v") == F.col("of")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
