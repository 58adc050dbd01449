"""Exact top-k search by inner product over M-trees, best first.

Vectors become integers floor(1024 x). With M the largest norm, a vector v gets the further component
sqrt(M^2 - |v|^2) and a query 0; then the distance is sqrt(|q|^2 + M^2 - 2 q.v), so the nearest vectors are those of
the largest inner product, and the triangle inequality holds.

1. At most `most_pivots` vectors (by a hash of the id; the sample is bounded and documented by that parameter) are
   pivots; a length without one has the origin as its pivot. Every vector goes to its nearest pivot, and of that to one of
   at most RINGS rings by its distance (at approximate quantiles). A ring's vectors are dealt to trees of about
   `tree_size`, so many equal vectors make more trees and no larger ones.
2. A task builds each tree as pages: a routing vector, covering radius, distance to the parent's routing vector, and
   entries with their distances to the routing vector. Pages are a table in the shared folder.
3. Queries meet one tree of the ring of their nearest pivot that is nearest to them, which gives each a bound (its k-th
   best). Then they meet the trees of each ring whose least and largest distance from the pivot let it beat the bound, in
   blocks of at most `query_block` queries for a copy of a tree.
   Within a tree pages come off a heap by their least possible distance; entries whose stored distance rules them out
   (|d(q, parent) - d(entry, parent)| - radius beyond the bound) are skipped without a distance of their own.
4. The k best of each query over its trees are kept.

Exact for any data: all bounds are proven, and none is a cap. Vectors that are null, hold null or non-finite components, or
have no id take no part. Vectors are compared with those of the same length only, empty ones too (score 0), and may be as
long as they like. Components beyond 2^62 / 1024 in size count as that, and scores beyond a long as its end; sums that may
leave a long are made of Python's integers. Rows that repeat an id are candidates each, but not of a query of that id; of
repeated query rows the least vector is the query. Other columns, whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import scratch

SCALE = 1024
MOST_PIVOTS = 256
TREE_SIZE = 4096
PAGE = 128
FAN_OUT = 32
QUERY_BLOCK = 4096
RINGS = 64
LARGEST = 1 << 62
LONG = (1 << 63) - 1
PAGE_SCHEMA = "cell int, tree int, node int, parent int, leaf boolean, radius double, parent_distance double, routing binary, children binary, ids binary, vectors binary, distances binary"


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v is array<long>."""
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), x))
    whole = F.transform(vector_col, lambda x: F.floor(bounded(x.cast("double") * SCALE)).cast("long"))
    return vectors.where(sound & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(), dtype=np.int64).reshape(len(column), dim)


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q; those beyond a long are its end."""
    largest = [int(np.abs(x).max(initial=0)) for x in (vectors, q)]
    if largest[0] * largest[1] * max(1, len(q)) <= LONG:
        return vectors @ q
    exact = vectors.astype(object) @ q.astype(object)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in exact], dtype=np.int64)


def _augment(v: np.ndarray, m2: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(m2 - (f * f).sum(axis=1), 0.0))])


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=1), 0.0))


def build_pages(ids: np.ndarray, vectors: np.ndarray, m2: float) -> list[dict]:
    """Pages of an M-tree over the vectors, the root first. Entries of a page lie within its radius of its routing vector."""
    points = _augment(vectors, m2)
    pages: list[dict] = []

    def page(rows: np.ndarray, routing: np.ndarray, parent: int, parent_distance: float) -> int:
        number = len(pages)
        distances = _distances(points[rows], routing)
        leaf = len(rows) <= PAGE
        pages.append({"node": number, "parent": parent, "leaf": leaf, "radius": float(distances.max(initial=0.0)), "parent_distance": parent_distance, "routing": routing, "rows": rows, "distances": distances, "children": []})
        if not leaf:
            n = min(FAN_OUT, -(-len(rows) // PAGE))
            centres = points[rows[np.linspace(0, len(rows) - 1, n).astype(np.int64)]]
            to = ((points[rows] ** 2).sum(axis=1)[:, None] - 2 * points[rows] @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            parts = [rows[to == c] for c in range(n)]
            if max(map(len, parts)) == len(rows):  # all alike: any even cut will do
                parts = np.array_split(rows, n)
            for part, centre in zip(parts, centres, strict=True):
                if len(part):
                    pages[number]["children"].append(page(part, centre, number, float(_distances(centre[None], routing)[0])))
        return number

    page(np.arange(len(ids)), points[0], -1, 0.0)
    out = []
    for p in pages:
        rows = p.pop("rows") if p["leaf"] else (p.pop("rows"), np.zeros(0, dtype=np.int64))[1]
        out.append(p | {"routing": p["routing"].tobytes(), "children": np.array(p["children"], dtype=np.int32).tobytes(), "ids": ids[rows].tobytes(), "vectors": vectors[rows].tobytes(), "distances": (p["distances"] if p["leaf"] else np.zeros(0)).tobytes()})
    return out


class Tree:
    """A tree read from its pages; `search` visits pages best first."""

    def __init__(self, pages: pd.DataFrame, m2: float):
        self.m2, self.nodes = m2, {}
        for p in pages.itertuples():
            ids = np.frombuffer(p.ids, dtype=np.int64)
            self.nodes[p.node] = (
                p.leaf, p.radius, p.parent_distance, np.frombuffer(p.routing), np.frombuffer(p.children, dtype=np.int32), ids,
                np.frombuffer(p.vectors, dtype=np.int64).reshape(len(ids), len(p.routing) // 8 - 1), np.frombuffer(p.distances),
            )
        for n, (leaf, *_, children, _, _, _) in self.nodes.items():
            if not leaf:
                kids = [self.nodes[c] for c in children]
                self.nodes[n] = (*self.nodes[n], np.array([k[1] for k in kids]), np.array([k[2] for k in kids]), np.stack([k[3] for k in kids]))
        self.slack = 1e-7 * (1 + math.sqrt(m2))
        self.computed = 0

    def search(self, query_id: int, q: np.ndarray, k: int, score: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, of scores at least `score` if given."""
        point = np.append(q.astype(np.float64), 0.0)
        q2 = sum(x * x for x in q.tolist())
        best: list[tuple[int, int]] = []  # a heap of (score, -id), its least first
        far = lambda s: math.sqrt(max(0, q2 + self.m2 - 2 * s)) + self.slack if s > -LONG - 1 else math.inf
        bound = far(score) if score is not None else math.inf
        root = self.nodes[0]
        d = float(_distances(root[3][None], point)[0])
        heap = [(max(0.0, d - root[1]), 0, d)]
        while heap:
            least, node, d = heapq.heappop(heap)
            if least > bound:
                break
            page = self.nodes[node]
            if page[0]:
                ids, vectors, distances = page[5], page[6], page[7]
                near = np.abs(d - distances) <= bound
                near &= ids != query_id
                ids, scores = ids[near], products(vectors[near], q)
                self.computed += len(ids)
                if len(ids) > k:  # no entry below the k-th score of the page can be among the best
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[keep], scores[keep]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if score is not None and s < score:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    bound = min(bound, far(best[0][0]))
            else:
                children, radii, to_parent, routing = page[4], page[8], page[9], page[10]
                near = np.flatnonzero(np.abs(d - to_parent) - radii <= bound)
                self.computed += len(near)
                at = _distances(routing[near], point)
                low = np.maximum(at - radii[near], 0.0)
                for child, dist, l in zip(children[near].tolist(), at.tolist(), low.tolist(), strict=True):
                    if l <= bound:
                        heapq.heappush(heap, (l, child, dist))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = MOST_PIVOTS, tree_size: int = TREE_SIZE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's row in `queries` the k vectors of the highest scores, all if fewer."""
    points = integers(vectors, id_col, vector_col)
    asked = integers(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = points.agg(F.max(norm).alias("m2"), F.count(F.lit(1)).alias("n")).collect()[0]
    spark = vectors.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m2 = size["m2"] * (1 + 1e-12)
    wanted = min(most_pivots, max(1, math.ceil(size["n"] / tree_size)))
    # rows as pivots for at most so many lengths; any other length has the origin as its one pivot, which needs no row here
    seeds = points.select(F.size("v").alias("dim"), "v", F.xxhash64("id").alias("h"))
    chosen = seeds.orderBy("h").limit(wanted).union(seeds.groupBy("dim").agg(F.min_by("v", "h").alias("v"), F.min("h").alias("h")).select("dim", "v", "h").limit(most_pivots)).select("v").collect()
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for number, v in enumerate(np.array(r["v"], dtype=np.int64) for r in chosen):
        numbers, rows = pivots.get(len(v), (np.zeros(0, dtype=np.int32), np.zeros((0, len(v)), dtype=np.int64)))
        pivots[len(v)] = (np.append(numbers, np.int32(number)), np.vstack([rows, v]))
    centres = {d: (numbers, _augment(rows, m2)) for d, (numbers, rows) in pivots.items()}
    more = len(chosen)

    def centres_of(dim: int) -> tuple[np.ndarray, np.ndarray]:
        return centres[dim] if dim in centres else (np.array([more + dim], dtype=np.int32), np.zeros((1, dim + 1)))

    def assign(batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                x = _augment(_matrix(part.column(1), dim), m2)
                numbers, c = centres_of(dim)
                square = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
                to = square.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(numbers[to]), pa.array(_distances(x, c[to]))], ["id", "v", "pivot", "distance"])

    placed = scratch(points.mapInArrow(assign, "id long, v array<long>, pivot int, distance double"), "placed")
    shares = [i / RINGS for i in range(1, RINGS)]
    cuts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", shares, 1000).alias("cuts"))
    few = F.least(F.lit(RINGS), F.ceil(F.col("n") / tree_size)).cast("int")  # rings, each of about a tree at least
    each = F.transform(F.sequence(F.lit(1), few), lambda i: F.get("cuts", F.floor(i * RINGS / few).cast("int") - 1))
    cuts = F.broadcast(cuts.select("pivot", F.filter(F.slice(each, 1, few - 1), lambda x: x.isNotNull()).alias("cuts")))  # a row per pivot
    ringed = placed.join(cuts, "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("distance")))).drop("cuts", "distance")
    ringed = ringed.withColumn("cell", (F.col("pivot") * RINGS + F.col("ring")).cast("int"))
    spans = placed.join(cuts, "pivot").groupBy("pivot", F.size(F.filter("cuts", lambda c: c < F.col("distance"))).alias("ring"))
    spans = spans.agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect()  # RINGS rows a pivot at most
    rings: dict[int, tuple[np.ndarray, ...]] = {}
    for pivot in {r["pivot"] for r in spans}:
        own = [r for r in spans if r["pivot"] == pivot]
        rings[pivot] = (np.array([pivot * RINGS + r["ring"] for r in own], dtype=np.int32), np.array([r["lo"] for r in own]), np.array([r["hi"] for r in own]))
    trees = spark.createDataFrame([(r["pivot"] * RINGS + r["ring"], math.ceil(r["n"] / tree_size)) for r in spans], "cell int, trees int")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        pages = pd.DataFrame(build_pages(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64), m2))
        return pages.assign(cell=key[0], tree=key[1])[[x.split()[0] for x in PAGE_SCHEMA.split(", ")]]

    dealt = ringed.join(F.broadcast(trees), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), "trees").cast("int").alias("tree"))
    pages = scratch(dealt.groupBy("cell", "tree").applyInPandas(build, PAGE_SCHEMA), "pages")

    slack = 1e-7 * (1 + math.sqrt(m2))

    def route(first: bool):
        """Queries to the ring nearest to them of the nearest pivot, or to every ring that may hold better than their bound."""

        def run(batches):
            for batch in batches:
                ids, vectors = batch.column(0).to_numpy(), batch.column(1)
                bounds = batch.column(2).to_pylist()
                out: dict[str, list] = {"query_id": [], "v": [], "bound": [], "cell": []}
                for i, q in enumerate(vectors.to_pylist()):
                    numbers, c = centres_of(len(q))
                    d = _distances(c, np.append(np.array(q, dtype=np.float64), 0.0))
                    used = [(x, rings[p]) for x, p in zip(d.tolist(), numbers.tolist(), strict=True) if p in rings]
                    if not used:  # no vector has this length
                        continue
                    if first:
                        x, (cells, lo, hi) = min(used, key=lambda u: u[0])
                        to = [int(cells[np.maximum(x - hi, lo - x).argmin()])]
                    else:
                        far = math.inf if bounds[i] is None or bounds[i] < -LONG else math.sqrt(max(0, sum(x * x for x in q) + m2 - 2 * bounds[i])) + slack
                        to = [p for x, (cells, lo, hi) in used for p in cells[np.maximum(x - hi, lo - x) <= far].tolist()]
                    for p in to:
                        for k_, v_ in zip(out, (int(ids[i]), q, bounds[i], p), strict=True):
                            out[k_].append(v_)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("bound", pa.int64()), ("cell", pa.int32())]))

        return run

    def meet(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            tree = Tree(held, m2)
            for q in asked.itertuples():
                for s, i in tree.search(q.query_id, np.asarray(q.v, dtype=np.int64), k, None if pd.isna(q.bound) else int(q.bound)):
                    out.append((q.query_id, i, s))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(sent: DataFrame, one_tree: bool) -> DataFrame:
        blocks = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
        of = F.broadcast(blocks.join(trees, "cell"))  # a row per ring
        tree = F.array(F.pmod(F.xxhash64("query_id", F.lit(1)), "trees").cast("int")) if one_tree else F.sequence(F.lit(0), F.col("trees") - 1)
        left = sent.join(of, "cell").select("query_id", "v", "bound", "cell", F.explode(tree).alias("tree"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"))
        right = pages.join(of.drop("trees"), "cell").select(*(x.split()[0] for x in PAGE_SCHEMA.split(", ")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        key = ["cell", "tree", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score long")

    kind = "query_id long, v array<long>, bound long, cell int"
    start = asked.select("id", "v", F.lit(None).cast("long").alias("bound"))
    near = scratch(searched(scratch(start.mapInArrow(route(True), kind), "near"), True), "first")
    bounds = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    onward = asked.join(bounds, asked["id"] == bounds["query_id"], "left").select("id", "v", "bound")
    found = searched(scratch(onward.mapInArrow(route(False), kind), "onward"), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
