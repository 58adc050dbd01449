"""References as a compressed sparse matrix that every task holds, searched with upper bounds.

The matrix is stored by bucket: of each bucket the places of the references that have it, ascending, and their weights. Places follow endpoint and id, so the
references of one endpoint are a stretch of every list. A search takes a row's buckets from the one that can add most (the row's weight times the
largest in the list) to the one that can add least, some at first and then twice as many each time. Once all that is left can't lift an unseen
reference above the k-th best so far, no more lists are read: only those references that still can get there are looked up in them. The k best are exact.

Only what has been counted first is collected: a matrix of more than MOST_BYTES isn't built, and the caller joins instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 28  # of WEIGHT_BYTES a weight; the bag of a request has 256 tokens at most, a model 80,000 references of a kind
WEIGHT_BYTES = 24
DIGITS = 12  # similarities that agree to these tie


@dataclass
class ReferenceIndex:
    key: np.ndarray  # bucket times the number of references, plus the reference's place; ascending
    place: np.ndarray
    weight: np.ndarray
    largest: np.ndarray  # weight of each list
    endpoints: dict[str, tuple[int, int]]
    turn: np.ndarray  # of each place, its id's place in the order of ids, by which ties are broken
    kinds: np.ndarray  # number of each place's type in `names`
    names: list[str]

    @classmethod
    def of(cls, vectors: DataFrame, refs: DataFrame, dimension: int, most_bytes: int = MOST_BYTES) -> ReferenceIndex | None:
        """None if it would be too large, or if a weight is negative, for which the bounds don't hold."""
        held = vectors.join(refs.select("id"), "id", "left_semi")
        size = held.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).collect()[0]
        if size["n"] * WEIGHT_BYTES > most_bytes or (size["least"] or 0) < 0:
            return None
        head = refs.select("id", "endpoint_key", "attack_type").toPandas().sort_values(["endpoint_key", "id"], na_position="first", kind="stable").reset_index(drop=True)
        got = held.select("id", "bucket", "weight").toArrow()
        place = head.reset_index().set_index("id")["index"].reindex(got["id"].to_pandas()).to_numpy()
        bucket, weight = got["bucket"].to_numpy(), got["weight"].to_numpy()
        key = bucket.astype(np.int64) * len(head) + place.astype(np.int64)
        order = np.argsort(key, kind="stable")
        largest = np.zeros(dimension)
        np.maximum.at(largest, bucket, weight)
        keys = head["endpoint_key"]
        stretches = {k: (int(v.min()), int(v.max()) + 1) for k, v in keys[keys.notna()].groupby(keys).groups.items()}
        types = head["attack_type"].astype("string").fillna("")
        names = sorted(types.unique(), key=lambda x: x.encode())
        kinds = types.map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int32)
        turn = head["id"].rank(method="first").to_numpy(dtype=np.int64) if head["id"].dtype != object else np.argsort(np.argsort(head["id"].astype("string").str.encode("utf-8").to_numpy(), kind="stable"), kind="stable")
        return cls(key[order], place[order].astype(np.int64), weight[order], largest, stretches, turn, kinds, list(names))

    def __len__(self) -> int:
        return len(self.kinds)

    def best(self, buckets: np.ndarray, weights: np.ndarray, k: int, endpoint: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, similarities, postings read) of the k best with a positive similarity, ties to the smaller id; of the endpoint's references if it has any."""
        low, high = self.endpoints.get(endpoint, (0, len(self))) if endpoint is not None else (0, len(self))
        bound = weights * self.largest[buckets]
        turn = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[turn][::-1])[::-1], 0.0)
        offset, weights = buckets[turn].astype(np.int64) * len(self), weights[turn]
        first, last = np.searchsorted(self.key, offset + low), np.searchsorted(self.key, offset + high)
        sums, read, t, step, found = np.zeros(high - low), 0, 0, 8, None
        while t < len(turn):
            if t and len(sums) > k and rest[t] < sums.max():
                kth = np.partition(sums, len(sums) - k)[len(sums) - k] - 1e-9
                if rest[t] < kth:
                    found = np.flatnonzero(sums + rest[t] >= kth)
                    break
            some = slice(t, t + step)
            n = last[some] - first[some]
            lists = [slice(a, z) for a, z in zip(first[some].tolist(), last[some].tolist(), strict=True)]
            at, own = np.concatenate([self.place[x] for x in lists]), np.concatenate([self.weight[x] for x in lists])
            sums += np.bincount(at - low if low else at, own * np.repeat(weights[some], n), minlength=len(sums))
            read, t, step = read + len(at), t + step, 2 * step
        if found is None:
            found = np.flatnonzero(sums > 0)
        else:
            wanted = (offset[t:, None] + (found + low)).ravel()  # of each list left, the references that still can get there
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            more = np.where(self.key[at] == wanted, self.weight[at], 0.0).reshape(-1, len(found))
            sums[found] += weights[t:] @ more
            read += int((more > 0).sum())
            found = found[sums[found] > 0]
        rounded = np.round(sums[found], DIGITS)
        chosen = found[np.lexsort((self.turn[found + low], -rounded))[:k]]
        return chosen + low, sums[chosen], read

    def vote(self, places: np.ndarray, similarities: np.ndarray) -> tuple[str | None, float]:
        """The type with the largest sum of similarities and that sum, ties (to 12 digits) to the smaller name."""
        if not len(places):
            return None, 0.0
        score = np.bincount(self.kinds[places], similarities, minlength=len(self.names))
        first = int(np.argmax(np.round(score, DIGITS)))
        return self.names[first], float(score[first])


def unit(buckets: np.ndarray, weights: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their summed weights at length 1."""
    sums = np.bincount(buckets, weights, minlength=dimension)
    there = np.flatnonzero(np.bincount(buckets, minlength=dimension))
    norm = np.sqrt((sums[there] ** 2).sum())
    return there, sums[there] / (norm if norm > 0 else 1.0)
