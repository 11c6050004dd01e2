"""Centroid clustering of integer vectors; Ptolemy's inequality saves distances that cannot win."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfacts.llm.common import mapped, written

#: Components up to this are computed with in 64 bits (of 1024 components a squared distance has 2^62 at most);
#: beyond, in Python's whole numbers.
SMALL = 1 << 25
#: Vectors with a component from here on are left out, as those that are not finite.
LARGEST = 2.0**200
LIMB = 60
LONG = (1 << 63) - 1
_SLACK = 2.0**-48


def squares(vectors: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances; `vectors` holds whole numbers as doubles."""
    big = max(map(abs, centroid), default=0) > SMALL or bool(len(vectors)) and np.abs(vectors).max(initial=0) > SMALL
    if not big:
        apart = vectors.astype(np.int64) - np.array(centroid, np.int64)
        return np.einsum("ij,ij->i", apart, apart)
    return np.array([sum((int(a) - b) ** 2 for a, b in zip(v, centroid, strict=True)) for v in vectors.tolist()], object)


def roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Ptolemy:
    """Lower bounds of distances to centroids from distances to fixed pivots.

    For pivots p and s any x and c satisfy d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|. Every root and
    product is off by a few units in the last place, so each bound is lowered by far more than that.
    """

    def __init__(self, pivots: list[list[int]], centroids: list[list[int]]):
        self.centroids = centroids
        at = np.array(pivots, np.float64).reshape(len(pivots), -1)
        to = [np.array([float(roots(squares(at[j : j + 1], c))[0]) for j in range(len(pivots))]) for c in centroids]
        self.to = np.array(to).reshape(len(centroids), len(pivots))
        self.pairs = []
        for p, s in combinations(range(len(pivots)), 2):
            between = float(roots(squares(at[p : p + 1], pivots[s]))[0])
            if between > 0:
                self.pairs.append((p, s, between))

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """For each vector (its distances to the pivots) and centroid, a number that the distance is not below."""
        out = np.zeros((len(cached), len(self.centroids)))
        for p, s, between in self.pairs:
            one = cached[:, p, None] * self.to[None, :, s]
            two = cached[:, s, None] * self.to[None, :, p]
            bound = (np.abs(one - two) - (one + two) * _SLACK) * ((1 - _SLACK) / between)
            np.maximum(out, bound, out=out)
        return out

    def nearest(self, vectors: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (of several the first), its exact squared distance, and how many were computed.

        The centroid of the smallest bound is computed for every vector; any other only where its bound does not
        already exceed the best distance so far.
        """
        bounds = self.bounds(cached)
        first = bounds.argmin(axis=1)
        best, which, computed = np.zeros(len(vectors), object), first.copy(), 0
        for c, centroid in enumerate(self.centroids):
            mine = np.flatnonzero(first == c)
            best[mine] = squares(vectors[mine], centroid)
            computed += len(mine)
        if all(type(b) is not int or b <= LONG for b in best.tolist()):
            best = best.astype(np.int64)
        for c, centroid in enumerate(self.centroids):
            open_ = np.flatnonzero((first != c) & (bounds[:, c] <= roots(best) * (1 + _SLACK)))
            if not len(open_):
                continue
            found = squares(vectors[open_], centroid)
            computed += len(open_)
            if found.dtype == object and best.dtype != object:
                best = best.astype(object)
            wins = (found < best[open_]) | ((found == best[open_]) & (c < which[open_]))
            best[open_[wins]], which[open_[wins]] = found[wins], c
        return which, best, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batches(batches: Iterator[pa.RecordBatch], dims: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, _matrix(batch.column("vector"), dims), _matrix(batch.column("cached"), pivots)


def _with_pivots(vectors: DataFrame, pivots: list[list[int]], dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _matrix(batch.column("vector"), dims)
            to = np.stack([roots(squares(at, p)) for p in pivots], axis=1)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(pivots), pa.int32())
            cached = pa.ListArray.from_arrays(offsets, pa.array(to.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cached], names=[*batch.schema.names, "cached"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("cached", T.ArrayType(T.DoubleType()))])
    return mapped(vectors, run, schema)


def _sums(vectors: DataFrame, pivots: list[list[int]], centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid the number of its vectors and their sum: added up in the tasks, one row a task and centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = Ptolemy(pivots, centroids)
        count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for _, at, cached in _batches(batches, dims, len(pivots)):
            which, _, _ = bound.nearest(at, cached)
            exact = at.astype(np.int64) if np.abs(at).max(initial=0) <= SMALL else np.array([[int(x) for x in v] for v in at.tolist()], object)
            for c in set(which.tolist()):
                mine = which == c
                count[c] += int(mine.sum())
                total[c] = [a + int(b) for a, b in zip(total[c], exact[mine].sum(axis=0), strict=True)]
        rows = [
            {"cluster": c, "n": count[c], "at": j, "low": x & mask, "mid": x >> LIMB & mask, "high": x >> 2 * LIMB}
            for mask in [(1 << LIMB) - 1]
            for c in range(len(centroids))
            if count[c]
            for j, x in enumerate(total[c])
        ]
        kind = pa.decimal128(38, 0)
        fields = [("cluster", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("low", kind), ("mid", kind), ("high", kind)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    parts = mapped(vectors.select("vector", "cached"), run, "cluster int, n long, at int, low decimal(38,0), mid decimal(38,0), high decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    summed = parts.groupBy("cluster", "at").agg(*[F.sum(x).alias(x) for x in ("n", "low", "mid", "high")])
    for r in summed.collect():  # centroids times components
        found.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["at"]] = int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << 2 * LIMB)
    return found


def _spread_out(candidates: list[list[int]], n: int) -> list[list[int]]:
    """Up to `n` of the candidates, each the farthest from those taken before."""
    taken = candidates[:1]
    while taken and len(taken) < n:
        at = np.array(candidates, np.float64)
        nearest = np.min([roots(squares(at, t)) for t in taken], axis=0)
        if nearest.max() <= 0:
            break
        taken.append(candidates[int(nearest.argmax())])
    return taken


def clusters(
    rows: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    pivots: int = 4,
    candidates: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid for each row with a usable vector.

    A vector is used if it has exactly `dims` components, none null or not finite; a component x becomes
    floor(scale * x). The first centroids are the `k` vectors whose ids have the smallest hashes (sha256 of seed:id; of
    one id the smallest vector first, null ids last; fewer if there are fewer). In each of `rounds` rounds every
    vector goes to its nearest centroid (the smaller number of several), and a centroid with vectors becomes the floor
    of their mean in each component; then vectors are assigned once more. centroid is the final one as an array of
    decimal numbers.

    The distances of all vectors to up to `pivots` pivots (far from each other, of the `candidates` vectors of smallest
    hash) are computed once and stored beside the vectors. A round reads them, bounds each distance by Ptolemy's
    inequality over all pairs of pivots, and computes only those that may win. Sums are exact; tasks add up their
    vectors before anything is shuffled, so equal vectors and a centroid that has most of them cost no more than
    others, and the driver sees `k` times `dims` numbers a round.

    Null, short and odd vectors give no row; null ids and repeated rows are rows like any other, other columns are
    ignored, no usable vectors give no rows. Components of 2^200 or more count as not finite; distances and
    sums of them beyond 2^63 - 1 are given as that.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * float(scale))
    usable = (F.size("vector") == dims) & F.forall("vector", lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False)))
    # Kept as doubles: whole numbers beyond 64 bits are exact there, since scaled floats are.
    whole = F.transform("vector", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    found = rows.select(F.col(id_col).alias("vec_id"), x.alias("vector")).filter(usable).select("vec_id", whole.alias("vector"))
    ident = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = found.withColumn("hash", ident).orderBy(F.col("hash").asc_nulls_last(), "vector").limit(max(k, candidates)).collect()
    start = [[int(v) for v in r["vector"]] for r in first]
    centroids, fixed = start[:k], _spread_out(start[:candidates], pivots)
    if not centroids:
        return found.filter("1 = 0").select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.array().cast("array<string>").alias("centroid"),
        )
    vectors = written(_with_pivots(found, fixed, dims), "vectors")
    for _ in range(rounds):
        before = centroids
        for c, (n, total) in _sums(vectors, fixed, centroids, dims).items():
            centroids = [*centroids[:c], [t // n for t in total], *centroids[c + 1 :]]
        if centroids == before:  # every further round would give the same
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = Ptolemy(fixed, centroids)
        for batch, at, cached in _batches(batches, dims, len(fixed)):
            which, best, _ = bound.nearest(at, cached)
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array(which, pa.int32()), pa.array([min(int(b), LONG) for b in best.tolist()], pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = written(mapped(vectors, run, schema), "clusters")
    sums = {r["cluster"]: int(r["sum"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    of = [min(sums.get(c, 0), LONG) for c in range(len(centroids))]
    number = F.col("cluster") + 1
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(s).cast("long") for s in of]), number).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONG)).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.split(F.lit(",".join(map(str, c))), ",") for c in centroids]), number).alias("centroid"),
    )
