"""Centroid clustering of whole-number vectors by Orchard's search.

Each centroid has a list of the others by distance. A vector starts at one centroid and walks its list; when it meets a
closer one it goes on in that one's list, and every centroid it has met is marked and not measured again. It stops where
the next centroid of the list is strictly further than twice the distance found so far: by the triangle inequality that
one and all behind it are strictly further from the vector. All comparisons are between exact integers.

Vectors are prepared once, as a table in the shared folder. A round is one pass over it: tasks sum their vectors per
centroid, and only these sums, a row per centroid and component, are added up and reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.session import materialise

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024.0


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): vectors of so many components, each floor(1024 x), as the bytes of 64-bit integers."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    # a scaled component of 2^63 or more is no long
    sound = (F.size("embedding") == components) & F.coalesce(F.forall(x, lambda e: F.abs(e) < 2.0**53), F.lit(False))
    kept = vectors.where(sound).select("vec_id", F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().astype("<i8").reshape(-1, components)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    kind = T.StructType([vectors.schema["vec_id"], T.StructField("v", T.BinaryType())])
    return kept.mapInArrow(packed, kind)


def first_centroids(whole: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``; repeated ids by their vectors, null ids never."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.where(F.col("vec_id").isNotNull()).orderBy(hashed, "v").limit(count).collect()
    return [np.frombuffer(r["v"], "<i8").tolist() for r in rows]


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, dtype=object)
        self.reach = max((abs(x) for c in centroids for x in c), default=0)
        gaps = np.array([[int(((a - b) ** 2).sum()) for b in self.exact] for a in self.exact], dtype=object)
        k = len(centroids)
        self.lists = np.array([[j for j in sorted(range(k), key=lambda j: (gaps[c][j], j)) if j != c] for c in range(k)], dtype=np.int64).reshape(k, k - 1)
        # gap > 2 d, in squares and whole numbers: (gap^2 + 3) div 4 > d^2
        self.quarter = (gaps + 3) // 4

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, distances measured) of rows of 64-bit integers; equal distances go to the smaller number."""
        n, k = len(vectors), len(self.exact)
        far = max(self.reach, int(max(-int(vectors.min()), int(vectors.max())))) if vectors.size else 0
        small = 4 * far * far * vectors.shape[1] < 1 << 62
        kind = np.int64 if small else object  # beyond 64 bits by Python's integers
        x, c, quarter = vectors.astype(kind), self.exact.astype(kind), self.quarter.astype(kind)

        def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
            return ((x[rows] - c[to]) ** 2).sum(axis=1)

        now, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        best = squared(np.arange(n), now)
        met = np.zeros((n, k), dtype=bool)
        met[:, 0] = True
        measured, walking = n, np.arange(n) if k > 1 else np.arange(0)
        while walking.size:
            walking = walking[at[walking] < k - 1]
            to = self.lists[now[walking], at[walking]]
            near = (quarter[now[walking], to] <= best[walking]).astype(bool)
            walking, to = walking[near], to[near]
            at[walking] += 1
            new = ~met[walking, to]
            rows, to = walking[new], to[new]
            if rows.size:
                met[rows, to] = True
                found = squared(rows, to)
                measured += rows.size
                closer = ((found < best[rows]) | ((found == best[rows]) & (to < now[rows]))).astype(bool)
                rows = rows[closer]
                now[rows], best[rows], at[rows] = to[closer], found[closer], 0
        return now, best, measured


def _rows(batch: pa.RecordBatch, at: int, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(at).to_pylist()), "<i8").reshape(-1, components)


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; a centroid without any stays."""
    components, search = len(centroids[0]), Orchard(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            x = _rows(batch, 0, components)
            own, _, _ = search.assign(x)
            low, high = x & 0xFFFFFFFF, x >> 32  # halves: a batch's sum of either fits 64 bits
            for k in np.unique(own):
                is_k = own == k
                part = [int(is_k.sum()), *[int(h) * (1 << 32) + int(low_) for h, low_ in zip(high[is_k].sum(axis=0), low[is_k].sum(axis=0))]]
                sums[int(k)] = [a + b for a, b in zip(sums.get(int(k), [0] * len(part)), part)]
        flat = [(k, i, Decimal(v)) for k, values in sums.items() for i, v in enumerate(values)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.decimal128(38, 0))],
            ["cluster", "place", "value"],
        )

    parts = whole.select("v").mapInArrow(summed, "cluster int, place int, value decimal(38,0)")
    total: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():  # a row per centroid and component
        total.setdefault(row["cluster"], {})[row["place"]] = int(row["value"])
    return [[total[k][i + 1] // total[k][0] for i in range(components)] if k in total else c for k, c in enumerate(centroids)]


def clustered(vectors: DataFrame, components: int = COMPONENTS, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, or a null or non-finite one, or one of 2^53 or more (its integer
    exceeds 64 bits), are left out. Repeated rows are vectors of their own; a null vec_id keeps its row but starts no
    centroid. Fewer vectors than centroids give fewer centroids; an empty table, or one of null ids alone, gives no rows. A
    distance or a sum beyond 64 bits is null.
    """
    whole = materialise(whole_vectors(vectors.select("vec_id", "embedding"), components))
    centroids = first_centroids(whole, count, seed)
    kind = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        empty = vectors.sparkSession.createDataFrame([], kind)
        return empty.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    search = Orchard(centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, d, _ = search.assign(_rows(batch, 1, components))
            told = [int(x) if x < 1 << 63 else None for x in d]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(told, pa.int64())], ["vec_id", "cluster", "distance"])

    out = materialise(whole.mapInArrow(placed, kind))
    whole_sum = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(whole_sum.alias("s")).collect()}  # a row per centroid

    def as_long(value) -> F.Column:
        return F.lit(int(value) if value is not None and value < 1 << 63 else None).cast("long")

    all_sums = None if None in sums.values() else sum(sums.values())
    per = [sums.get(k, 0) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.col("cluster")
    return out.select(
        "vec_id", "cluster", "distance", F.get(F.array(*[as_long(s) for s in per]), own).alias("cluster_inertia"),
        as_long(all_sums).alias("inertia"), F.get(F.array(*[F.lit(d) for d in digests]), own).alias("centroid_sha256"),
    )
