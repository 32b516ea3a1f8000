"""Operator 11: centroid clustering of integer vectors, exact to the last tie.

Each round a matrix product in single precision gives every vector an interval
for its squared distance from every centroid, wide enough to hold the true
value whatever the rounding.  Centroids whose interval begins above the least
interval end are out; where more than one is left, just these are measured
again in whole numbers, ties going to the lowest number.  Tasks sum the vectors
of a cluster exactly and hand on one row a cluster, so a round moves a few rows
a task however the clusters are filled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import stage

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
NARROW = 1 << 27  # differences of such numbers, squared and summed over a row, fit 64 bits
LIMB = 40
ROOM = 40
MOST_LONG = (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def as_float(value: int) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def square(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b))


class Centroids:
    """Centroids of whole numbers of any size, and the nearest one to each row."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.narrow = all(abs(v) <= NARROW for r in rows for v in r)
        self.whole = np.array(rows, np.int64) if self.narrow else None
        wide = np.array([[as_float(v) for v in r] for r in rows])
        with np.errstate(over="ignore", invalid="ignore"):
            self.single = wide.astype(np.float32)
            self.norm = np.sqrt((wide**2).sum(1))
        self.square = np.array([as_float(sum(v * v for v in r)) for r in rows])
        unit = 2.0**-24
        terms = len(rows[0]) + 2  # both factors are rounded once, then come products and sums in any order
        self.gamma = terms * unit / (1 - terms * unit)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 x.c for rows ``x`` of narrow whole numbers."""
        norm = np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))
        with np.errstate(over="ignore", invalid="ignore"):
            near = self.square - 2.0 * (x.astype(np.float32) @ self.single.T).astype(float)
            size = norm[:, None] * self.norm
            error = (2 * self.gamma * size + 2.0**-50 * (self.square + 2 * size)) * (1 + 2.0**-30)
            low, high = near - error, near + error
        sure = np.isfinite(low) & np.isfinite(high)
        return np.where(sure, low, -np.inf), np.where(sure, high, np.inf)

    def nearest(self, x: np.ndarray, shown: list[int] | None = None) -> np.ndarray:
        low, high = self.intervals(x)
        left = low <= high.min(1)[:, None]
        out = left.argmax(1)
        open_rows = np.flatnonzero(left.sum(1) > 1)
        if shown is not None:
            shown[0] += int(left[open_rows].sum())
        if not len(open_rows):
            return out
        if not self.narrow:
            for i in open_rows.tolist():
                row = x[i].tolist()
                out[i] = min(np.flatnonzero(left[i]).tolist(), key=lambda j: (square(row, self.rows[j]), j))
            return out
        at, number = np.nonzero(left[open_rows])
        true = np.full((len(open_rows), len(self.rows)), MOST_LONG)
        true[at, number] = ((x[open_rows[at]].astype(np.int64) - self.whole[number]) ** 2).sum(1)
        out[open_rows] = true.argmin(1)  # the first of equals
        return out

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> list[int]:
        if self.narrow:
            return ((x.astype(np.int64) - self.whole[cluster]) ** 2).sum(1).tolist()
        return [square(r, self.rows[c]) for r, c in zip(x.tolist(), cluster.tolist())]

    def nearest_wide(self, row: list[int]) -> tuple[int, int]:
        """(distance, number) of a row of numbers of any size."""
        return min((square(row, c), j) for j, c in enumerate(self.rows))


def whole_vectors(table: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x, wide, bits) of the rows kept: floor(scale * component) in 32
    bits as ``x`` or, where one is beyond ``NARROW``, as decimal texts."""
    e = F.col("embedding").cast("array<double>")
    usable = e.isNotNull() & (F.size(e) == dimensions) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(usable)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                scaled = np.floor(values * float(scale))
            largest = np.abs(scaled).max(1)
            narrow = largest <= NARROW
            x = np.where(narrow[:, None], scaled, 0).astype("<i4")
            exact = {i: [math.floor(Fraction(v) * scale) for v in values[i].tolist()] for i in np.flatnonzero(~narrow).tolist()}
            bits = [max(abs(v).bit_length() for v in exact[i]) if i in exact else int(largest[i]).bit_length() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([None if i in exact else r.tobytes() for i, r in enumerate(x)], pa.binary()),
                    pa.array([[str(v) for v in exact[i]] if i in exact else None for i in range(len(x))], pa.list_(pa.string())),
                    pa.array(bits, pa.int32()),
                ],
                names=["vec_id", "x", "wide", "bits"],
            )

    return kept.mapInArrow(convert, "vec_id long, x binary, wide array<string>, bits int")


def opened(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Numbers and vectors of a batch's narrow rows, and its wide rows by number."""
    packed = batch.column("x")
    narrow = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
    x = np.frombuffer(b"".join(packed.drop_null().to_pylist()), "<i4").reshape(-1, dimensions)
    wide = {}
    if len(narrow) < batch.num_rows:
        wide = {i: [int(v) for v in row] for i, row in enumerate(batch.column("wide").to_pylist()) if row is not None}
    return narrow, x, wide


def moved(vectors: DataFrame, centroids: list[list[int]], bits: int) -> list[list[int]]:
    """The centroids after one round."""
    dimensions, limbs = len(centroids[0]), 1 + max(0, -(-(bits + ROOM - 62) // LIMB))
    low = (1 << LIMB) - 1

    def split(value: int) -> list[int]:
        return [(value >> (LIMB * i)) & low for i in range(limbs - 1)] + [value >> (LIMB * (limbs - 1))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Centroids(centroids)
        counts, sums = [0] * len(centroids), np.zeros((len(centroids), dimensions), object)
        for batch in batches:
            _, x, wide = opened(batch, dimensions)
            if len(x):
                cluster = here.nearest(x)
                for j in np.unique(cluster).tolist():
                    mine = x[cluster == j]
                    counts[j] += len(mine)
                    sums[j] += mine.sum(0, dtype=np.int64).astype(object)
            for row in wide.values():
                _, j = here.nearest_wide(row)
                counts[j] += 1
                sums[j] += np.array(row, object)
        some = [j for j, n in enumerate(counts) if n]
        parts = [[limb for v in sums[j].tolist() for limb in split(int(v))] for j in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[j] for j in some], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("x", "wide").mapInArrow(summed, "cluster int, n long, sums array<long>")
    width = dimensions * limbs
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    out = list(centroids)
    for row in totals.collect():  # a row a cluster
        flat = [row[f"s{i}"] for i in range(width)]
        out[row["cluster"]] = [sum(flat[d * limbs + i] << (LIMB * i) for i in range(limbs)) // row["n"] for d in range(dimensions)]
    return out


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, model: dict | None = None) -> DataFrame:
    """Every kept row of ``table`` (vec_id, embedding) with its cluster: vec_id,
    cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Rows whose vector is null, of another length, or holds a null or
    non-finite component are left out.  The first centroids are the vectors
    with the least SHA-256 of ``seed:vec_id`` (a null id as an empty text, equal
    ids by the stored vector); with fewer vectors there are fewer clusters.
    Rows that share an id are rows of their own.  A component may have any size
    a double has; sums are exact.  A distance or inertia beyond 64 bits is
    null.  Rounds end early once no centroid moves, as nothing can change any
    more.  An empty table gives an empty result; other columns are not read.
    ``model`` is filled with the final centroids and the rounds run.
    """
    spark = table.sparkSession
    vectors = stage(whole_vectors(table, dimensions, scale), "vectors")
    bits = vectors.agg(F.max("bits")).first()[0]
    if bits is None:
        return spark.createDataFrame([], RESULT)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(text, 256), "x", "wide").limit(clusters).select("x", "wide").collect()
    centroids = [[int(v) for v in r["wide"]] if r["x"] is None else np.frombuffer(r["x"], "<i4").tolist() for r in first]
    ran = 0
    for ran in range(1, rounds + 1):
        before, centroids = centroids, moved(vectors, centroids, bits)
        if centroids == before:
            break

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Centroids(centroids)
        for batch in batches:
            narrow, x, wide = opened(batch, dimensions)
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            if len(x):
                cluster[narrow] = found = here.nearest(x)
                for i, d in zip(narrow.tolist(), here.distances(x, found)):
                    distance[i] = d
            for i, row in wide.items():
                distance[i], cluster[i] = here.nearest_wide(row)
            fits = pa.array([d if d <= MOST_LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), fits], names=["vec_id", "cluster", "distance"])

    rows = stage(vectors.select("vec_id", "x", "wide").mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    inertia = {r["cluster"]: int(r["d"]) if r["n"] == r["known"] else None for r in sums}
    total = None if None in inertia.values() else sum(inertia.values())
    fit = {None: None} | {v: v if v is None or v <= MOST_LONG else None for v in [*inertia.values(), total]}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, fit[v], fit[total], digests[c]) for c, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if model is not None:
        model |= {"centroids": centroids, "rounds": ran}
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
