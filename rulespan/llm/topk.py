"""Operator 8: exact top-k by inner product through a pivot-distance index.

Vectors are lifted onto a sphere (one more coordinate makes all norms equal),
where the largest inner products are the nearest neighbours.  Each vector is
keyed by its nearest pivot and by an annulus of its distance from it; annuli
next to each other are stored as blocks of bounded size.  A first round expands
the annuli next to each query until k candidates are met, which bounds its
k-th best.  The second round visits just the blocks that the triangle
inequality cannot rule out at that bound.

Queries of near pivots go in packs, vectors in blocks, so a block travels once
for each pack that wants it and the work is a matrix product for the queries of
the pack that do.  Pivots grow with the square root of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.common import arrow_batches, stage

K = 10
SCALE = 1024
EVERY = 100
LEAST_PIVOTS, MOST_PIVOTS, ROWS_A_PIVOT = 8, 256, 64
ANNULI = 48
BLOCK = 2048
PACK = 512
TILES = 32
NO_ID = (1 << 63) - 1


def _matrix(lists: pa.Array, width: int, rows: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if rows and (sizes == width).all():
        return flat.reshape(rows, width)
    out = np.zeros((rows, width), flat.dtype)
    row = np.repeat(np.arange(rows), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the usable rows: every component finite, floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    usable = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(usable).select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v)).alias("x"))


class Sphere:
    """Pivots and distances in the lifted space."""

    def __init__(self, pivots: np.ndarray, square: float, annuli: int):
        self.pivots, self.square, self.annuli = pivots.astype(float), max(square, 1.0), annuli
        self.lift = np.sqrt(np.maximum(0, self.square - (self.pivots**2).sum(1)))
        self.width = 2 * np.sqrt(self.square) / annuli
        self.slack = 1e-6 * np.sqrt(self.square)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and annulus of each vector."""
        lift = np.sqrt(np.maximum(0, self.square - (x**2).sum(1)))
        far = np.sqrt(np.maximum(0, 2 * self.square - 2 * (x @ self.pivots.T + lift[:, None] * self.lift)))
        cell = far.argmin(1)
        return cell, np.minimum(self.annuli - 1, far[np.arange(len(x)), cell] // self.width).astype(int)

    def bounds(self, q: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least distance from each query to anything in the annuli ``low`` to
        ``high`` about the pivot ``cell``."""
        to = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + self.square - 2 * q @ self.pivots.T))[:, cell]
        outer = np.where(high == self.annuli - 1, np.inf, (high + 1) * self.width)
        return np.maximum(0, np.maximum(low * self.width - to, to - outer) - self.slack)

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a vector has just this score with the query."""
        return np.sqrt(np.maximum(0, (q**2).sum(1) + self.square - 2 * score)) + self.slack


def merge_annuli(sizes: list[tuple[int, int, int]], block: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Blocks of neighbouring annuli: rows (cell, lowest, highest annulus,
    vectors) of up to about ``block`` vectors, an annulus that alone has more
    being a row, and for each of ``sizes`` (cell, annulus, vectors) its row."""
    rows: list[list[int]] = []
    of = []
    for cell, annulus, n in sorted(sizes):
        if not rows or rows[-1][0] != cell or rows[-1][3] + n > block:
            rows.append([cell, annulus, annulus, 0])
        rows[-1][2], rows[-1][3] = annulus, rows[-1][3] + n
        of.append((cell, annulus, len(rows) - 1, -(-max(n, 1) // block)))
    return np.array(rows, np.int64).reshape(-1, 4), of


def pack_cells(counts: dict[int, int], pivots: np.ndarray, pack: int) -> list[tuple[int, int, int]]:
    """(cell, pack, parts): cells with few queries share a pack with the cells
    next to them on a walk from pivot to nearest pivot; one with many has
    ``parts`` packs from ``pack`` on."""
    left, out, number, room = sorted(counts), [], -1, 0
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = counts[at]
        parts = -(-n // pack)
        if parts > 1 or n > room:
            number, room = number + 1, pack
        out.append((at, number, parts))
        room -= n
        number += parts - 1
        if left:
            at = min(left, key=lambda c: float(((pivots[c] - pivots[at]) ** 2).sum()))
    return out


def top_k(table: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, annuli: int = ANNULI, block: int = BLOCK, pack: int = PACK, seen: dict | None = None) -> DataFrame:
    """For each row of ``table`` (vec_id, embedding) whose id is divisible by
    ``every``: its ``k`` best other rows as query_id, rank, vec_id, score.

    Scores are integer inner products, ties go to the smaller vec_id.  Rows
    that are null or hold a null or non-finite component take no part;
    shorter vectors count as padded with zeros; rows that share an id are rows
    of their own, each a query and each the other's candidate; a row without
    an id is only a candidate, after others in ties.  With fewer than k other
    rows all are returned; an empty table gives an empty result.  ``seen`` is
    filled with how many vectors there are and how many each round shows the
    queries on average.
    """
    spark = table.sparkSession
    ints = stage(integer_vectors(table, scale), "vectors")
    largest = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v)))
    shape = ints.agg(F.count("*").alias("rows"), F.max(F.size("x")).alias("width"), F.max(largest).alias("largest"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("square")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if shape["width"] is None:
        return spark.createDataFrame([], result)
    width, square = int(shape["width"]), float(shape["square"])
    exact = square < 2.0**53
    kind = "<i2" if shape["largest"] < 1 << 15 else "<i4" if shape["largest"] < 1 << 31 else "<i8"
    pivots = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, np.sqrt(shape["rows"] / ROWS_A_PIVOT))))
    chosen = ints.orderBy(F.xxhash64("x", "vec_id")).limit(pivots).collect()
    centres = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        centres[i, : len(r["x"])] = r["x"]
    sphere = Sphere(centres, square, annuli)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            x = _matrix(batch.column("x"), width, batch.num_rows)
            cell, annulus = sphere.place(x.astype(float))
            uid = row + np.arange(len(x))
            row += len(x)
            ids = batch.column("vec_id").fill_null(NO_ID)
            packed = pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(kind))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid), ids, packed, pa.array(cell.astype(np.int32)), pa.array(annulus.astype(np.int32))], names=["uid", "vec_id", "x", "cell", "annulus"])

    placed = stage(ints.mapInArrow(index, "uid long, vec_id long, x binary, cell int, annulus int"), "index")
    sizes = placed.groupBy("cell", "annulus").agg(F.count("*").alias("n")).collect()  # at most pivots * annuli rows
    rows_of, block_of = merge_annuli([(r["cell"], r["annulus"], r["n"]) for r in sizes], block)
    cells, lowest, highest, many = rows_of.T

    def listed(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows"))

    where = F.broadcast(spark.createDataFrame(block_of, "cell int, annulus int, block int, parts int"))
    blocks = placed.join(where, ["cell", "annulus"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts"))
    blocks = stage(listed(blocks, ["block", "part"], "uid", "vec_id", "x").select("block", F.col("rows").alias("vectors")), "blocks")

    asking = placed.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
    asked = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    packs_of = F.broadcast(spark.createDataFrame(pack_cells(asked, centres, pack), "cell int, first int, parts int"))
    asking = asking.join(packs_of, "cell").select("uid", "vec_id", "x", (F.col("first") + F.pmod(F.xxhash64("uid"), "parts")).alias("pack"))
    asking = stage(asking, "queries")

    def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(rows.field("x").to_pylist()), kind).reshape(len(rows), width)
        return rows.field("uid").to_numpy(), rows.field("vec_id").to_numpy(), x

    def open_blocks(q: np.ndarray, floor: np.ndarray | None) -> np.ndarray:
        """Which blocks (columns) each query (row) has to see: without a floor
        the next ones that together hold more than k vectors."""
        low = sphere.bounds(q, cells, lowest, highest)
        if floor is not None:
            return low <= np.where(np.isfinite(floor), sphere.reach(q, floor), np.inf)[:, None]
        order = np.argsort(low, axis=1, kind="stable")
        need = np.cumsum(many[order], axis=1) - many[order] <= k
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, need, axis=1)
        return out

    def floors_of(rows: pa.Array, first: bool) -> np.ndarray | None:
        return None if first else rows.field("floor").to_numpy()

    def wanted(packs: DataFrame, first: bool) -> DataFrame:
        """(pack, block, shown) that some queries of a pack have to see."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, name in enumerate(batch.column("pack").to_pylist()):
                    rows = batch.column("rows").slice(i, 1).flatten()
                    shown = open_blocks(unpack(rows)[2].astype(float), floors_of(rows, first)).sum(0)
                    some = np.flatnonzero(shown)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name, np.int64)), pa.array(some.astype(np.int32)), pa.array(shown[some] * many[some])], names=["pack", "block", "shown"])

        return packs.mapInArrow(choose, "pack long, block int, shown long")

    def visit(packs: DataFrame, asked: DataFrame, first: bool) -> DataFrame:
        """Best rows of each query in each block it is shown, above its floor."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = batch.column("rows").slice(i, 1).flatten()
                    here = batch.column("block")[i].as_py()
                    qid, name, q = unpack(rows)
                    floor = floors_of(rows, first)
                    mine = np.flatnonzero(open_blocks(q.astype(float), floor)[:, here])
                    uid, vec, x = unpack(batch.column("vectors").slice(i, 1).flatten())
                    s = (q[mine].astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q[mine].astype(np.int64) @ x.T.astype(np.int64)
                    out = []
                    for j, r in enumerate(mine.tolist()):
                        least = floor[r] if floor is not None and np.isfinite(floor[r]) else -float(1 << 63)
                        ok = np.flatnonzero((s[j] >= least) & (uid != qid[r]))
                        if len(ok) > 4 * k:
                            edge = np.partition(s[j, ok], len(ok) - k)[len(ok) - k]
                            ok = ok[s[j, ok] >= edge]
                        best = ok[np.lexsort((uid[ok], vec[ok], -s[j, ok]))[:k]]
                        out.append((np.full(len(best), qid[r]), np.full(len(best), name[r]), uid[best], vec[best], s[j, best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=["qid", "query_id", "uid", "vec_id", "score"])

        shown = asked.select("pack", "block").join(packs, "pack").join(blocks, "block")
        best = shown.select("block", "rows", "vectors").mapInArrow(score, "qid long, query_id long, uid long, vec_id long, score long")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "uid")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = float("-inf")
    with arrow_batches(spark, TILES):  # a row is a pack and a block
        packs = stage(listed(asking, ["pack"], "uid", "vec_id", "x"), "packs")
        near = stage(wanted(packs, True), "wanted")
        first = stage(visit(packs, near, True), "first")
        floors = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floors = floors.select(F.col("qid").alias("uid"), F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(none).alias("floor"))
        bound = asking.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(none)))
        packs = stage(listed(bound, ["pack"], "uid", "vec_id", "x", "floor"), "packs")
        within = stage(wanted(packs, False), "wanted")
        best = stage(visit(packs, within, False), "best")
    if seen is not None:
        queries = max(1, sum(asked.values()))
        seen |= {"vectors": shape["rows"]} | {name: (w.agg(F.sum("shown")).first()[0] or 0) / queries for name, w in (("first", near), ("second", within))}
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
