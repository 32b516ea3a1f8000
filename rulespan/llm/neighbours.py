"""Operator 13: approximate nearest neighbours through a forest of hash prefixes.

Vectors are lifted onto a sphere, where the largest inner products are the
least angles.  A tree writes each vector as a long string of bits, one for the
side of a random plane it is on (planes pass through the median of a bounded
sample, so trees are even); kept in order, the strings that share the longest
prefix with a query's stand beside it.  A query descends all trees to its
longest matches and then ascends them together, one bit at a time, until the
rows below the reached prefixes are enough.  How many are enough is learned: a
bounded sample of queries is answered by brute force, and the least number that
finds the wanted share of their neighbours counts for all.

The forest is stored as cells: a tree's rows below one prefix, in parts of
bounded size.  Queries go to the cells below their prefixes, in packs of
bounded size, with vectors in single precision; the best few times k of all
cells are then measured exactly.  Equal vectors are one row of the forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespan.llm.common import stage

K = 20
EVERY = 20
TREES = 32
BITS = 48
TARGET = 0.95
FIT_ROWS = 4096  # vectors whose medians place the planes
FIT_QUERIES = 256  # queries answered by brute force to learn how far to ascend
MOST_DEPTH = 16
CELL = 4096
PACK = 1024
SHORTLIST = 2
SEED = 13
NO_ID = (1 << 63) - 1
RESULT = "query_id long, rank int, vec_id long, score double"


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows whose vector is neither null nor zero and has
    finite components only."""
    e = F.col("embedding").cast("array<double>")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(fine)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; short rows end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rows_of(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


class Forest:
    """The planes of all trees, and the strings of vectors."""

    def __init__(self, width: int, largest: float, radius: float, trees: int, bits: int, seed: int):
        self.largest, self.radius, self.trees, self.bits = largest, radius, trees, bits
        self.seed, self.width = seed, width
        self.middle = np.zeros(trees * bits)
        self._planes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_planes": None}  # tasks draw them again

    @property
    def planes(self) -> np.ndarray:
        if self._planes is None:
            self._planes = np.random.default_rng(self.seed).standard_normal((self.width + 1, self.trees * self.bits)).astype(np.float32)
        return self._planes

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Points of equal norm; a query keeps its direction."""
        x = x / self.largest
        norm = np.sqrt((x**2).sum(1))
        if query:
            return np.c_[x * (self.radius / np.maximum(norm, 1e-300))[:, None], np.zeros(len(x))]
        return np.c_[x, np.sqrt(np.maximum(0, self.radius**2 - norm**2))]

    def fit(self, x: np.ndarray) -> None:
        self.middle = np.median(self.lift(x, False) @ self.planes, axis=0)

    def strings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows by trees: the bits of a string as one number, the first highest."""
        out = np.zeros((len(x), self.trees), np.int64)
        for at in range(0, len(x), 1024):
            side = self.lift(x[at : at + 1024], query).astype(np.float32) @ self.planes > self.middle
            side = side.reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[at : at + 1024] = out[at : at + 1024] * 2 + side[:, :, b]
        return out


def shared_prefix(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """How many leading bits two strings share."""
    unlike = (a ^ b).astype(np.uint64)
    out = np.full(unlike.shape, bits)
    for b in range(bits):
        out = np.where((unlike >> np.uint64(b)) > 0, bits - 1 - b, out)
    return out


class Counts:
    """How many strings of each tree begin with any prefix of up to ``depth`` bits."""

    def __init__(self, per_prefix: np.ndarray, depth: int, bits: int):
        self.depth, self.bits = depth, bits
        self.before = np.c_[np.zeros(len(per_prefix), np.int64), np.cumsum(per_prefix, axis=1)]

    def below(self, codes: np.ndarray) -> np.ndarray:
        """Rows by lengths 0 to depth: strings of all trees that share so much."""
        trees = np.arange(codes.shape[1])
        out = np.zeros((len(codes), self.depth + 1), np.int64)
        for length in range(self.depth + 1):
            at = codes >> (self.bits - length)
            wide = self.depth - length
            out[:, length] = (self.before[trees, (at + 1) << wide] - self.before[trees, at << wide]).sum(1)
        return out

    def cells(self, depth: int) -> np.ndarray:
        """Trees by prefixes of ``depth`` bits: strings that begin so."""
        at = np.arange(0, (1 << self.depth) + 1, 1 << (self.depth - depth))
        return np.diff(self.before[:, at], axis=1)


def enough(counts: np.ndarray, best: list[np.ndarray], target: float) -> int:
    """The least number of rows to ascend to, so that the neighbours of the
    sample, whose longest shared prefixes are ``best``, are found often enough."""
    sizes = np.unique(counts)
    total = max(1, sum(len(b) for b in best))

    def recall(least: int) -> float:
        return sum(int((b >= level).sum()) for b, level in zip(best, levels_of(counts, least).tolist())) / total

    low, high = 0, len(sizes) - 1
    while low < high:
        middle = (low + high) // 2
        if recall(int(sizes[middle])) >= target:
            high = middle
        else:
            low = middle + 1
    return int(sizes[low])


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """The longest length at which a query meets ``least`` rows; 0 at worst."""
    ok = counts >= least
    return np.where(ok.any(1), counts.shape[1] - 1 - ok[:, ::-1].argmax(1), 0)


def dense(rows: DataFrame, trees: int, cells: int) -> np.ndarray:
    """(tree, cell, n) as a matrix; trees x cells is bounded by the parameters."""
    found = rows.groupBy("tree", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((trees, cells), np.int64)
    out[found["tree"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def counted(batches: Iterator[np.ndarray], trees: int, cells: int) -> pa.RecordBatch:
    """A task's (tree, cell, n) of the flat numbers tree * cells + cell."""
    sums: dict[int, int] = {}
    for flat in batches:
        for at, n in zip(*(c.tolist() for c in np.unique(flat, return_counts=True))):
            sums[at] = sums.get(at, 0) + n
    flat = np.fromiter(sums, np.int64, len(sums))
    return pa.RecordBatch.from_arrays([pa.array(flat // cells), pa.array(flat % cells), pa.array(np.fromiter(sums.values(), np.int64, len(sums)))], names=["tree", "cell", "n"])


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the row number of each repeat, and its place in the row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def dealt(uid: np.ndarray, tree: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number below ``of`` for each row, by its id and tree."""
    x = (uid.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.maximum(of, 1).astype(np.uint64)).astype(np.int64)


class Index:
    """The stored forest of a table and its search."""

    def __init__(self, table: DataFrame, k: int, trees: int, bits: int, cell: int, pack: int, most_depth: int, seed: int):
        self.spark, self.k, self.trees, self.bits, self.pack, self.seed = table.sparkSession, k, trees, bits, pack, seed
        self.rows = usable_vectors(table)
        largest = F.array_max(F.transform("embedding", F.abs))
        shape = self.rows.agg(F.max(F.size("embedding")).alias("width"), F.max(largest).alias("largest")).first()
        self.width = shape["width"]
        if self.width is None:
            return
        scale = float(shape["largest"])
        norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale))
        radius = float(np.sqrt(self.rows.agg(F.max(norm)).first()[0]))
        self.forest = Forest(self.width, scale, radius, trees, bits, seed)
        near = self.rows.orderBy(F.xxhash64(F.lit(seed), "embedding", "vec_id")).limit(FIT_ROWS).select("embedding").toArrow()
        self.forest.fit(matrix(near["embedding"].combine_chunks(), self.width))
        self.entries = self._stored()
        self.n = self.entries.count()
        self.depth = int(np.clip(np.ceil(np.log2(max(2, self.n))), 1, min(most_depth, bits)))
        self.counts = Counts(self._prefixes(), self.depth, bits)
        self.cell_depth = int(np.clip(np.ceil(np.log2(max(1, self.n / cell))), 0, self.depth))
        self.cell = cell

    def _stored(self) -> DataFrame:
        """Distinct vectors: uid, ids (the least k + 1 of its rows), x, short (in
        single precision and parts of the largest component) and codes, the
        strings of all trees."""
        forest, width, kinds = self.forest, self.width, "uid long, embedding array<double>, ids array<long>, x binary, short binary, codes binary"
        nth = F.row_number().over(Window.partitionBy("embedding").orderBy("id"))
        first = self.rows.select("embedding", F.coalesce("vec_id", F.lit(NO_ID)).alias("id")).withColumn("nth", nth).filter(F.col("nth") <= self.k + 1)
        distinct = first.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids"))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 40
            for batch in batches:
                x = matrix(batch.column("embedding"), width)
                uid = row + np.arange(len(x))
                row += len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), batch.column("embedding"), batch.column("ids"), blobs(x), blobs((x / forest.largest).astype("<f4")), blobs(forest.strings(x))],
                    names=["uid", "embedding", "ids", "x", "short", "codes"],
                )

        return stage(distinct.mapInArrow(index, kinds), "forest")

    def _prefixes(self) -> np.ndarray:
        trees, depth, shift = self.trees, self.depth, self.bits - self.depth

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flats = ((rows_of(b.column("codes"), "<i8", trees) >> shift) + (np.arange(trees) << depth) for b in batches)
            yield counted((f.ravel() for f in flats), trees, 1 << depth)

        return dense(self.entries.select("codes").mapInArrow(count, "tree long, cell long, n long"), trees, 1 << depth)

    def queries(self, every: int) -> tuple[DataFrame, DataFrame]:
        """The query rows (row, query_id, uid) and the distinct vectors that
        they ask for (uid, x, codes, counts by prefix length)."""
        wanted = self.rows.filter(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), "embedding")
        asking = stage(wanted.join(self.entries.select("embedding", "uid"), "embedding").select("row", "query_id", "uid"), "asking")
        forest, width, trees, before = self.forest, self.width, self.trees, self.spark.sparkContext.broadcast(self.counts)

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = rows_of(batch.column("x"), "<f8", width)
                codes = forest.strings(x, True)
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("x"), blobs(codes), pa.array(before.value.below(codes).tolist(), pa.list_(pa.int64()))], names=["uid", "x", "codes", "counts"])

        distinct = self.entries.select("uid", "x").join(asking.select("uid").distinct(), "uid", "left_semi")
        return asking, stage(distinct.mapInArrow(describe, "uid long, x binary, codes binary, counts array<long>"), "queries")

    def truth(self, sample: pa.Table) -> list[np.ndarray]:
        """For each query of the sample the longest prefix that each of its
        true neighbours shares with it in any tree."""
        k, width, trees, bits = self.k, self.width, self.trees, self.bits
        mine, q = sample["uid"].to_numpy(), rows_of(sample["x"], "<f8", width)
        strings = rows_of(sample["codes"], "<i8", trees)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, prefix = np.zeros((len(mine), 0)), np.zeros((len(mine), 0), np.int64)
            for batch in batches:
                uid, x, codes = batch.column("uid").to_numpy(), rows_of(batch.column("x"), "<f8", width), rows_of(batch.column("codes"), "<i8", trees)
                s = q @ x.T
                s[mine[:, None] == uid] = -np.inf
                top = np.argpartition(-s, k, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
                shared = np.stack([shared_prefix(strings[i], codes[t], bits).max(1) for i, t in enumerate(top)]) if len(mine) else top
                score, prefix = np.c_[score, np.take_along_axis(s, top, 1)], np.c_[prefix, shared]
                keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, prefix = np.take_along_axis(score, keep, 1), np.take_along_axis(prefix, keep, 1)
            at, nth = np.nonzero(np.isfinite(score))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score[at, nth]), pa.array(prefix[at, nth])], names=["query", "score", "prefix"])

        found = self.entries.select("uid", "x", "codes").mapInArrow(best, "query long, score double, prefix long")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        rows = found.withColumn("nth", nth).filter(F.col("nth") <= k).select("query", "prefix").toArrow()
        query, prefix = rows["query"].to_numpy(), rows["prefix"].to_numpy()
        return [prefix[query == i] for i in range(len(mine))]

    def visits(self, asked: DataFrame, depth: int, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
        """The cells of ``depth`` bits that queries (uid, level, codes, ...) go
        to: (cell, uid, level, code, ...), and the queries of each cell."""
        trees, bits, fields = self.trees, self.bits, {f.name: f.dataType.simpleString() for f in asked.schema.fields}

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = rows_of(batch.column("codes"), "<i8", trees)
                level = batch.column("level").to_numpy()
                short = np.minimum(level, depth)
                wide = depth - short
                row, nth = spread(np.where(level > 0, trees, 1) << wide)  # the root has all rows in any tree
                tree, inner = nth >> wide[row], nth & ((1 << wide[row]) - 1)
                code = codes[row, tree]
                cell = ((code >> (bits - short[row])) << wide[row]) + inner
                yield pa.RecordBatch.from_arrays([pa.array((tree << depth) + cell), *(batch.column(c).take(pa.array(row)) for c in keep), pa.array(code)], names=["cell", *keep, "code"])

        kinds = ", ".join(["cell long", *(f"{c} {fields[c]}" for c in keep), "code long"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield counted((b.column("cell").to_numpy() for b in expand(batches)), trees, 1 << depth)

        many = dense(asked.select("uid", "level", "codes", *(c for c in keep if c not in ("uid", "level"))).mapInArrow(count, "tree long, cell long, n long"), trees, 1 << depth)
        return asked.mapInArrow(expand, kinds), many

    def meet(self, asked: DataFrame, depth: int, keep: list[str], carry: list[str], work, kinds: str) -> DataFrame:
        """``work(entries, queries)`` for every part of every visited cell and
        every pack of its queries, as Arrow tables; results of type ``kinds``."""
        trees, bits = self.trees, self.bits
        visits, many = self.visits(asked, depth, keep)
        parts = -(-self.counts.cells(depth) // self.cell).ravel()
        packs = -(-many // self.pack).ravel()
        sizes = self.spark.sparkContext.broadcast((parts, packs))

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A visited cell's rows, in a part of it, once a pack of queries."""
            parts, packs = sizes.value
            for batch in batches:
                codes, uid = rows_of(batch.column("codes"), "<i8", trees), batch.column("uid").to_numpy()
                for tree in range(trees):  # a tree at a time: a batch of all would be as much larger
                    cell = (tree << depth) + (codes[:, tree] >> (bits - depth))
                    row, pack = spread(packs[cell])
                    part = dealt(uid[row], np.full(len(row), tree), parts[cell[row]])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[row]), pa.array(part), pa.array(pack), pa.array(codes[row, tree]), *(batch.column(c).take(pa.array(row)) for c in carry)], names=["cell", "part", "pack", "code", *carry])

        def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, packs = sizes.value
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                row, part = spread(parts[cell])
                pack = dealt(batch.column("uid").to_numpy()[row], cell[row], packs[cell[row]])
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(pack), *(batch.column(c).take(pa.array(row)) for c in batch.schema.names)], names=["part", "pack", *batch.schema.names])

        types = {f.name: f.dataType.simpleString() for f in self.entries.schema.fields}
        left = self.entries.select("codes", *dict.fromkeys(["uid", *carry])).mapInArrow(entries, ", ".join(["cell long", "part long", "pack long", "code long", *(f"{c} {types[c]}" for c in carry)]))
        right = visits.mapInArrow(to_parts, "part long, pack long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in visits.schema.fields))
        keys = ["cell", "part", "pack"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, kinds)

    def deep_counts(self, asked: DataFrame) -> DataFrame:
        """(uid, deep): for queries still in company at ``depth`` bits, how many
        strings of all trees share each greater length."""
        bits, depth = self.bits, self.depth
        lengths = np.arange(depth + 1, bits + 1)

        def count(here: pa.Table, queries: pa.Table) -> pa.Table:
            codes = np.sort(here["code"].to_numpy())
            at = queries["code"].to_numpy()[:, None] >> (bits - lengths)
            n = np.searchsorted(codes, (at + 1) << (bits - lengths)) - np.searchsorted(codes, at << (bits - lengths))
            return pa.table({"uid": queries["uid"], "deep": pa.array(n.tolist(), pa.list_(pa.int64()))})

        at_depth = asked.withColumn("level", F.lit(depth).cast("long")).select("uid", "level", "codes")
        found = self.meet(at_depth, depth, ["uid"], [], count, "uid long, deep array<long>")
        sums = [F.sum(F.col("deep")[i]) for i in range(len(lengths))]
        return found.groupBy("uid").agg(F.array(*sums).alias("deep"))

    def with_deep(self, asked: DataFrame, least: int) -> DataFrame:
        """Counts over all lengths where ``depth`` bits leave ``least`` or more."""
        if self.depth == self.bits:
            return asked
        company = F.element_at("counts", -1) >= least
        alone = F.array_repeat(F.lit(0).cast("long"), self.bits - self.depth)
        deep = self.deep_counts(asked.filter(company))
        return stage(asked.join(deep, "uid", "left").withColumn("counts", F.concat("counts", F.coalesce("deep", alone))).drop("deep"), "queries")

    def found(self, asked: DataFrame) -> DataFrame:
        """(quid, uid): the best few times k rows of each query's cells."""
        k, bits, width = SHORTLIST * self.k, self.bits, self.width

        kinds = {"quid": pa.int64(), "uids": pa.list_(pa.int64()), "near": pa.list_(pa.float32())}

        def score(here: pa.Table, queries: pa.Table) -> pa.Table:
            if not (here.num_rows and queries.num_rows):
                return pa.table({c: pa.array([], t) for c, t in kinds.items()})
            order = np.argsort(here["code"].to_numpy(), kind="stable")
            codes, uid = here["code"].to_numpy()[order], here["uid"].to_numpy()[order]
            x = rows_of(here["short"], "<f4", width)[order]
            q, level, code = rows_of(queries["q"], "<f4", width), queries["level"].to_numpy(), queries["code"].to_numpy()
            out, names = [], queries["uid"].to_numpy()
            prefix = code >> (bits - level)
            groups, group = np.unique(np.c_[level, prefix], axis=0, return_inverse=True)
            for g, (length, start) in enumerate(groups.tolist()):
                low, high = np.searchsorted(codes, [start << (bits - length), (start + 1) << (bits - length)])
                if low == high:
                    continue
                mine = np.flatnonzero(group.ravel() == g)
                s = q[mine] @ x[low:high].T
                best = np.argpartition(-s, k, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(mine), 1))
                out += zip(names[mine].tolist(), uid[low:high][best].tolist(), np.take_along_axis(s, best, 1).tolist())
            return pa.table({c: pa.array([o[j] for o in out], t) for j, (c, t) in enumerate(kinds.items())})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for quid, uids, near in zip(*(batch.column(c) for c in ("quid", "uids", "near"))):
                    uid, first = np.unique(uids.values.to_numpy(), return_index=True)
                    best = uid[np.argsort(-near.values.to_numpy()[first], kind="stable")[:k]]
                    out.append((np.full(len(best), quid.as_py()), best))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2, names=["quid", "uid"])

        def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = rows_of(batch.column("x"), "<f8", width)
                q = (q / np.abs(q).max(1)[:, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("level"), batch.column("codes"), blobs(q)], names=["uid", "level", "codes", "q"])

        ready = asked.select("uid", "level", "codes", "x").mapInArrow(narrowed, "uid long, level long, codes binary, q binary")
        near = self.meet(ready, self.cell_depth, ["uid", "level", "q"], ["uid", "short"], score, "quid long, uids array<long>, near array<float>")
        lists = near.groupBy("quid").agg(F.flatten(F.collect_list("uids")).alias("uids"), F.flatten(F.collect_list("near")).alias("near"))
        return lists.mapInArrow(whole, "quid long, uid long")

    def measured(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """(quid, uid, ids, score): the exact inner products of the pairs."""
        width = self.width

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = np.einsum("ij,ij->i", rows_of(batch.column("q"), "<f8", width), rows_of(batch.column("x"), "<f8", width))
                yield pa.RecordBatch.from_arrays([batch.column("quid"), batch.column("uid"), batch.column("ids"), pa.array(s)], names=["quid", "uid", "ids", "score"])

        both = pairs.join(self.entries.select("uid", "ids", "x"), "uid").join(asked.select(F.col("uid").alias("quid"), F.col("x").alias("q")), "quid")
        return both.mapInArrow(product, "quid long, uid long, ids array<long>, score double")


def nearest_neighbours(table: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, bits: int = BITS, target: float = TARGET, cell: int = CELL, pack: int = PACK, most_depth: int = MOST_DEPTH, seed: int = SEED, seen: dict | None = None) -> DataFrame:
    """For each row of ``table`` (vec_id, embedding) whose id is divisible by
    ``every``: the ``k`` rows with the largest inner products among those found,
    as query_id, rank, vec_id, score (exact, of the original vectors).

    Rows whose vector is null, zero, or holds a null or non-finite component
    take no part; shorter vectors count as padded with zeros.  Ties go to the
    smaller vec_id.  Rows that share an id or a vector are rows of their own:
    each is a query and the other's candidate; copies of a query are always
    found.  A row without an id is only a candidate, after others in ties.
    With k or fewer other rows all are candidates; an empty table gives an
    empty result; other columns are not read.  ``target`` is the share of true
    neighbours that the sample of ``FIT_QUERIES`` queries has to find.
    ``seen`` is filled with the vectors indexed, the rows to ascend to and the
    mean prefix length.
    """
    index = Index(table, k, trees, bits, cell, pack, most_depth, seed)
    if index.width is None:
        return index.spark.createDataFrame([], RESULT)
    asking, asked = index.queries(every)

    def drawn(queries: DataFrame) -> DataFrame:
        return queries.orderBy(F.xxhash64(F.lit(seed), "x")).limit(FIT_QUERIES)

    sample = drawn(asked).toArrow()
    if not sample.num_rows:
        return index.spark.createDataFrame([], RESULT)
    best = index.truth(sample)
    if np.mean(np.concatenate(best) >= index.depth if sum(map(len, best)) else [0]) >= target:
        asked = index.with_deep(asked, k)
        sample = drawn(asked).toArrow()
    counts = np.array(sample["counts"].to_pylist())
    least = max(enough(counts, best, target), min(k + 1, index.n))
    lengths = F.transform("counts", lambda n, i: F.when(n >= least, i).otherwise(0))
    asked = stage(asked.select("uid", "x", "codes", F.array_max(lengths).cast("long").alias("level")), "levels")
    if seen is not None:
        seen |= {"vectors": index.n, "rows": least, "length": asked.agg(F.avg("level")).first()[0]}

    own = asked.select(F.col("uid").alias("quid"), "uid")
    pairs = stage(index.found(asked).unionByName(own).distinct(), "pairs")
    scored = index.measured(pairs, asked)
    each = scored.select("quid", "uid", "score", F.explode("ids").alias("id")).groupBy("quid")
    listed = each.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "uid"))), 1, k + 1).alias("best"))
    rows = asking.join(listed, F.col("uid") == F.col("quid")).select("row", "query_id", F.col("quid"), "best")
    mine = F.array_position(F.transform("best", lambda b: (b["uid"] == F.col("quid")) & (b["id"] == F.col("query_id"))), F.lit(True))
    others = F.filter(F.transform("best", lambda b, i: F.when(i + 1 != F.col("mine"), b)), lambda b: b.isNotNull())
    rows = rows.withColumn("mine", mine).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "b"))
    minus = F.col("b")["minus"]
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.when(F.col("b")["id"] != NO_ID, F.col("b")["id"]).alias("vec_id"), F.when(minus == 0, 0.0).otherwise(-minus).alias("score"))
