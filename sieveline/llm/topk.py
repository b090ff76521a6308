"""Exact top-k inner products through a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance r to it.  The vectors
of a pivot, in the order of r, are cut into annuli; an annulus is a cell, and a
cell with more than SLOT vectors (many equal ones, say) is dealt over several
slots.  Of each cell the driver knows the pivot, the range of r and the largest
norm: for a query q no member can score above q.p + |q| r, nor, by the triangle
inequality, above (|q|^2 + |x|^2 - (|q-p| - r)^2) / 2 with the largest |x| and
the nearest r.

1. Each query visits one slot of each of the FIRST cells with the highest
   bounds; the k-th score found is its threshold.
2. It then visits all other slots of those cells alone whose bound reaches the
   threshold.

A round sends each vector to its slot once and each query to the slots it
visits.  A task reads a slot's vectors, then streams the queries, and inside the
slot takes blocks of vectors in the order of their bounds until no query can
gain.  It sends at most k rows for each query.

The numbers of pivots, annuli and cells grow with the table up to fixed limits
(PIVOTS, ANNULI and their product), so what the driver holds and broadcasts is
bounded; beyond them the slots of a cell grow in number.

Scores are exact: components become floor(scale * x), and a table in which a
score could reach 2**53 is refused with an error.

Defined edge cases: vectors null or with null or non-finite components take no
part; neither do null ids; of different lengths, the shorter is padded with
zeros; a query's id is no candidate of its own, however often it repeats; of
several vectors under one query id the smallest (by its components) asks;
repeated candidate rows each count; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, table

#: Fewest and most pivots, and vectors of one pivot on average.
PIVOTS, PIVOT_ROWS = (32, 1024), 4096
#: Most annuli of a pivot.
ANNULI = 64
#: Rows of a block; queries compared at once; fewest and most vectors of a slot.
BLOCK, GROUP, SLOT = 512, 2048, (2048, 1 << 16)
#: Cells that a query visits first.
FIRST = 3
#: Queries whose bounds are computed at once.
BOUNDS = 256
RESULT = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors with integer components."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dim))
    flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - starts] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0))


def _keyed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, pivot, r, size) with the squared norm as size."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            d = _distances(x, pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near]), pa.array((x**2).sum(1))], names=["id", "v", "pivot", "r", "size"])

    return vectors.mapInArrow(run, "id long, v array<double>, pivot int, r double, size double")


class Index:
    """What all tasks know: pivots, and of each cell its pivot, range of r, largest size and slots."""

    def __init__(self, pivots: np.ndarray, cells: np.ndarray):
        self.pivots = pivots
        self.pivot, self.low, self.high, self.size = cells[:, 0].astype(int), cells[:, 1], cells[:, 2], cells[:, 3]
        self.slots = cells[:, 4].astype(np.int64)
        self.first = np.cumsum(self.slots) - self.slots
        self.cell_of = np.repeat(np.arange(len(cells)), self.slots)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Above each score of queries with members of each cell, with slack for rounding."""
        return bound(q, self.pivots, self.pivot, self.low, self.high, self.size)

    def visits(self, q: np.ndarray, ids: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, slot): the first visits, or with thresholds all others that may gain."""
        bounds = self.bounds(q)
        some = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        slots = self.first[some] + np.abs(ids)[:, None] % self.slots[some]
        if least is None:
            return np.repeat(np.arange(len(q)), some.shape[1]), slots.ravel()
        row, cell = np.nonzero(bounds >= least[:, None])
        many = self.slots[cell]
        row, slot = np.repeat(row, many), np.repeat(self.first[cell] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        seen = (slot[:, None] == slots[row]).any(axis=1)
        return row[~seen], slot[~seen]


def bound(q, pivots, pivot, low, high, size) -> np.ndarray:
    to, dot, norm = _distances(q, pivots)[:, pivot], (q @ pivots.T)[:, pivot], (q**2).sum(1)[:, None]
    gap = np.maximum(np.maximum(to - high, low - to), 0)
    most = np.minimum(dot + np.sqrt(norm) * high, (norm + size - gap**2) / 2)
    return most + 1e-6 * (1 + np.abs(most))


def _visits(queries: DataFrame, index, asked_first: bool) -> DataFrame:
    """(slot, kind, id, v, x) of queries (id, v, least): one row a visit, x the threshold."""

    def run(batches):
        known = index.value
        for batch in batches:
            for k in range(0, batch.num_rows, BOUNDS):
                part = batch.slice(k, BOUNDS)
                least = part.column(2).to_numpy(zero_copy_only=False)
                row, slot = known.visits(_matrix(part.column(1), known.pivots.shape[1]), part.column(0).to_numpy(), None if asked_first else least)
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(np.ones(len(row)), pa.int32()), *some.columns], names=["slot", "kind", "id", "v", "x"])

    return queries.mapInArrow(run, "slot long, kind int, id long, v array<double>, x double")


class _Slot:
    """The vectors of one slot in blocks by distance, and the search for queries."""

    def __init__(self, known: Index, slot: int, parts: list[pa.RecordBatch]):
        x, ids, r = _matrix(pa.chunked_array([p.column(3) for p in parts]), known.pivots.shape[1]), *(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 4))
        order = np.lexsort((ids, r))
        self.x, self.ids, r = x[order], ids[order], r[order]
        cuts = np.arange(0, len(r), BLOCK)
        pivot = np.full(len(cuts), known.pivot[known.cell_of[slot]])
        self.edges = np.append(cuts, len(r))
        self.args = known.pivots, pivot, r[cuts], r[self.edges[1:] - 1], np.maximum.reduceat((self.x**2).sum(1), cuts)

    def search(self, q: np.ndarray, qid: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = bound(q, *self.args)
        best, names = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for i in np.argsort(-bounds.max(0), kind="stable"):
            # equal scores may win by their id
            some = np.flatnonzero(bounds[:, i] >= np.maximum(best[:, -1], least))
            if not len(some):
                continue
            a, b = self.edges[i], self.edges[i + 1]
            score = q[some] @ self.x[a:b].T
            score[(qid[some][:, None] == self.ids[None, a:b]) | (score < least[some][:, None])] = -np.inf
            score = np.concatenate((best[some], score), axis=1)
            who = np.concatenate((names[some], np.broadcast_to(self.ids[a:b], (len(some), b - a))), axis=1)
            top = np.lexsort((who, -score), axis=1)[:, :k]
            best[some], names[some] = np.take_along_axis(score, top, 1), np.take_along_axis(who, top, 1)
        row, col = np.nonzero(np.isfinite(best))
        return qid[row], names[row, col], best[row, col].astype(np.int64)


def _search(index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, parts, slot = index.value, -1, [], None
        for batch in batches:
            slots, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(slots) != 0) | (np.diff(kinds) != 0), [True]))) if len(slots) else np.zeros(0, int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if slots[a] != now:
                    now, parts, slot = slots[a], [], None
                if kinds[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                slot = slot or _Slot(known, now, parts)
                for c in range(a, b, GROUP):
                    some = batch.slice(c, min(GROUP, b - c))
                    found = slot.search(_matrix(some.column(3), known.pivots.shape[1]), some.column(2).to_numpy(), some.column(4).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def _annuli(keyed: DataFrame, slot: int) -> tuple[DataFrame, list]:
    """(cell, id, v, r, size), and the (pivot, low, high, size, slots) of each cell in order."""
    shares = [i / ANNULI for i in range(1, ANNULI)]
    told = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", F.array(*[F.lit(x) for x in shares]), 2000).alias("q")).orderBy("pivot").collect()
    cuts, base = {}, {}
    for row in told:
        many = min(ANNULI, -(-row["n"] // slot))
        cuts[row["pivot"]] = np.unique([row["q"][i * ANNULI // many - 1] for i in range(1, many)])
        base[row["pivot"]] = sum(len(x) + 1 for x in cuts.values()) - len(cuts[row["pivot"]]) - 1

    def run(batches):
        for batch in batches:
            pivot, r = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cell = np.zeros(len(r), np.int64)
            for p in np.unique(pivot):
                cell[pivot == p] = base[p] + np.searchsorted(cuts[p], r[pivot == p])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "id", "v", "pivot", "r", "size"])

    placed = keyed.mapInArrow(run, "cell long, id long, v array<double>, pivot int, r double, size double")
    cells = placed.groupBy("cell").agg(F.min("pivot"), F.min("r"), F.max("r"), F.max("size"), F.count(F.lit(1))).orderBy("cell").collect()
    return placed, [(c[0], c[1], c[2], c[3], c[4], -(-c[5] // slot)) for c in cells]


def top_k(vectors: DataFrame, is_query: F.Column, *, k: int = 20, scale: int = 64, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over
    all rows but its own, ties to the smaller id.  ``is_query`` marks queries."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale, id_col, vector_col)
    n, dim, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    if dim * largest**2 >= 2.0**53:
        raise ValueError(f"components up to {largest} in {dim} dimensions: scores would not be exact")
    many = pivots or min(PIVOTS[1], max(PIVOTS[0], n // PIVOT_ROWS))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(many).collect()  # a bounded number of rows
    points = np.zeros((len(chosen), dim))
    for i, row in enumerate(chosen):
        points[i, : len(row["v"])] = row["v"]
    slot = min(SLOT[1], max(SLOT[0], n // partitions(spark)))
    placed, cells = _annuli(settle(_keyed(rows, points), "keyed"), slot)
    index = spark.sparkContext.broadcast(Index(points, np.array([c[1:] for c in cells])))  # PIVOTS * ANNULI cells at most
    at, first = [], 0
    for c in cells:
        at.append((c[0], first, c[5]))
        first += c[5]
    slots = spark.createDataFrame(at, "cell long, first long, slots long")
    filed = placed.join(F.broadcast(slots), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), "slots")).alias("slot"), F.lit(0).alias("kind"), "id", "v", F.col("r").alias("x"))
    queries = settle(scaled(vectors.where(is_query), scale, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("least", F.lit(float("-inf"))), "queries")

    def visit(asked: DataFrame, asked_first: bool) -> DataFrame:
        together = filed.unionByName(_visits(asked, index, asked_first)).repartition(max(partitions(spark), min(first, 100_000)), "slot")
        return settle(together.sortWithinPartitions("slot", "kind").mapInArrow(_search(index, k), RESULT), "found")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = visit(queries, True)
    kth = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    told = queries.join(kth, "id", "left").select("id", "v", F.coalesce("kth", "least").alias("least"))
    found = found.unionByName(visit(told, False))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
