"""Nearest neighbours by low-dimensional stable projections in kd-trees.

Gaussian projections to ``DIMS`` dimensions are 2-stable: the squared
projected distance of two vectors over their squared distance follows the
chi-square law with ``DIMS`` degrees of freedom.  A kd-tree hands out
projected neighbours nearest first, and each is verified on its original
vector.  With the k-th best distance d so far, a vector nearer than d lies
beyond projected distance x with a chance of at most ``1 - CDF(x² / d²)``; the
search stops when that falls under ``1 - CONFIDENCE``.

On Spark the projected space is cut into cells by a kd-tree over a bounded
sample; every row is indexed in its cell (a cell of many rows, for example
copies of one vector, is dealt to several shards).  A query searches its own
cell first; its k-th distance and the same chi-square test then say which
other cells it must visit.  Queries meet a shard in blocks of ``QUERY_BLOCK``.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import publish, table

DIMS, CONFIDENCE = 8, 0.99  # DIMS even
CELL_ROWS, MAX_CELLS, QUERY_BLOCK, LEAF = 8192, 65_536, 2048, 64
SAMPLE, SEED, K = 20_000, 11, 10


def chi_square_quantile(p: float, dims: int) -> float:
    """x with CDF(x) = p, for an even number of degrees of freedom."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))
    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Cells:
    """A kd-tree over a sample whose leaves are cells: boxes that cover the projected space."""

    def __init__(self, sample: np.ndarray, n: int):
        d = sample.shape[1] if sample.size else DIMS
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; a negative child is ~cell
        self.low, self.high = [], []
        self.root = self._grow(sample, n, np.full(d, -np.inf), np.full(d, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        if n > 1 and len(points) > 1:
            dim = int(np.ptp(points, axis=0).argmax())
            cut = float(np.quantile(points[:, dim], (n // 2) / n))
            left = points[:, dim] < cut
            if left.any() and not left.all():
                at = len(self.splits)
                self.splits.append((0, 0.0, 0, 0))
                mid_high, mid_low = high.copy(), low.copy()
                mid_high[dim] = mid_low[dim] = cut
                self.splits[at] = (dim, cut, self._grow(points[left], n // 2, low, mid_high), self._grow(points[~left], n - n // 2, mid_low, high))
                return at
        self.low.append(low)
        self.high.append(high)
        return ~(len(self.low) - 1)

    def place(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), "i4")
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            dim, cut, a, b = self.splits[node]
            left = points[rows, dim] < cut
            todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class KdTree:
    """A kd-tree over points in memory; nodes are (low, high, first, last, children)."""

    def __init__(self, points: np.ndarray):
        self.order, self.points = np.arange(len(points)), points
        self.nodes: list[tuple] = []
        if len(points):
            self._grow(0, len(points))

    def _grow(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, a, b, None))
        dim = int((high - low).argmax())
        if b - a > LEAF and high[dim] > low[dim]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, dim], mid)]
            self.nodes[at] = (low, high, a, b, (self._grow(a, a + mid), self._grow(a + mid, b)))
        return at

    def _gap(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        gap = np.maximum(0, np.maximum(low - q, q - high))
        return float(gap @ gap)

    def nearest_leaves(self, q: np.ndarray):
        """Leaves with their squared distance to ``q``, nearest first: ``(distance, rows)``."""
        heap = [(self._gap(0, q), 0)] if self.nodes else []
        while heap:
            gap, node = heapq.heappop(heap)
            _, _, a, b, children = self.nodes[node]
            if children is None:
                yield gap, self.order[a:b]
            else:
                for c in children:
                    heapq.heappush(heap, (self._gap(c, q), c))


def rounding(q_proj: np.ndarray) -> float:
    """Squared projected distance that rounding alone may give to equal vectors."""
    return 1e-9 * (1.0 + float(q_proj @ q_proj))


def search(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, q_id: int, q: np.ndarray, q_proj: np.ndarray, k: int, stop: float,
           bound: float = math.inf) -> list[tuple[float, int]]:
    """The ``k`` nearest rows found, ``(distance, id)`` in order; ``bound``: a k-th distance known already."""
    best: list[tuple[float, int]] = []
    slack = rounding(q_proj)
    for gap, rows in tree.nearest_leaves(q_proj):
        if gap > stop * bound * bound + slack:
            break
        away = tree.points[rows] - q_proj
        rows = rows[((away * away).sum(axis=1) <= stop * bound * bound + slack) & (ids[rows] != q_id)]
        diff = vectors[rows] - q
        dist = np.sqrt((diff * diff).sum(axis=1))
        near = dist <= bound
        if near.any():
            best = sorted([*best, *zip(dist[near].tolist(), ids[rows[near]].tolist(), strict=True)])[:k]
            if len(best) == k:
                bound = min(bound, best[-1][0])
    return best


def valid_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, vec`` (doubles as bytes) of the rows that take part.

    Left out: a null id or vector, a null or non-finite component, the zero
    vector, and vectors of another length than most (ties: the shorter).
    """
    v = F.col(column).cast("array<double>")
    rows = rows.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else -1))


def neighbours(rows: DataFrame, is_query, k: int = K, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query (ties to the smaller id).

    ``is_query`` is a condition on ``vec_id``.  Rows that share a ``vec_id``
    with the query are its own.  Fewer than ``k`` candidates: all of them.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, column)
    first = valid.select(F.size("v").alias("n")).first()
    dim = first["n"] if first else 1
    matrix = np.random.default_rng(SEED).standard_normal((dim, DIMS))
    n = valid.count()
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]  # bounded; for the cells' borders alone
    cells = Cells(np.stack([np.asarray(x) for x in sample]) @ matrix if len(sample) else np.zeros((0, DIMS)), min(MAX_CELLS, max(1, math.ceil(n / CELL_ROWS))))
    shared, stop = spark.sparkContext.broadcast(cells), chi_square_quantile(CONFIDENCE, DIMS)

    def index(batches):
        import pyarrow as pa
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = shared.value.place(v @ matrix) if len(v) else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(at)], names=["vec_id", "vec", "cell"])

    placed = publish(valid.mapInArrow(index, "vec_id long, vec binary, cell int"), "ann-index")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    salts = np.array([math.ceil(counts.get(c, 0) / (2 * CELL_ROWS)) or 1 for c in range(len(cells.low))])
    queries = placed.where(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"), F.col("cell").alias("home"))

    def meet(visits: DataFrame, step: str) -> DataFrame:
        """``query_id, vec_id, score`` of the best rows of every cell visited: ``visits (query_id, q, bound, cell)``."""
        load = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        blocks = np.array([math.ceil(load.get(c, 0) / QUERY_BLOCK) for c in range(len(salts))])
        per_cell = F.broadcast(spark.createDataFrame([(c, int(salts[c]), int(blocks[c])) for c in range(len(salts))], "cell int, salts int, blocks int"))
        shard = placed.join(per_cell, "cell").where("blocks > 0").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
        shard = shard.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "salt", "qb", "vec_id", "vec")
        asked = visits.join(per_cell, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("cell", "salt", "qb", "query_id", "q", "bound")
        schema = "query_id long, vec_id long, score double"

        def work(left, right):
            import pyarrow as pa
            out = []
            if left.num_rows and right.num_rows:
                ids = left["vec_id"].to_numpy()
                take = lambda c: np.frombuffer(b"".join(c.to_pylist()), "f8").reshape(len(c), dim)
                vectors, asking = take(left["vec"]), take(right["q"])
                tree = KdTree(vectors @ matrix)
                for q_id, q, bound in zip(right["query_id"].to_pylist(), asking, right["bound"].to_pylist(), strict=True):
                    out += [(q_id, i, d) for d, i in search(tree, ids, vectors, q_id, q, q @ matrix, k, stop, math.inf if bound is None else bound)]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        keys = ("cell", "salt", "qb")
        return publish(shard.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(work, schema), f"ann-{step}")

    near = meet(queries.select("query_id", "q", F.lit(None).cast("double").alias("bound"), F.col("home").alias("cell")), "home")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def reach(batches):
        import pyarrow as pa
        for batch in batches:
            part, rows = batch.to_pydict(), []
            for i, (q, home, bound) in enumerate(zip(part["q"], part["home"], part["bound"], strict=True)):
                at = np.frombuffer(q, "f8") @ matrix
                for c in np.flatnonzero(shared.value.distances(at) <= stop * (math.inf if bound is None else bound) ** 2 + rounding(at)):
                    if c != home:
                        rows.append((i, int(c)))
            at = [r[0] for r in rows]
            cols = [pa.array([part[c][i] for i in at], t) for c, t in (("query_id", pa.int64()), ("q", pa.binary()), ("bound", pa.float64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.int32())], names=["query_id", "q", "bound", "cell"])

    visits = publish(queries.join(kth, "query_id", "left").select("query_id", "q", "home", "bound").mapInArrow(
        reach, "query_id long, q binary, bound double, cell int"), "ann-visits")
    found = near.unionByName(meet(visits, "other")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
