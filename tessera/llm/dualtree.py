"""Product-quantised vector codes by dual-tree Lloyd rounds on integers.

Components become integers ``floor(1024 * x)`` and vectors are cut into ``parts`` equal parts, each with a codebook of
``entries`` entries.

Trees: vectors fall into blocks of ``BLOCK`` rows.  Over each part of a block a balanced kd-tree is built once and written
with the block: rows in tree order, the box of every node and the sums of its rows.  Another kd-tree stands over
a part's codebook entries.  A round takes pairs (node of parts, node of entries) down both trees together.  Squared
distances between boxes bound those between members: a pair whose least distance is above the least of the
largest distances of the same part node cannot hold a nearest entry and is pruned (never at equality, so ties stay).
A part node left with one entry is assigned whole by its cached sums; the other leaves compare their rows with
the entries left, in integers.  Integers are held in doubles while every square and sum stays below 2**53, where doubles
are exact, and in Python integers beyond.

Spark deals the blocks; a round hands on a block's sums by entry, added up by Spark.  The driver holds the codebooks
alone: parts * entries vectors, whatever the corpus.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; shorter vectors, and lengths that the
parts do not divide, are filled up with zeros; rows that repeat a ``vec_id`` each count, ordered by id (null last), then by
components; fewer kept rows than ``entries`` give smaller codebooks; an empty table gives no rows.  ``error`` and
``label_error`` are null where they pass 63 bits.  The input's columns come back in the struct ``row``.
"""

from __future__ import annotations

import hashlib
from math import floor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, publish, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 4096
LEAF = 64  # rows of a leaf
ENTRY_LEAF = 1
EXACT = 1 << 53
LIMB = 32


def integers(vectors: list, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, filled up with zeros to ``width``; exact, in doubles or Python integers."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    if np.abs(x).max(initial=0.0) * SCALE < EXACT:
        return np.floor(x * SCALE)
    return np.array([[int(c) * SCALE if abs(c) >= EXACT else floor(c * SCALE) for c in row] for row in x.tolist()], dtype=object)


def as_ints(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def exact_doubles(largest: int, width: int) -> bool:
    """Whether squared distances of vectors with integer components up to ``largest`` are exact in doubles, a block's sums too."""
    return 4 * width * largest * largest < EXACT and BLOCK * largest < EXACT


class Tree:
    """Balanced kd-tree: ``order`` puts rows in tree order; a node is rows ``start:stop`` of it, with its box and sum.

    Node ``i`` has the children ``2i + 1`` and ``2i + 2``; a level's nodes differ by at most a row, so all leaves have one depth."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.depth = max(0, (-(-len(x) // leaf) - 1).bit_length()) if len(x) else 0
        while self.depth and len(x) >> self.depth == 0:
            self.depth -= 1
        order = np.arange(len(x))
        bounds = [(0, len(x))]
        for level in range(self.depth):
            for start, stop in bounds[(1 << level) - 1:]:
                rows = order[start:stop]
                sub = x[rows]
                axis = int(np.argmax(sub.max(0) - sub.min(0)))
                mid = (stop - start) // 2
                rows = rows[np.argsort(sub[:, axis], kind="stable")]
                order[start:stop] = rows
                bounds += [(start, start + mid), (start + mid, stop)]
        self.order, self.bounds = order, np.array(bounds)
        self.x = x[order]
        if len(x):
            self.low = np.array([self.x[a:b].min(0) for a, b in bounds])
            self.high = np.array([self.x[a:b].max(0) for a, b in bounds])
            self.sums = np.array([self.x[a:b].sum(0) for a, b in bounds])

    @property
    def first_leaf(self) -> int:
        return (1 << self.depth) - 1


def assign(parts: Tree, book: Tree, visit) -> None:
    """Nearest entries of all rows: ``visit(node, entry)`` for part nodes assigned whole, ``visit(rows, entries)`` for rows compared one by one.

    Entries are numbers of ``book``'s own rows before the tree's order."""
    pairs = np.zeros((1, 2), dtype=np.int64)  # (part node, entry node), sorted
    while len(pairs):
        pairs = prune(parts, pairs, book.low[pairs[:, 1]], book.high[pairs[:, 1]])
        p, e = pairs[:, 0], pairs[:, 1]
        nodes, starts = np.unique(p, return_index=True)
        one = nodes[np.add.reduceat(book.bounds[e, 1] - book.bounds[e, 0], starts) == 1]
        for node, entry in zip(p[np.isin(p, one)].tolist(), e[np.isin(p, one)].tolist()):
            visit(node, int(book.order[book.bounds[entry, 0]]))
        pairs = pairs[~np.isin(p, one)]
        if not len(pairs):
            return
        p, e = pairs[:, 0], pairs[:, 1]
        if p[0] >= parts.first_leaf and (e >= book.first_leaf).all():
            break
        e2 = np.where(e < book.first_leaf, 2 * e + 1, e)
        pairs = np.concatenate([np.stack([p, e2], 1), np.stack([p, e2 + 1], 1)[e < book.first_leaf]])
        if p[0] < parts.first_leaf:
            pairs = np.concatenate([np.stack([2 * pairs[:, 0] + 1, pairs[:, 1]], 1), np.stack([2 * pairs[:, 0] + 2, pairs[:, 1]], 1)])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    # leaves against the entries of the entry leaves left
    sizes = book.bounds[e, 1] - book.bounds[e, 0]
    at = np.repeat(book.bounds[e, 0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pairs = np.stack([np.repeat(p, sizes), book.order[at]], 1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = prune(parts, pairs, book.raw[pairs[:, 1]], book.raw[pairs[:, 1]])
    nodes, starts = np.unique(pairs[:, 0], return_index=True)
    for node, cand in zip(nodes.tolist(), np.split(pairs[:, 1], starts[1:])):
        if len(cand) == 1:
            visit(node, int(cand[0]))
        else:
            start, stop = parts.bounds[node]
            visit(np.arange(start, stop), nearest(parts.x[start:stop], book.raw[cand], cand))


def prune(parts: Tree, pairs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The pairs (part node, box ``low`` to ``high``) that can hold a nearest entry; pairs are sorted by part node."""
    p = pairs[:, 0]
    gap = np.maximum(np.maximum(parts.low[p] - high, low - parts.high[p]), 0)
    reach = np.maximum(parts.high[p] - low, high - parts.low[p])
    nodes, starts, group = np.unique(p, return_index=True, return_inverse=True)
    best = np.minimum.reduceat((reach * reach).sum(1), starts)
    return pairs[(gap * gap).sum(1) <= best[group]]


def nearest(x: np.ndarray, entries: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Number of the nearest entry of each row; ``numbers`` ascend, so ties go to the lower one."""
    return numbers[np.argmin((entries * entries).sum(1) - 2 * x.dot(entries.T), axis=1)]


def book_tree(entries: np.ndarray) -> Tree:
    tree = Tree(entries, ENTRY_LEAF)
    tree.raw = entries
    return tree


def _blocks(width: int, parts: int):
    """(vector, row) → (rows, trees, largest): a tree for each part of a block's vectors."""
    def fn(batches):
        import pickle

        import pyarrow as pa

        def block(t):
            x = integers(t.column("vector").to_pylist(), width)
            largest = int(np.abs(x).max())
            if x.dtype != object and not exact_doubles(largest, width):
                x = as_ints(x)
            w = width // parts
            trees = [Tree(x[:, p * w:(p + 1) * w], LEAF) for p in range(parts)]
            rows = t.column("row").combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([lists, pa.array([pickle.dumps(trees)], pa.binary()), pa.array([str(largest)])], names=["rows", "trees", "largest"])

        held, n = [], 0
        for rb in batches:
            held.append(rb)
            n += rb.num_rows
            while n >= BLOCK:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, BLOCK))
                held, n = t.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield block(pa.Table.from_batches(held))
    return fn


def _trees(blob: bytes, largest: str, books: list[np.ndarray]):
    """A block's trees and the codebooks' trees, all in one number type in which distances are exact."""
    import pickle
    trees = pickle.loads(blob)
    most = max([int(largest), *(abs(int(v)) for b in books for v in (b.max(), b.min()))])
    plain = trees[0].x.dtype != object and exact_doubles(most, sum(t.x.shape[1] for t in trees))
    if not plain:
        for t in trees:
            t.x, t.low, t.high, t.sums = map(as_ints, (t.x, t.low, t.high, t.sums))
    return trees, [book_tree(b.astype(float) if plain else b) for b in books]


SUMS = "part int, entry int, place int, limb int, v long"


def _sums(books: list[np.ndarray]):
    """Blocks → the sums and counts (place -1) of each entry's parts, in limbs of 32 bits, a set a task."""
    def fn(batches):
        import pyarrow as pa
        n, w = books[0].shape
        total = np.zeros((len(books), n, w + 1), dtype=object)
        for rb in batches:
            for blob, largest in zip(rb.column("trees").to_pylist(), rb.column("largest").to_pylist()):
                trees, tops = _trees(blob, largest, books)
                for p, (tree, top) in enumerate(zip(trees, tops)):
                    sums = np.zeros((n, w + 1), dtype=tree.x.dtype)

                    def visit(at, entry, tree=tree, sums=sums):
                        if isinstance(entry, int):  # a whole node
                            start, stop = tree.bounds[at]
                            sums[entry, :w] += tree.sums[at]
                            sums[entry, w] += int(stop - start)
                        else:
                            np.add.at(sums[:, :w], entry, tree.x[at])
                            np.add.at(sums[:, w], entry, 1)

                    assign(tree, top, visit)
                    total[p] += as_ints(sums)
        limb = 0
        while (total != 0).any():
            last = (total >= -(1 << 62)) & (total < 1 << 62)
            low = np.where(last, total, total & ((1 << LIMB) - 1))
            p, e, c = np.nonzero(low)
            if len(p):
                cols = [pa.array(a, pa.int32()) for a in (p, e, np.where(c == w, -1, c), np.full(len(p), limb))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([int(v) for v in low[p, e, c]], pa.int64())], names=["part", "entry", "place", "limb", "v"])
            total = np.where(last, 0, total >> LIMB)
            limb += 1
    return fn


def _codes(books: list[np.ndarray], digits: int):
    """Blocks → rows with their code and error."""
    def fn(batches):
        import pyarrow as pa
        for rb in batches:
            lists = rb.column("rows")
            for i in range(rb.num_rows):
                rows = lists.slice(i, 1).flatten()
                trees, tops = _trees(rb.column("trees")[i].as_py(), rb.column("largest")[i].as_py(), books)
                codes, error = np.zeros((len(rows), len(books)), dtype=int), 0
                for p, (tree, top) in enumerate(zip(trees, tops)):
                    own = np.zeros(len(rows), dtype=int)

                    def visit(at, entry, tree=tree, own=own):
                        own[slice(*tree.bounds[at]) if isinstance(entry, int) else at] = entry

                    assign(tree, top, visit)
                    far = tree.x - top.raw[own]
                    back = np.empty(len(rows), dtype=int)
                    back[tree.order] = np.arange(len(rows))
                    codes[:, p] = own[back]
                    error = error + (far * far).sum(1)[back]
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                error = [v if (v := int(e)) < 1 << 63 else None for e in error]
                yield pa.RecordBatch.from_arrays([rows, pa.array(code), pa.array(error, pa.int64())], names=["row", "code", "error"])
    return fn


def first_books(kept: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks to begin with: the parts of the ``entries`` first vectors by id (null last), then by components."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = as_ints(integers([r["vector"] for r in first], width))
    w = width // parts
    return [x[:, p * w:(p + 1) * w] for p in range(parts)]


def next_books(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, entries move to floor(sum / count); unused entries stay."""
    sums = blocks.select("trees", "largest").mapInArrow(_sums(books), SUMS).groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v"))
    n, w = books[0].shape
    total = np.zeros((len(books), n, w + 1), dtype=object)
    for r in sums.collect():  # parts * entries * (width / parts + 1) numbers of a few limbs
        total[r["part"], r["entry"], r["place"]] += r["v"] << (LIMB * r["limb"])
    out = []
    for book, t in zip(books, total):
        used = t[:, w] > 0
        out.append(np.where(used[:, None], t[:, :w] // np.where(used, t[:, w], 1)[:, None], book))
    return out


def encode_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
                   entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((row, code, error), final codebooks as integers); ``row`` holds the input's columns."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    vector = F.col(f"row.`{vector_col}`")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(vector.isNotNull() & sound).select(vector.cast("array<double>").alias("vector"), F.col(f"row.`{id_col}`").alias("id"), "row")
    size = kept.agg(F.max(F.size("vector"))).head()[0]
    digits = max(2, len(f"{entries - 1:x}"))
    schema = kept.select("row", F.lit("").alias("code"), F.lit(None).cast("long").alias("error")).schema
    if size is None:
        return spark.createDataFrame([], schema), []
    width = max(parts, -(-size // parts) * parts)
    blocks = publish(kept.select("vector", "row").mapInArrow(_blocks(width, parts), kept.select(F.array("row").alias("rows"), F.lit(b"").alias("trees"), F.lit("").alias("largest")).schema), "vector-blocks")
    books = first_books(kept, width, parts, entries)
    for _ in range(rounds):
        books = next_books(blocks, books)
    return blocks.mapInArrow(_codes(books, digits), schema), books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for b in books for v in b.ravel())


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of each kept row of ``embeddings``; nulls, ties, repeats and empty tables as the module says."""
    prepare(spark)
    rows, books = encode_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = publish(rows.select("row.vec_id", "row.label", "code", "error"), "vector-codes")
    by_label = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "of")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds in SQL, unrolled; the vectors' length from the table."""
    assigned = """a{i} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT p.r, p.part, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - b.v[j]) * (p.v[j] - b.v[j])))::BIGINT AS d
   FROM pieces p JOIN b{i} b USING (part)) GROUP BY r, part)"""
    moved = """m{i} AS (SELECT part, entry, j, CAST(floor_div(sum(p.v[j]), count(*)) AS BIGINT) AS x
  FROM a{i} JOIN pieces p USING (r, part), unnest(range(1, len(p.v) + 1)) AS u(j) GROUP BY part, entry, j),
b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b
  LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS v FROM m{i} GROUP BY part, entry) m USING (part, entry))"""
    moved = moved.replace("floor_div(sum(p.v[j]), count(*))", "((sum(p.v[j]) - (((sum(p.v[j]) % count(*)) + count(*)) % count(*))) // count(*))")
    steps = ", ".join(f"{assigned.format(i=i)}, {moved.format(i=i, n=i + 1)}" for i in range(ROUNDS))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
       list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {PARTS} AS w FROM kept),
pieces AS MATERIALIZED (SELECT r, part, v[part * w + 1:(part + 1) * w] AS v FROM kept, w, range({PARTS}) t(part)),
b0 AS (SELECT part, r - 1 AS entry, v FROM pieces WHERE r <= {ENTRIES}),
{steps},
{assigned.format(i=ROUNDS)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest"""


ORACLE = _oracle()
