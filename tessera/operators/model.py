"""Model-shaped work re-expressed as Spark jobs.

N1/N2 stand where the reference trains and evaluates a network: a count-based
next-token model is fitted from packed blocks and used to score a split, so the
metrics (E*) run end to end on real predictions.  Tables are keyed by ids only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import kernels as K
from tessera.session import ship_package

STATS_BROADCAST_ROWS = 4_000_000


def _adjacent(kind: str, id_bits: int):
    """Partial counts of one task's adjacent ids, in bounded memory (``CodeCounts``).

    ``ids``: (id, n).  ``pairs``: (prev_id, next_id, n).  ``triples``: (left, target, right, n) for each target with a
    right neighbour; left is null at a row start.  Only positions inside one row are paired; codes are exact.
    """
    names = {"ids": ["id"], "pairs": ["prev_id", "next_id"], "triples": ["left", "target", "right"]}[kind]

    def fn(batches):
        import numpy as np
        import pyarrow as pa
        counts, mask = K.CodeCounts(), (1 << id_bits) - 1

        def batch(codes, n):
            if kind == "ids":
                cols = [pa.array(codes, pa.int32())]
            elif kind == "pairs":
                cols = [pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32())]
            else:
                left = (codes >> (2 * id_bits)) - 1
                cols = [pa.array(left.astype(np.int32), mask=left < 0), pa.array((codes >> id_bits) & mask, pa.int32()), pa.array(codes & mask, pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, pa.array(n)], names=[*names, "n"])

        for rb in batches:
            for _, offsets, v in K.list_runs(rb.column(0)):
                if kind == "ids":
                    codes = v
                else:
                    p = K.pair_starts(offsets)
                    codes = v[p] << (32 if kind == "pairs" else id_bits) | v[p + 1]
                    if kind == "triples":
                        starts = np.zeros(len(v) + 1, bool)
                        starts[offsets[:-1]] = True
                        codes |= np.where(starts[p], 0, v[np.maximum(p - 1, 0)] + 1) << (2 * id_bits)
                for part in counts.add(codes):
                    yield batch(*part)
        for part in counts.finish():
            yield batch(*part)
    return fn


def fit_next_token(blocks: DataFrame, ids_col: str = "input_ids", id_bound: int | None = None) -> DataFrame:
    """Bigram counts (prev_id, next_id, n) over adjacent positions inside each block; ids are ints from 0 on.

    Counted per task in Arrow before the shuffle, in bounded memory whatever ``id_bound``."""
    ship_package(blocks.sparkSession)
    part = blocks.select(ids_col).mapInArrow(_adjacent("pairs", 32), "prev_id int, next_id int, n long")
    return part.groupBy("prev_id", "next_id").agg(F.sum("n").alias("n"))


def infill_counts(blocks: DataFrame, ids_col: str = "input_ids", id_bound: int | None = None) -> DataFrame:
    """(left, right, target, n) over every mask slot of every block (B9 triples counted)."""
    bits = max(1, (int(id_bound) - 1).bit_length()) if id_bound is not None else None
    if bits is not None and bits <= 20:
        ship_package(blocks.sparkSession)
        part = blocks.select(ids_col).mapInArrow(_adjacent("triples", bits), "left int, target int, right int, n long")
        return part.groupBy("left", "right", "target").agg(F.sum("n").alias("n"))
    from tessera.operators.blocks import infill_triples
    tri = infill_triples(blocks.withColumn("__row", F.lit(0)), ["__row"], ids_col)
    return tri.groupBy("left", "right", "target").agg(F.count(F.lit(1)).alias("n"))


def prev_stats(counts: DataFrame) -> DataFrame:
    """Per previous id: total continuations and the top next id (count desc, id asc)."""
    return counts.groupBy("prev_id").agg(
        F.sum("n").alias("prev_total"),
        F.max_by("next_id", F.struct(F.col("n"), -F.col("next_id"))).alias("top_next"))


def unigram_top(blocks: DataFrame, ids_col: str = "input_ids") -> DataFrame:
    """Most frequent id (ties → smallest id): the back-off prediction."""
    ship_package(blocks.sparkSession)
    c = blocks.select(ids_col).mapInArrow(_adjacent("ids", 32), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return c.agg(F.max_by("id", F.struct(F.col("n"), -F.col("id"))).alias("fallback_id"))


END = 0xFFFFFFFF  # the next id of a row's last position: there is none


def _pair_codes(offsets, values):
    """``cur << 32 | next`` of every position; ``END`` stands for the next id of a row's last one."""
    import numpy as np
    codes = values << 32
    after = np.full(len(values), END, np.int64)
    p = K.pair_starts(offsets)
    after[p] = values[p + 1]
    return codes | after


def _distinct_pairs(chunked: bool):
    """Distinct pair codes of a task (of a chunk, if ``chunked``: the first column), handed on in bounded memory."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        counts = {}

        def out(chunk, codes):
            cols = [pa.array(np.full(len(codes), chunk))] if chunked else []
            return pa.RecordBatch.from_arrays([*cols, pa.array(codes)], names=["chunk", "code"] if chunked else ["code"])

        for rb in batches:
            lists, chunks = rb.column(rb.num_columns - 1), np.asarray(rb.column(0)) if chunked else np.zeros(rb.num_rows, np.int64)
            for start, offsets, values in K.list_runs(lists):
                codes, of = _pair_codes(offsets, values), np.repeat(chunks[start:start + len(offsets) - 1], np.diff(offsets))
                for chunk in np.unique(of).tolist():
                    held = counts.setdefault(chunk, K.CodeCounts())
                    for part, _ in held.add(codes[of == chunk] if chunked else codes):
                        yield out(chunk, part)
                if sum(len(c.codes) + c.held // 8 for c in counts.values()) > K.MAX_CODES:
                    for chunk, held in counts.items():
                        for part, _ in held.finish():
                            yield out(chunk, part)
        for chunk, held in counts.items():
            for part, _ in held.finish():
                yield out(chunk, part)
    return fn


def pair_losses(codes: DataFrame, counts: DataFrame, vocab_size: int, add_k: float, fallback, stats_bound: int | None) -> DataFrame:
    """(code, nll, pred) of distinct pair codes: one row a pair, joined once with the model's one row a pair."""
    stats = prev_stats(counts)
    if stats_bound is not None and stats_bound <= STATS_BROADCAST_ROWS:
        stats = F.broadcast(stats)  # one row per distinct id: bounded by the vocabulary
    c = counts.select(F.shiftleft(F.col("prev_id").cast("long"), 32).bitwiseOR(F.col("next_id").cast("long")).alias("code"), F.col("n").alias("__c"))
    x = codes.join(c, "code", "left").withColumn("prev_id", F.shiftright("code", 32).cast("int")).join(stats, "prev_id", "left")
    prob = (F.coalesce(F.col("__c"), F.lit(0)) + F.lit(add_k)) / (F.coalesce(F.col("prev_total"), F.lit(0)) + F.lit(add_k * vocab_size))
    has_next = F.col("code").bitwiseAND(END) != END
    return x.select("code", F.when(has_next, -F.log(prob)).alias("nll"), F.coalesce(F.col("top_next"), fallback).alias("pred"))


def _score_rows(rb, ids_at: int, codes, nll, pred, names):
    """One Arrow batch scored from a sorted pair table that holds all its pairs."""
    import numpy as np
    import pyarrow as pa
    lists = rb.column(ids_at)
    preds, loss, n_pairs = [], [], []
    for _, offsets, values in K.list_runs(lists):
        at = np.searchsorted(codes, _pair_codes(offsets, values))
        preds.append(pred[at])
        p = K.pair_starts(offsets)
        rows = len(offsets) - 1
        row = K.row_of(offsets)[p]
        n = np.bincount(row, minlength=rows)
        total = np.bincount(row, weights=nll[at[p]], minlength=rows)
        loss.append(np.divide(total, n, out=np.zeros(rows), where=n > 0))
        n_pairs.append(n)
    n = np.concatenate(n_pairs) if n_pairs else np.zeros(0, np.int64)
    sizes = np.concatenate([[0], np.cumsum(np.where(np.asarray(lists.is_null()), 0, np.diff(np.asarray(lists.offsets))))])
    out = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(preds) if preds else np.zeros(0, np.int32), pa.int32()))
    cols = [rb.column(i) for i in range(rb.num_columns) if i != ids_at]
    return pa.RecordBatch.from_arrays([*cols, lists, out, pa.array(np.concatenate(loss) if loss else np.zeros(0), mask=n == 0), pa.array(n, pa.int64())], names=names)


PAIR_TABLE_ROWS = 4_000_000  # 20 bytes a pair in every worker
CHUNK_TOKENS = 4_000_000  # tokens of a chunk, about


def score_next_token(counts: DataFrame, blocks: DataFrame, keys, vocab_size: int,
                     add_k: float = 1.0, ids_col: str = "input_ids",
                     train_blocks: DataFrame | None = None,
                     stats_bound: int | None = None, max_pairs: int = PAIR_TABLE_ROWS) -> DataFrame:
    """Score blocks with the bigram model.

    Output per row: keys…, labels (= ids), pred ARRAY<INT> (pred[t] is the
    prediction for position t+1, like an arg-max over logits at t), loss =
    mean −log p(x[t+1] | x[t]) with add-k smoothing over ``vocab_size`` ids (null without a pair),
    n_pairs.  Unseen previous ids fall back to the unigram top id.

    Tokens are never exploded.  The blocks' distinct (cur, next) pairs, counted per task, meet the model once: both
    sides hold a pair once, so a hot pair is one row.  Up to ``max_pairs`` distinct pairs their losses and predictions go
    to every worker as sorted arrays, and rows are scored where they are.  Beyond that, rows fall into chunks of
    about ``CHUNK_TOKENS`` tokens by a hash of their keys; each chunk gets the table of its own pairs.
    """
    keys = list(keys)
    spark = blocks.sparkSession
    ship_package(spark)
    fb = unigram_top(train_blocks if train_blocks is not None else blocks, ids_col).scalar()
    rows = blocks.select(*keys, F.col(ids_col).alias("labels"))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("pred array<int>, loss double, n_pairs long").fields])
    names, ids_at = schema.names, len(keys)
    codes = rows.select("labels").mapInArrow(_distinct_pairs(False), "code long").distinct()
    table = pair_losses(codes, counts, vocab_size, add_k, fb, stats_bound)
    known = table.limit(max_pairs + 1).toArrow()
    if known.num_rows <= max_pairs:
        share = spark.sparkContext.broadcast(_sorted_table(known))

        def score(batches):
            for rb in batches:
                yield _score_rows(rb, ids_at, *share.value, names)
        return rows.mapInArrow(score, schema)
    size = rows.agg(F.sum(F.greatest(F.size("labels"), F.lit(0)).cast("long"))).head()[0]
    chunk = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-size // CHUNK_TOKENS))))
    dealt = rows.withColumn("chunk", chunk)
    own = dealt.select("chunk", "labels").mapInArrow(_distinct_pairs(True), "chunk long, code long").distinct()
    tables = own.join(table, "code").select("chunk", "code", "nll", "pred")

    def score_chunk(left, right):
        import pyarrow as pa
        left = left.combine_chunks()
        out = [_score_rows(rb, ids_at, *_sorted_table(right), names) for rb in left.drop_columns("chunk").to_batches()]
        return pa.Table.from_batches(out, pa.schema([out[0].schema.field(i) for i in range(len(names))])) if out else _no_rows(schema)
    return dealt.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInArrow(score_chunk, schema)


def _no_rows(schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema).empty_table()


def _sorted_table(table):
    """Arrow (…, code, nll, pred) → numpy arrays by code; a null loss (no next id) is 0 and counted nowhere."""
    import numpy as np
    codes = table.column("code").to_numpy()
    order = np.argsort(codes)
    nll = np.nan_to_num(table.column("nll").to_numpy().astype(float))
    return codes[order], nll[order], table.column("pred").to_numpy().astype(np.int32)[order]


def fit_infill(triples: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Infill model: counts of target given (left, right) and the top target per context.

    Takes raw triples, or pre-aggregated ``counts`` (left, right, target, n)."""
    c = counts if counts is not None else \
        triples.groupBy("left", "right", "target").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("left", "right").agg(
        F.sum("n").alias("context_total"),
        F.max_by("target", F.struct(F.col("n"), -F.col("target"))).alias("top_target"))


def predict_infill(model: DataFrame, triples: DataFrame) -> DataFrame:
    m = model.select(F.col("left").alias("__l"), F.col("right").alias("__r"), "top_target")
    j = triples.join(m, triples.left.eqNullSafe(m.__l) & triples.right.eqNullSafe(m.__r), "left")
    return j.drop("__l", "__r")


def combine_vectors(a: DataFrame, b: DataFrame, key: str, how: str = "mean",
                    a_col: str = "vec", b_col: str = "vec") -> DataFrame:
    """Inner equi-join on ``key`` and combine: mean, add or concat."""
    left = a.select(key, F.col(a_col).alias("__a"))
    right = b.select(key, F.col(b_col).alias("__b"))
    j = left.join(right, key)
    if how == "mean":
        out = F.zip_with("__a", "__b", lambda x, y: (x + y) / 2)
    elif how == "add":
        out = F.zip_with("__a", "__b", lambda x, y: x + y)
    elif how == "concat":
        out = F.concat("__a", "__b")
    else:
        raise ValueError(f"unknown combine mode {how!r}")
    return j.select(key, out.alias("combined"))


def average_params(a: DataFrame, b: DataFrame, name_col: str = "name",
                   values_col: str = "values") -> DataFrame:
    """Element-wise mean of two parameter tables; name sets and shapes must match."""
    left = a.select(name_col, F.col(values_col).alias("__a"))
    right = b.select(name_col, F.col(values_col).alias("__b"))
    j = left.join(right, name_col, "full_outer")
    bad = F.col("__a").isNull() | F.col("__b").isNull() | (F.size("__a") != F.size("__b"))
    avg = F.zip_with("__a", "__b", lambda x, y: (x + y) / 2)
    return j.select(name_col, F.when(bad, F.raise_error(F.concat(
        F.lit("parameter mismatch: "), F.col(name_col)))).otherwise(avg).alias(values_col))


def score_with(df: DataFrame, fn, schema, broadcast_obj=None) -> DataFrame:
    """Batch scoring with a user function over Arrow batches (``mapInPandas``).

    ``fn(pdf, obj) -> pdf`` receives each pandas batch and the broadcast user
    object (a model, a lookup table; it must be bounded -- it is shipped to
    every executor once).
    """
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(broadcast_obj) if broadcast_obj is not None else None

    def run(batches):
        obj = bc.value if bc is not None else None
        for pdf in batches:
            yield fn(pdf, obj)
    return df.mapInPandas(run, schema)
