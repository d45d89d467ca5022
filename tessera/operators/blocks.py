"""Packing, labels and masks.

``pack_blocks`` concatenates the token arrays of each map batch (consecutive
rows by the global index) and cuts them into ``block_size`` blocks; the tail
of a batch is dropped unless the whole batch is shorter than one block, in
which case the batch becomes one short block.  Documents run into each other.

Physical plan (one shuffle of the tokens):

1. window partitioned by ``batch_id`` (rows per batch are bounded by
   ``batch_rows``) gives each row its offset in the batch and the batch total;
2. each row emits only the slices that land in kept blocks (the drop rule is
   applied before anything moves again); a huge document spreads over many
   ``(batch_id, block_no)`` keys;
3. ``groupBy(batch_id, block_no)`` re-uses the window's hash partitioning on
   ``batch_id`` (no second exchange) and orders the pieces by their start.

Token arrays are never exploded to one row per token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import IGNORE_INDEX, MASK_RATIO
from tessera.functions import arrays as A
from tessera.operators import kernels as K
from tessera.operators.rowindex import content_hash, distinct_offsets, map_batches, same_rows
from tessera.session import ship_package


def effective_block(block_size: int, model_max_length: int | None) -> int:
    return block_size if model_max_length is None else min(block_size, model_max_length)


def pack_blocks(indexed: DataFrame, block_size: int, batch_rows: int,
                cols=("input_ids", "attention_mask"), index_col: str = "idx",
                batch_col: str | None = None, extra_keys=()) -> DataFrame:
    """Pack list columns into blocks.  Output: (*extra_keys, batch_id, block_no, *cols).

    ``indexed`` needs a contiguous ``index_col`` (see ``with_row_index``) unless a
    ``batch_col`` is given.  ``extra_keys`` (e.g. ``split``) partition the packing:
    batches never mix rows of different key values.
    """
    bs = int(block_size)
    cols = list(cols)
    extra = list(extra_keys)
    df = indexed if batch_col else map_batches(indexed, batch_rows, index_col)
    bcol = batch_col or "batch_id"
    n = F.size(F.col(cols[0]))
    df = df.select(*extra, F.col(bcol).alias("batch_id"), index_col, *cols).withColumn("__n", n)
    w = Window.partitionBy(*extra, "batch_id").orderBy(index_col)
    run = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tot = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return _cut_blocks(df.withColumn("__off", run - F.col("__n")).withColumn("__total", tot), bs, cols, [*extra, "batch_id"])


def pack_whole(df: DataFrame, block_size: int, order_col: str, cols=("input_ids",)) -> DataFrame:
    """Pack all rows as one batch: (block_no, *cols), however many rows there are.

    Rows go by the order key (null first), rows of one key by content hashes of their lists.  Equal rows move as
    one with their number, so each row's tokens come out once whatever repeats.  Offsets come from
    keys, hashes and sizes alone (``distinct_offsets``); the lists move once more, to their blocks.
    """
    cols, ident = list(cols), ["__key", "__h1", "__h2"]
    rows = df.select(F.col(order_col).alias("__key"), *content_hash(*cols), *cols)
    n = F.greatest(F.coalesce(F.size(cols[0]), F.lit(0)), F.lit(0)).cast("long")
    at = distinct_offsets(rows, ident, n)
    once = rows.groupBy(*ident).agg(*[F.first(c).alias(c) for c in cols])
    copies = (same_rows(once, at, ident).withColumn("__n", n)
              .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))
              .withColumn("__off", F.col("__off") + F.col("__copy") * F.col("__n")))
    return _cut_blocks(copies.select("__off", "__n", "__total", *cols), int(block_size), cols, [])


def _cut_blocks(df: DataFrame, bs: int, cols: list[str], keys: list[str]) -> DataFrame:
    """Rows with ``__off``, ``__n`` and the batch's ``__total`` → blocks (*keys, block_no, *cols)."""
    df = df.filter(F.col("__n") > 0)
    # blocks kept in the batch: total div bs, or one short block when total < bs
    kept = F.when(F.col("__total") < bs, F.lit(1)).otherwise(F.floor(F.col("__total") / bs))
    lo = F.floor(F.col("__off") / bs)
    hi = F.least(F.floor((F.col("__off") + F.col("__n") - 1) / bs), kept - 1)
    df = (df.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
          .filter(F.col("__lo") <= F.col("__hi"))
          .withColumn("block_no", F.explode(F.sequence("__lo", "__hi"))))
    start = F.greatest(F.col("block_no") * bs - F.col("__off"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * bs - F.col("__off"), F.col("__n"))
    piece = F.struct(
        (F.col("__off") + start).alias("pos"),
        *[F.slice(F.col(c), (start + 1).cast("int"), (end - start).cast("int")).alias(c)
          for c in cols])
    grouped = (df.select(*keys, "block_no", piece.alias("__piece"))
               .groupBy(*keys, "block_no")
               .agg(F.sort_array(F.collect_list("__piece")).alias("__pieces")))
    return grouped.select(*keys, "block_no",
                          *[F.flatten(F.transform("__pieces", _field(c))).alias(c) for c in cols])


def _field(name: str):
    return lambda p: p[name]


def with_labels(df: DataFrame, ids_col: str = "input_ids", labels_col: str = "labels") -> DataFrame:
    """Labels are a copy of the ids (the model shifts them)."""
    return df.withColumn(labels_col, F.col(ids_col))


def interleave_mask(df: DataFrame, mask_id: int, pad_id: int, ids_col: str = "input_ids",
                    am_col: str | None = "attention_mask", keep_labels: bool = True) -> DataFrame:
    """Collator form for the dual-objective model: labels from the original ids,
    ids interleaved with mask slots, attention mask interleaved the same way."""
    out = df
    if keep_labels and "labels" not in df.columns:
        out = out.withColumn("labels", F.col(ids_col))
    out = out.withColumn(ids_col, A.interleave_mask(ids_col, mask_id, pad_id))
    if am_col and am_col in df.columns:
        out = out.withColumn(am_col, A.interleave_attention(am_col))
    return out


def dual_labels(df: DataFrame, labels_col: str = "labels", interleaved: bool = True,
                out_col: str = "dual_labels") -> DataFrame:
    return df.withColumn(out_col, A.dual_labels(labels_col, interleaved))


def shift_pairs(df: DataFrame, keys, pred_col: str = "pred", label_col: str = "labels") -> DataFrame:
    """Flatten next-token pairs: (keys…, pos, pred, label) for pred[:-1] vs label[1:]."""
    keys = list(keys)
    return (df.select(*keys, F.posexplode(A.shift_pairs(pred_col, label_col)).alias("pos", "__p"))
            .select(*keys, "pos", F.col("__p.pred").alias("pred"), F.col("__p.label").alias("label")))


def infill_triples(df: DataFrame, keys, ids_col: str = "input_ids") -> DataFrame:
    """One row per mask slot: (keys…, pos, left, target, right), as ``arrays.infill`` gives them; cut from the lists in Arrow, some rows at a time."""
    keys = list(keys)
    ship_package(df.sparkSession)
    rows = df.select(*keys, ids_col)
    kind = rows.schema[ids_col].dataType.elementType
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("pos", T.IntegerType()), *[T.StructField(c, kind) for c in ("left", "target", "right")]])
    return rows.mapInArrow(_triples(schema.names), schema)


def _triples(names: list[str]):
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for rb in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(rb.column(rb.num_columns - 1)), 0), dtype=np.int64)
            held, start = np.cumsum(sizes), 0
            while start < rb.num_rows:
                before = held[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(held, before + K.RUN_TOKENS, side="right")))
                part, offsets = rb.slice(start, stop - start), np.concatenate([[0], held[start:stop] - before])
                flat, at, start = pc.list_flatten(part.column(part.num_columns - 1)), K.pair_starts(offsets), stop
                row = K.row_of(offsets)[at]
                pos = at - offsets[row]
                cols = [part.column(i).take(pa.array(row)) for i in range(part.num_columns - 1)]
                sides = [flat.take(pa.array(at - 1, mask=pos == 0)), flat.take(pa.array(at)), flat.take(pa.array(at + 1))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int32()), *sides], names=names)
    return fn


def random_mask(df: DataFrame, key_col: str, mask_id: int, special_ids=(), seed: int = 0,
                ratio: float = MASK_RATIO, ids_col: str = "input_ids",
                out_col: str = "masked_ids", labels_col: str = "labels") -> DataFrame:
    """Mask ``max(1, int(ratio · candidates))`` non-special positions per row.

    Positions are ranked by md5(key ‖ '|' ‖ pos ‖ '|' ‖ seed) -- deterministic and
    reproducible (the reference draws them unseeded).  Labels keep every id.
    The per-row threshold is zipped in as an array so no lambda re-evaluates it.
    """
    ids = F.col(ids_col)
    specials = F.array(*[F.lit(int(s)) for s in special_ids]) if special_ids else None

    def is_cand(x):
        return F.lit(True) if specials is None else ~F.array_contains(specials, x)

    key = F.col(key_col).cast("string")
    hs = F.transform(ids, lambda x, i: F.when(is_cand(x), F.md5(F.concat_ws(
        "|", key, i.cast("string"), F.lit(str(seed))))))
    out = df.withColumn("__hs", hs)
    cands = F.filter("__hs", lambda v: v.isNotNull())
    ncand = F.size(cands)
    k = F.when(ncand > 0, F.greatest(F.lit(1), F.floor(ncand.cast("double") * F.lit(ratio)).cast("int"))) \
        .otherwise(F.lit(0))
    out = out.withColumn("__k", k)
    thr = F.when(F.col("__k") > 0, F.element_at(F.sort_array(cands), F.greatest(F.col("__k"), F.lit(1))))
    z = F.arrays_zip(ids.alias("x"), F.col("__hs").alias("h"),
                     F.array_repeat(thr, F.size(ids)).alias("t"))
    masked = F.transform(z, lambda e: F.when(e["h"].isNotNull() & (e["h"] <= e["t"]), F.lit(mask_id))
                         .otherwise(e["x"]))
    return (out.withColumn(labels_col, ids).withColumn(out_col, masked)
            .withColumnRenamed("__k", "n_masked").drop("__hs"))


def token_stats(packed: DataFrame, group_cols=("split",), ids_col: str = "input_ids") -> DataFrame:
    """Blocks and tokens per group (tokens = Σ block lengths)."""
    return packed.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.size(ids_col).cast("long")).alias("n_tokens"))


def step_plan(stats: DataFrame, per_device_batch: int, grad_accum: int, epochs: int,
              every: int, blocks_col: str = "n_blocks") -> DataFrame:
    """Optimizer steps per epoch = ceil(ceil(blocks / batch) / accum); total over epochs;
    one row per evaluation/save point every ``every`` steps."""
    batches = F.ceil(F.col(blocks_col) / F.lit(per_device_batch))
    per_epoch = F.ceil(batches / F.lit(grad_accum)).cast("long")
    out = (stats.withColumn("steps_per_epoch", per_epoch)
           .withColumn("total_steps", F.col("steps_per_epoch") * F.lit(epochs)))
    pts = F.when(F.col("total_steps") >= every,
                 F.sequence(F.lit(every).cast("long"), F.col("total_steps"), F.lit(every).cast("long")))
    return out.withColumn("eval_step", F.explode_outer(pts))


IGNORE = IGNORE_INDEX
