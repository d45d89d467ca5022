"""Global row index (G1) and the order-based splits built on it.

Spark rows have no order, so every order-sensitive operator takes explicit
order columns.  The index is computed without a single-partition window:

1. range-partition on the order columns, sort within partitions and
   ``checkpoint()`` the result into the shared checkpoint folder.  Range
   bounds come from a sample seeded by the RDD id, so two separate exchanges
   over the same rows may cut differently; materializing once makes partition
   ids and in-partition order a fixed fact that every later branch (counts,
   index, retries after executor loss) reads back identically, and cuts the
   lineage;
2. local position = monotonically_increasing_id() minus the partition's base;
3. a tiny per-partition count table (one row per partition) gives each
   partition its starting offset through a running sum;
4. that table is broadcast (its size is the partition count, not the data).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, shuffle_partitions

_PID = "__pid"
_LOCAL = "__local"


def _cols(order_cols) -> list[str]:
    return [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)


def with_row_index(df: DataFrame, order_cols, index_col: str = "idx",
                   num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Add a 0-based contiguous ``index_col`` following ``order_cols`` (ascending).

    Output stays range-partitioned on ``order_cols`` and sorted within partitions.
    ``order_cols`` must be unique per row for the index to be deterministic.
    """
    cols = _cols(order_cols)
    n = num_partitions or range_partitions(df)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(n, *cols)
              .sortWithinPartitions(*cols)
              .checkpoint(eager=True)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_LOCAL, F.monotonically_increasing_id()
                          - F.shiftleft(F.col(_PID).cast("long"), 33)))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = (ranged.join(F.broadcast(_partition_offsets(ranged, F.count(F.lit(1)))), _PID)
           .withColumn(index_col, F.col("__off") + F.col(_LOCAL)))
    if total_col:
        out = out.withColumnRenamed("__total", total_col)
    return out.drop(_PID, _LOCAL, "__off", "__total")


def _partition_offsets(ranged: DataFrame, amount: Column) -> DataFrame:
    """Per range partition: the sum of ``amount`` before it, and over all (one row per partition)."""
    counts = ranged.groupBy(_PID).agg(amount.alias("__cnt"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(_PID, (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__off"),
                         F.sum("__cnt").over(everything).alias("__total"))


def with_offsets(df: DataFrame, order_cols, size_col: str, offset_col: str, total_col: str) -> DataFrame:
    """Add the running total of ``size_col`` before each row in ``order_cols`` order, and the grand total.

    The running sum stays inside a range partition and starts from the sums of
    the partitions before it, so no task sees more than its own range.
    """
    cols = _cols(order_cols)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(range_partitions(df), *cols)
              .withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True))
    w = Window.partitionBy(_PID).orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = _partition_offsets(ranged, F.sum(size_col)).withColumnsRenamed({"__off": "__base", "__total": total_col})
    before = F.col("__base") + F.sum(size_col).over(w) - F.col(size_col)
    return ranged.join(F.broadcast(offsets), _PID).withColumn(offset_col, before).drop(_PID, "__base")


TARGET_RANGE_BYTES = 128 * 1024 * 1024
MAX_RANGE_PARTITIONS = 200_000


def range_partitions(df: DataFrame, target_bytes: int = TARGET_RANGE_BYTES) -> int:
    """Range count for the index sort: at least ``spark.sql.shuffle.partitions``
    and one range per ~``target_bytes`` of Catalyst's size estimate (computed
    from file sizes and the pruned columns; no job runs)."""
    base = shuffle_partitions(df.sparkSession)
    try:
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 -- estimates are optional
        return base
    return int(min(MAX_RANGE_PARTITIONS, max(base, -(-est // target_bytes))))


def content_hash(*cols) -> list[Column]:
    """Two 64-bit hashes of ``cols``: with the order key they name a row's content; rows equal in all three are interchangeable."""
    return [F.xxhash64(*cols).alias("__h1"), F.xxhash64(F.lit(1), *cols).alias("__h2")]


def distinct_offsets(df: DataFrame, ident, size: Column | None = None) -> DataFrame:
    """(ident…, __m, __off, __total): each distinct row's copies and the sum of ``size`` (1 a row) before it in ``ident`` order.

    Equal rows are counted before anything is sorted, so a row repeated any number of times is one row; nulls come first."""
    ident = _cols(ident)
    one = size if size is not None else F.lit(1).cast("long")
    distinct = (df.select(*ident, one.alias("__one")).groupBy(*ident)
                .agg(F.count(F.lit(1)).alias("__m"), F.first("__one").alias("__one")).withColumn("__sum", F.col("__m") * F.col("__one")))
    return with_offsets(distinct, ident, "__sum", "__off", "__total").drop("__one", "__sum")


def same_rows(left: DataFrame, right: DataFrame, ident) -> DataFrame:
    """Inner join on ``ident``, null equal to null; ``ident`` comes once."""
    names = {c: f"__same_{i}" for i, c in enumerate(_cols(ident))}
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    return left.join(right.withColumnsRenamed(names), on).drop(*names.values())


TAKE_ROWS = 10_000  # rows that one task may take
CUTS = 64  # ranges that a selection step counts
CUT_SAMPLE = 4_000  # rows sampled for a step's cuts, about


def _below(cols: list[str], row) -> Column:
    """Rows before ``row`` in the order of ``cols``, nulls first."""
    mark = F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (t, v) in enumerate(row)])
    return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]) < mark


def border_key(df: DataFrame, order_cols, n: int) -> tuple[list, int] | None:
    """(key of the ``n``-th row (from 1) in order, rows strictly before that key); None if there are fewer rows.

    A selection: a step cuts the range that holds the row by sampled keys and counts the rows below every cut in one
    aggregation of the key columns, until ``TAKE_ROWS`` rows or one key are left.  Keys are never sorted or moved."""
    cols = _cols(order_cols)
    keys = df.select(*cols)
    types = [f.dataType.simpleString() for f in keys.schema.fields]
    typed = lambda r: list(zip(types, r))
    total = keys.count()
    if total < n:
        return None
    low, high, before, inside, step = None, None, 0, total, 0  # the row is in [low, high), ``before`` rows come before it
    while inside > TAKE_ROWS:
        step += 1
        span = keys if low is None else keys.filter(~_below(cols, low))
        span = span if high is None else span.filter(_below(cols, high))
        drawn = span.sample(fraction=min(1.0, CUT_SAMPLE / inside), seed=step).limit(4 * CUT_SAMPLE).distinct().orderBy(*cols).collect()
        cuts = [typed(drawn[i * len(drawn) // CUTS]) for i in range(1, CUTS)] if len(drawn) >= CUTS else [typed(r) for r in drawn]
        cuts = [c for c in cuts if c != low]
        if not cuts:  # the sample has no key but the lowest one
            first = (span if low is None else span.filter(_after(cols, low))).orderBy(*cols).head()
            if first is None:  # one key is left
                return [v for _, v in low], before
            cuts = [typed(first)]
        counts = span.agg(*[F.count_if(_below(cols, c)).alias(f"n{i}") for i, c in enumerate(cuts)]).head()
        edges = [(low, 0), *[(c, counts[i]) for i, c in enumerate(cuts)], (high, inside)]
        for (a, below), (b, upto) in zip(edges, edges[1:]):
            if before + below < n <= before + upto:
                low, high, before, inside = a, b, before + below, upto - below
                break
    span = keys if low is None else keys.filter(~_below(cols, low))
    span = span if high is None else span.filter(_below(cols, high))
    rows = [tuple(r) for r in span.orderBy(*cols).limit(n - before).collect()]
    return list(rows[-1]), before + rows.index(rows[-1])


def _after(cols: list[str], row) -> Column:
    mark = F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (t, v) in enumerate(row)])
    return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]) > mark


def slice_rows(df: DataFrame, order_cols, n: int) -> DataFrame:
    """``train[:N]``: the first ``n`` rows by ``order_cols``, nulls first.

    Up to ``TAKE_ROWS`` rows are a TakeOrdered.  A larger slice is a filter on the scan up to the key of its last
    row (``border_key``); of rows that share that key, those with the smallest content hashes are in."""
    cols, n = _cols(order_cols), int(n)
    if n <= TAKE_ROWS:
        return df.orderBy(*cols).limit(n)
    found = border_key(df, cols, n)
    if found is None:
        return df
    types = [df.schema[c].dataType.simpleString() for c in cols]
    key, before = list(zip(types, found[0])), found[1]
    below = df.filter(_scan_bound(df, cols[0], key[0])).filter(_below(cols, key))
    tied = df.filter(~_below(cols, key) & ~_after(cols, key))
    left = n - before
    if tied.count() > left:  # the slice ends among rows of one key
        hashed = tied.select("*", *content_hash(*tied.columns))
        copies = distinct_offsets(hashed, ["__h1", "__h2"]).filter(F.col("__off") < left)
        whole = hashed.join(copies.filter(F.col("__off") + F.col("__m") <= left).select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
        last = same_rows(hashed, copies.filter(F.col("__off") + F.col("__m") > left), ["__h1", "__h2"]).limit(1)
        part = last.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(left) - F.col("__off")))).select(*tied.columns)
        tied = whole.select(*tied.columns).unionAll(part)
    return below.unionAll(tied)


def _scan_bound(df: DataFrame, col: str, mark) -> Column:
    """The part of ``_below`` that a Parquet scan takes: the first order column alone."""
    kind, value = mark
    return F.col(col).isNull() if value is None else F.col(col).isNull() | (F.col(col) <= F.lit(value).cast(kind))


def cap_samples(df: DataFrame, order_cols, max_samples: int | None,
                streaming: bool = False) -> DataFrame:
    """First ``min(len, max_samples)`` rows; no cap in streaming mode or when unset."""
    if max_samples is None or streaming:
        return df
    return slice_rows(df, order_cols, max_samples)


def preview(df: DataFrame, order_cols=None, n: int = 3) -> DataFrame:
    """Head preview (3 rows by default), ordered when order columns are given."""
    return (df.orderBy(*_cols(order_cols)) if order_cols is not None else df).limit(n)


def percent_boundary(count: Column, percent) -> Column:
    """Row boundary of ``train[:p%]``: round-half-even of count·p/100 (exact decimal)."""
    p = F.lit(str(percent)).cast("decimal(20,6)")
    return F.bround(count.cast("decimal(38,6)") * p / F.lit(100), 0).cast("long")


def split_percent(indexed: DataFrame, percent, index_col: str = "idx",
                  split_col: str = "split", legacy_overlap: bool = False,
                  total_col: str | None = None) -> DataFrame:
    """Contiguous split of an indexed frame: validation = ``[:p%]``, train = ``[p%:]``.

    ``percent`` may be a number or a numeric string (configs pass "1").  Adds
    ``split_idx``, the 0-based position inside the split.  ``total_col`` (from
    ``with_row_index``) avoids a second counting pass.  With ``legacy_overlap``
    both splits get every row (the capped-sample quirk).
    """
    if legacy_overlap:
        both = F.array(F.lit("train"), F.lit("validation"))
        return indexed.withColumn(split_col, F.explode(both)).withColumn("split_idx", F.col(index_col))
    if total_col and total_col in indexed.columns:
        src = indexed.withColumn("__b", percent_boundary(F.col(total_col), percent))
    else:
        total = indexed.agg(F.count(F.lit(1))).scalar()
        src = indexed.withColumn("__b", percent_boundary(total, percent))
    is_val = F.col(index_col) < F.col("__b")
    return (src.withColumn(split_col, F.when(is_val, F.lit("validation")).otherwise(F.lit("train")))
            .withColumn("split_idx", F.when(is_val, F.col(index_col))
                        .otherwise(F.col(index_col) - F.col("__b")))
            .drop("__b"))


def shuffle_batches(df: DataFrame, key_cols, seed: int, epoch: int, batch_size: int,
                    index_col: str = "idx") -> DataFrame:
    """Seeded, reproducible epoch permutation and fixed-size batches.

    Order = md5(key ‖ '|' ‖ seed ‖ '|' ‖ epoch) (ties broken by the key), then the
    global index; ``batch_id = idx div batch_size``.
    """
    keys = _cols(key_cols)
    keystr = F.concat_ws("|", *[F.col(k).cast("string") for k in keys],
                         F.lit(str(seed)), F.lit(str(epoch)))
    shuffled = df.withColumn("shuffle_key", F.md5(keystr))
    out = with_row_index(shuffled, ["shuffle_key", *keys], index_col)
    return (out.withColumn("epoch", F.lit(epoch))
            .withColumn("batch_id", F.floor(F.col(index_col) / F.lit(batch_size)).cast("long")))


FEISTEL_ROUNDS = 4
WALK = 16  # steps of a cycle walk; see ``permuted_index``


def feistel_sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square domain a * b of at least ``n`` numbers."""
    a = max(1, math.isqrt(n - 1) + 1 if n > 0 else 1)
    return a, max(1, -(-n // a))


def permuted_index(index: Column | str, n: int, seed: int, epoch: int) -> Column:
    """Place of row ``index`` of ``n`` in the permutation of (seed, epoch): a keyed bijection of 0 … n - 1, row by row.

    Feistel rounds over Z_a x Z_b with a * b >= n: each adds a hash of one half to the other, so a round is
    reversible whatever the hash.  A place of n or more is walked on until it is below n; a * b exceeds n by less than a,
    and a walk of ``WALK`` steps fails with a chance under 1e-18 a row, which raises an error."""
    a, b = feistel_sides(n)
    start = F.col(index) if isinstance(index, str) else index

    def step(x: Column) -> Column:
        halves = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        out = F.reduce(F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)), halves, lambda h, i: F.struct(
            F.when(i % 2 == 0, (h["l"] + _mixed(h["r"], i, a, seed, epoch)) % a).otherwise(h["l"]).cast("long").alias("l"),
            F.when(i % 2 == 1, (h["r"] + _mixed(h["l"], i, b, seed, epoch)) % b).otherwise(h["r"]).cast("long").alias("r")))
        return F.reduce(F.array(out), F.lit(0).cast("long"), lambda acc, h: acc + h["l"] * b + h["r"])

    steps = min(WALK, a * b - n + 1)
    walked = F.reduce(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.cast("long").alias("x"), F.lit(False).alias("done")), lambda s, _: F.when(
        s["done"], s).otherwise(F.reduce(F.array(step(s["x"])), s, lambda _s, y: F.struct(y.alias("x"), (y < n).alias("done")))))
    return F.reduce(F.array(walked), F.lit(0).cast("long"), lambda acc, s: F.when(s["done"], acc + s["x"]).otherwise(
        F.raise_error(F.lit("permutation: cycle walk too long")).cast("long")))


def _mixed(half: Column, i: Column, side: int, seed: int, epoch: int) -> Column:
    text = F.concat_ws("/", F.lit(str(seed)), F.lit(str(epoch)), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.lit(side).cast("long")


def epoch_batches(indexed: DataFrame, n: int, seed: int, epoch: int, batch_size: int, index_col: str = "idx") -> DataFrame:
    """Epoch order without a sort: ``place`` of each indexed row, and ``batch_id = place div batch_size``.

    Row by row: no shuffle and no checkpoint; a reader of a batch filters or groups by ``batch_id``."""
    place = permuted_index(index_col, n, seed, epoch)
    return (indexed.withColumn("place", place).withColumn("epoch", F.lit(epoch))
            .withColumn("batch_id", F.floor(F.col("place") / F.lit(batch_size)).cast("long")))


def map_batches(indexed: DataFrame, batch_rows: int, index_col: str = "idx",
                shards: int = 1, total_rows: Column | None = None) -> DataFrame:
    """Consecutive rows in groups of ``batch_rows`` (the reference's batched map).

    With ``shards`` > 1 the index range is first cut into contiguous shards
    (like per-worker shards) and batches restart in each shard.
    """
    idx = F.col(index_col)
    if shards <= 1:
        return indexed.withColumn("batch_id", F.floor(idx / F.lit(batch_rows)).cast("long"))
    n = indexed.agg(F.count(F.lit(1))).scalar()
    out = indexed.withColumn("__per", F.ceil(n / F.lit(shards)).cast("long"))
    shard = F.floor(idx / F.col("__per")).cast("long")
    local = idx - shard * F.col("__per")
    per_shard_batches = F.ceil(F.col("__per") / F.lit(batch_rows)).cast("long")
    return (out.withColumn("shard", shard)
            .withColumn("batch_id", shard * per_shard_batches
                        + F.floor(local / F.lit(batch_rows)).cast("long"))
            .drop("__per"))


def with_group_index(df: DataFrame, group_cols, order_cols, index_col: str = "step",
                     start: int = 1) -> DataFrame:
    """Position inside each group (``start``-based) without a per-group window.

    A global index over (group, order) minus the group's first index: a hot
    group never lands in one task.  The per-group minimum table has one row per
    group and is joined back (AQE broadcasts it when small).
    """
    g, o = _cols(group_cols), _cols(order_cols)
    ix = with_row_index(df, [*g, *o], "__gi")
    keys = {c: f"__g_{i}" for i, c in enumerate(g)}
    first = ix.groupBy(*g).agg(F.min("__gi").alias("__g0")).withColumnsRenamed(keys)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]  # a null group is a group
    return (ix.join(first, same).drop(*keys.values()).withColumn(index_col, F.col("__gi") - F.col("__g0") + F.lit(start))
            .drop("__gi", "__g0"))
