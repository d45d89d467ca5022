"""Vocabulary and token-id operators.

Encoding looks every pre-token up in a vocabulary.  Two physical routes:

* bounded vocabulary (size cap, or counted below ``max_broadcast_entries``):
  the vocabulary is built into an index once (sorted hashes, an Arrow file that Spark brings to every executor), every
  worker maps that file into memory, and each Arrow batch looks up its distinct tokens in it -- a narrow map, no
  shuffle of the corpus at all;
* unbounded vocabulary: ``posexplode`` → shuffle (sort-merge) join on the
  token → regroup per row, ordered by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import EOS_TOKEN, MASK_TOKEN, UNK_TOKEN
from tessera.operators.kernels import RUN_TOKENS
from tessera.operators.rowindex import with_row_index
from tessera.session import ensure_checkpoint_dir, ship_package

DEFAULT_SPECIALS = (UNK_TOKEN, EOS_TOKEN)
MAX_BROADCAST_ENTRIES = 4_000_000


FOLD_BYTES = 32 << 20
MAX_PARTIAL_TOKENS = 1_000_000


def _partial_counts(batches):
    """Map-side combine in Arrow: (token, n) of the tokens of one partition.

    Tokens are folded into counts every ``FOLD_BYTES`` and handed on beyond
    ``MAX_PARTIAL_TOKENS`` distinct ones, which bounds the worker's memory."""
    import pyarrow as pa
    import pyarrow.compute as pc
    parts, held, counts = [], 0, None

    def fold():
        vc = pc.value_counts(pa.chunked_array(parts, type=pa.string()))
        new = pa.table([vc.field("values"), pc.cast(vc.field("counts"), pa.int64())], names=["token", "n"])
        if counts is None:
            return new
        both = pa.concat_tables([counts, new]).group_by("token").aggregate([("n", "sum")])
        return both.rename_columns(["token", "n"])

    for rb in batches:
        col = rb.column(0)
        if len(col):
            parts.append(pc.list_flatten(col))
            held += parts[-1].nbytes
        if held >= FOLD_BYTES:
            counts, parts, held = fold(), [], 0
            if counts.num_rows >= MAX_PARTIAL_TOKENS:
                yield from counts.combine_chunks().to_batches()
                counts = None
    if parts:
        counts = fold()
    if counts is not None:
        yield from counts.combine_chunks().to_batches()


def token_counts(tokens: DataFrame, tokens_col: str = "tokens", arrow_combine: bool = True) -> DataFrame:
    """(token, freq) with a map-side combine before the shuffle.

    Default: per-partition ``value_counts`` over the Arrow token lists (the
    tokens are never exploded into JVM rows), then ``groupBy(token).sum`` merges
    the partials.  ``arrow_combine=False``: explode + partial HashAggregate.
    """
    if arrow_combine:
        ship_package(tokens.sparkSession)
        partial = tokens.select(tokens_col).mapInArrow(_partial_counts, "token string, n long")
        return partial.groupBy("token").agg(F.sum("n").alias("freq"))
    return (tokens.select(F.explode(tokens_col).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))


def build_vocab(tokens: DataFrame, size: int | None = None, specials=DEFAULT_SPECIALS,
                tokens_col: str = "tokens") -> DataFrame:
    """Vocabulary (token, token_id, freq, is_special).

    Regular tokens get ids 0.. by (freq desc, token asc); ``size`` keeps the first
    ``size`` of them (bounded TakeOrdered).  Specials are appended after them.
    Without ``size`` the ids come from the distributed row index.
    """
    counts = token_counts(tokens, tokens_col)
    if size is not None:
        top = counts.orderBy(F.desc("freq"), F.asc("token")).limit(int(size))
        regular = top.select("token", F.lit(-1).alias("token_id"), "freq")
        return _append_specials_bounded(regular, specials, rank_regular=True)
    regular = (with_row_index(counts.withColumn("__nf", -F.col("freq")), ["__nf", "token"], "token_id")
               .drop("__nf").withColumn("token_id", F.col("token_id").cast("int")))
    regular = regular.select("token", "token_id", "freq", F.lit(False).alias("is_special"))
    return add_specials(regular, specials, bounded=False)


def read_vocab(spark, path: str, specials=(*DEFAULT_SPECIALS, MASK_TOKEN)) -> DataFrame:
    """A ``vocab.json`` (one object of token → id) → vocabulary rows, as ``build_vocab`` gives them.

    ``freq`` is 0, as the file counts nothing.  A file that is no such object,
    a null id, or an id on several tokens raises ``ValueError``.
    """
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    vocab = body.select(F.explode("m").alias("token", "token_id"))
    n, ids, distinct = vocab.agg(F.count(F.lit(1)), F.count("token_id"), F.countDistinct("token_id")).first()
    if not n:
        raise ValueError(f"{path} holds no object of tokens and ids")
    if ids < n or distinct < n:
        raise ValueError(f"{path} gives {n} tokens {distinct} distinct ids")
    return vocab.select("token", "token_id", F.lit(0).cast("long").alias("freq"), F.col("token").isin(list(specials)).alias("is_special"))


def _specials_frame(spark, tokens):
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(tokens)], "token string, __ord int")


def _append_specials_bounded(vocab: DataFrame, tokens, rank_regular: bool = False) -> DataFrame:
    """Bounded vocabulary: one pass of windows over (vocab ∪ specials), the vocab
    referenced once.  Specials already present keep their id; new ones get the
    next free ids in the given order.  With ``rank_regular`` the regular ids are
    assigned here too, by (freq desc, token asc)."""
    tokens = list(tokens)
    special = F.col("is_special") if "is_special" in vocab.columns else F.lit(False)
    reg = vocab.select("token", "token_id", "freq", special.alias("is_special"), F.lit(0).alias("__ord"))
    sp = _specials_frame(vocab.sparkSession, tokens).select(
        "token", F.lit(-1).alias("token_id"), F.lit(0).cast("long").alias("freq"),
        F.lit(True).alias("is_special"), "__ord")
    u = reg.unionByName(sp)
    first = Window.partitionBy("token").orderBy("__ord")
    u = u.withColumn("__dup", F.row_number().over(first)).filter(F.col("__dup") == 1)
    everything = Window.orderBy("__ord", F.desc("freq"), "token")
    if rank_regular:
        tid = F.row_number().over(everything) - 1
    else:
        whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        base = F.max(F.when(F.col("__ord") == 0, F.col("token_id"))).over(whole)
        nth = F.sum((F.col("__ord") > 0).cast("int")).over(
            Window.orderBy("__ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tid = F.when(F.col("__ord") == 0, F.col("token_id")).otherwise(F.coalesce(base, F.lit(-1)) + nth)
    return u.select("token", tid.cast("int").alias("token_id"), "freq", "is_special")


def add_specials(vocab: DataFrame, tokens=(MASK_TOKEN,), bounded: bool = True) -> DataFrame:
    """Append special tokens not yet present, with the next free ids in the given order.

    ``bounded`` (a size-capped vocabulary): single-pass windows.  Otherwise the names already there and the next free id
    are looked up first (one filter, one maximum) and the new rows are appended: no token moves.
    """
    tokens = list(tokens)
    if not tokens:
        return vocab
    if bounded:
        return _append_specials_bounded(vocab, tokens)
    present = {r["token"] for r in vocab.filter(F.col("token").isin(tokens)).select("token").collect()}  # the given names at most
    free = vocab.agg(F.coalesce(F.max("token_id") + 1, F.lit(0))).head()[0]
    new = [t for t in tokens if t not in present]
    if not new:
        return vocab
    added = vocab.sparkSession.createDataFrame([(t, free + i, 0, True) for i, t in enumerate(new)],
                                               "token string, token_id int, freq long, is_special boolean")
    return vocab.unionByName(added)


def special_ids(vocab: DataFrame, pad_token: str | None = None) -> DataFrame:
    """One row: mask_id, eos_id, unk_id, pad_id (the pad token, else EOS)."""
    def tid(tok):
        return F.max(F.when(F.col("token") == F.lit(tok), F.col("token_id")))
    pad = tid(pad_token) if pad_token else F.lit(None).cast("int")
    return vocab.agg(tid(MASK_TOKEN).alias("mask_id"), tid(EOS_TOKEN).alias("eos_id"),
                     tid(UNK_TOKEN).alias("unk_id"),
                     F.coalesce(pad, tid(EOS_TOKEN)).alias("pad_id"))


_MAPPED: dict = {}


def _mapped(name: str):
    """The lookup table of a file that Spark brought to this executor, mapped once a worker process, not copied."""
    import pyarrow as pa
    from pyspark import SparkFiles
    if name not in _MAPPED:
        if len(_MAPPED) >= 4:
            _MAPPED.clear()
        _MAPPED[name] = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).read_all().combine_chunks()
    return _MAPPED[name]


def token_hashes(tokens: list, seed: int):
    import numpy as np
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), seed) if t is not None else 0 for t in tokens), np.uint64, len(tokens))


def _index_file(spark, keys, values) -> tuple[str, int]:
    """A lookup index (keys → values) as an Arrow file that Spark brings to every executor: (its name, its hash seed).

    String keys are sorted by a 64-bit hash whose seed leaves them all apart; integer keys by themselves.  A key given
    twice keeps its first value."""
    import uuid

    import numpy as np
    import pyarrow as pa
    seed, cols = 0, {}
    if pa.types.is_string(keys.type) or pa.types.is_large_string(keys.type):
        text = keys.to_pylist()
        first = {t: i for i, t in reversed(list(enumerate(text))) if t is not None}
        at = np.fromiter(first.values(), np.int64, len(first))
        names = list(first)
        while len(np.unique(mark := token_hashes(names, seed))) < len(names):
            seed += 1
        order = np.argsort(mark, kind="stable")
        cols["mark"] = pa.array(mark[order])
        at = at[order]
    else:
        _, at = np.unique(np.asarray(keys), return_index=True)
    cols |= {"key": keys.take(pa.array(at)), "value": values.take(pa.array(at))}
    sink = pa.BufferOutputStream()
    table = pa.table(cols)
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table, max_chunksize=max(1, table.num_rows))
    name = f"lookup-{uuid.uuid4().hex}.arrow"
    dest = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dest)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(sink.getvalue().to_pybytes()))
    finally:
        stream.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addFile(dest)
    return name, seed


def find_values(table, keys, seed: int, default):
    """The value of each distinct key of an Arrow array, ``default`` (None: null) for a key that the index lacks.

    A batch costs its own distinct keys times the logarithm of the index, whatever the index's size."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    coded = keys.dictionary_encode() if not isinstance(keys, pa.DictionaryArray) else keys
    own, n = coded.dictionary, table.num_rows
    values = table.column("value").chunk(0) if n else pa.nulls(0, table.schema.field("value").type)
    if "mark" in table.column_names and n:
        marks = table.column("mark").chunk(0).to_numpy()
        mine = token_hashes(own.to_pylist(), seed)
        at = np.minimum(np.searchsorted(marks, mine), n - 1)
        known = pc.equal(table.column("key").chunk(0).take(pa.array(at)), own.cast(table.schema.field("key").type))
    elif n:
        keys_of, mine = table.column("key").chunk(0).to_numpy(), np.asarray(own)
        at = np.minimum(np.searchsorted(keys_of, mine), n - 1)
        known = pa.array(keys_of[at] == mine)
    else:
        at, known = np.zeros(len(own), np.int64), pa.array(np.zeros(len(own), bool))
    found = values.take(pa.array(np.where(np.asarray(pc.fill_null(known, False)), at, -1), mask=~np.asarray(pc.fill_null(known, False))))
    out = found.take(coded.indices)
    return out if default is None else pc.fill_null(out, pa.scalar(default, out.type))


def _lookup_partition(name: str, seed: int, in_col: str, out_col: str, default):
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        table = _mapped(name)
        for rb in batches:
            lists = rb.column(in_col)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            cols = [rb.column(i) for i in range(rb.num_columns) if rb.schema.names[i] != in_col]
            names = [n for n in rb.schema.names if n != in_col]
            ends, start = np.asarray(lists.offsets, np.int64), 0
            while start < rb.num_rows:  # rows of about RUN_TOKENS values at once: a lookup takes their size again and again
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + RUN_TOKENS, side="right")) - 1)
                stop = min(stop, rb.num_rows)
                mapped = find_values(table, lists.values.slice(ends[start], ends[stop] - ends[start]), seed, default)
                part = pa.ListArray.from_arrays(pa.array(ends[start:stop + 1] - ends[start], pa.int32()), mapped, mask=lists.slice(start, stop - start).is_null())
                yield pa.RecordBatch.from_arrays([c.slice(start, stop - start) for c in cols] + [part], names=names + [out_col])
                start = stop
    return fn


def _is_bounded(vocab: DataFrame, bound: int | None, limit: int) -> bool:
    if bound is not None:
        return bound <= limit
    return vocab.limit(limit + 1).count() <= limit


def _map_lookup(df: DataFrame, vocab: DataFrame, key_col: str, val_col: str, in_col: str,
                out_col: str, default, spark_type: T.DataType, arrow_type,
                default_key=None, table=None) -> DataFrame:
    spark = df.sparkSession
    ship_package(spark)
    # bounded (checked by the caller): the same size class as a broadcast join build side
    tbl = (table.select([key_col, val_col]) if table is not None
           else vocab.select(key_col, val_col).toArrow())
    keys, values = (tbl.column(i).combine_chunks() for i in (0, 1))
    keys, values = (c.combine_chunks() if hasattr(c, "combine_chunks") else c for c in (keys, values))
    values = values.cast(arrow_type)
    if default_key is not None:
        import pyarrow.compute as pc
        at = pc.index(keys, default_key).as_py()
        default = values[at].as_py() if at >= 0 else None
    name, seed = _index_file(spark, keys, values)
    fields = [f for f in df.schema.fields if f.name != in_col]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(spark_type), True)])
    fn = _lookup_partition(name, seed, in_col, out_col, default)
    return df.mapInArrow(fn, schema)


def encode(df: DataFrame, vocab: DataFrame, tokens_col: str = "tokens", keep=(),
           vocab_bound: int | None = None, unk_token: str = UNK_TOKEN,
           max_broadcast_entries: int = MAX_BROADCAST_ENTRIES, vocab_table=None) -> DataFrame:
    """Pre-token arrays → ``input_ids`` ARRAY<INT> and ``attention_mask`` ARRAY<TINYINT>.

    Unknown tokens map to ``unk_token``'s id.  No BOS/EOS is inserted.  Only
    ``keep`` columns survive (the original columns are dropped).
    """
    import pyarrow as pa
    keep = list(keep)
    base = df.select(*keep, tokens_col)
    if vocab_table is not None and vocab_table.num_rows <= max_broadcast_entries:
        vocab_bound = vocab_table.num_rows
    if _is_bounded(vocab, vocab_bound, max_broadcast_entries):
        ids = _map_lookup(base, vocab, "token", "token_id", tokens_col, "input_ids", None,
                          T.IntegerType(), pa.int32(), default_key=unk_token, table=vocab_table)
    else:
        unk = vocab.filter(F.col("token") == unk_token).agg(F.max("token_id")).scalar()
        ids = shuffle_lookup(base, vocab, "token", "token_id", tokens_col, "input_ids", unk)
    return ids.select(*keep, "input_ids", ones_like("input_ids").alias("attention_mask"))


def ones_like(col: str):
    return F.transform(F.col(col), lambda x: F.lit(1).cast("tinyint"))


def shuffle_lookup(df: DataFrame, pairs: DataFrame, key: str, value: str, in_col: str,
                   out_col: str, default=None, flat: bool = False) -> DataFrame:
    """Replace ``in_col``'s elements by their ``value`` through a shuffle join; the other columns stay.

    Rows are numbered and checkpointed first, so equal rows stay apart and a
    retry meets the same numbers.  A NULL array stays NULL, an empty one empty.
    ``flat``: values are arrays and are joined end to end.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    ex = rows.select("__row", F.posexplode(in_col).alias("__pos", "__key"))
    found = ex.join(pairs.select(F.col(key).alias("__key"), F.col(value).alias("__val")), "__key", "left")
    val = F.col("__val") if default is None else F.coalesce("__val", default)
    got = found.withColumn("v", val).groupBy("__row").agg(F.collect_list(F.struct("__pos", "v")).alias("__s"))
    out = F.transform(F.array_sort("__s"), lambda x: x["v"])
    out = F.flatten(out) if flat else out
    kind = pairs.schema[value].dataType.simpleString()
    empty = F.array().cast(kind if flat else f"array<{kind}>")
    return (rows.join(got, "__row", "left")
            .withColumn("__out", F.when(F.col(in_col).isNotNull(), F.coalesce(out, empty)))
            .drop("__row", "__s", in_col).withColumnRenamed("__out", out_col))


def decode(df: DataFrame, vocab: DataFrame, ids_col: str = "input_ids",
           out_col: str = "tokens", vocab_bound: int | None = None, vocab_table=None) -> DataFrame:
    """ids → token strings (unknown ids → null), keeping the other columns."""
    import pyarrow as pa
    if vocab_table is not None:
        vocab_bound = vocab_table.num_rows
    if not _is_bounded(vocab, vocab_bound, MAX_BROADCAST_ENTRIES):
        return shuffle_lookup(df, vocab, "token_id", "token", ids_col, out_col)
    return _map_lookup(df, vocab, "token_id", "token", ids_col, out_col, None,
                       T.StringType(), pa.string(), table=vocab_table)


def vocab_coverage(encoded: DataFrame, vocab: DataFrame, expected_size: int,
                   ids_col: str = "input_ids") -> DataFrame:
    """Largest id used, distinct ids used, vocabulary size and whether the model
    embedding table (``expected_size`` rows) must be resized."""
    used = encoded.select(F.explode(ids_col).alias("id")).agg(
        F.max("id").alias("max_id"), F.count_distinct("id").alias("distinct_ids"))
    size = vocab.agg(F.count(F.lit(1))).scalar()
    return (used.withColumn("vocab_size", size)
            .withColumn("expected_size", F.lit(expected_size).cast("long"))
            .withColumn("needs_resize", F.col("vocab_size") > F.col("expected_size")))
