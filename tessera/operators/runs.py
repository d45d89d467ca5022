"""Run analytics over configs, logs, checkpoints and parameter tables.

Run logs are long tables (run, step, metric, value).  Per-run windows are
bounded by the number of logged steps of one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG_SCHEMA = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("dataset", T.StructType([
        T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("num_proc", T.LongType())])),
    T.StructField("batch_size", T.LongType()),
    T.StructField("validation_split_percentage", T.StringType()),
    T.StructField("max_train_samples", T.LongType()),
    T.StructField("max_eval_samples", T.LongType()),
    T.StructField("streaming", T.BooleanType()),
    T.StructField("seed", T.LongType()),
    T.StructField("data_seed", T.LongType()),
    T.StructField("num_train_epochs", T.DoubleType()),
    T.StructField("per_device_train_batch_size", T.LongType()),
    T.StructField("per_device_eval_batch_size", T.LongType()),
    T.StructField("gradient_accumulation_steps", T.LongType()),
    T.StructField("max_seq_length", T.LongType()),
    T.StructField("block_size", T.LongType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("weight_decay", T.DoubleType()),
    T.StructField("warmup_ratio", T.DoubleType()),
    T.StructField("lr_scheduler_type", T.StringType()),
    T.StructField("logging_steps", T.LongType()),
    T.StructField("eval_steps", T.LongType()),
    T.StructField("save_steps", T.LongType()),
    T.StructField("save_total_limit", T.LongType()),
    T.StructField("metric_for_best_model", T.StringType()),
    T.StructField("greater_is_better", T.BooleanType()),
    T.StructField("load_best_model_at_end", T.BooleanType()),
    T.StructField("keep_in_memory", T.BooleanType()),
    T.StructField("overwrite_cache", T.BooleanType()),
    T.StructField("bf16", T.BooleanType()),
    T.StructField("gradient_checkpointing", T.BooleanType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


RECORD_MARK = "\x1e"  # ends a config in a file of many: JSON escapes control characters, so no config holds it


def read_configs(spark, path: str, schema: T.StructType = CONFIG_SCHEMA, many: bool = False) -> DataFrame:
    """Multi-line JSON run configs with a fixed schema; keys outside it are in ``all_keys``.

    Each file is read once as whole text and parsed with ``from_json``;
    ``unknown_keys`` lists the top-level keys the schema does not declare.
    ``many``: a file holds any number of configs, each ended by ``RECORD_MARK`` and read whole, so
    a folder costs its bytes and not a listing, an opening and a commit a config.
    """
    lines = spark.read.text(path, lineSep=RECORD_MARK) if many else spark.read.text(path, wholetext=True)
    raw = lines.withColumn("config_file", F.input_file_name())
    return parse_configs(raw, "value", schema, keep=["config_file"])


_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def parse_configs(df: DataFrame, json_col: str, schema: T.StructType, keep=()) -> DataFrame:
    """JSON text column → typed fields of ``schema`` plus ``unknown_keys``
    (top-level keys the schema does not declare, sorted) and ``all_keys``
    (MAP of every top-level key to its value as text)."""
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    parsed = df.select(*keep, F.from_json(json_col, schema).alias("__c"),
                       F.array_sort(F.filter(F.json_object_keys(json_col),
                                             lambda k: ~F.array_contains(known, k))).alias("unknown_keys"),
                       F.from_json(json_col, _TEXT_MAP).alias("all_keys"))
    return parsed.select(*keep, "__c.*", "unknown_keys", "all_keys")


def config_pairs(cfgs: DataFrame, run_col: str = "run_name") -> DataFrame:
    """(run, pairs): each config's (key, value-as-string) entries: the declared keys by their typed
    value, every other top-level key of ``all_keys`` by its text.  An object's keys are sorted."""
    cols = [c for c in cfgs.columns if c not in (run_col, "config_file", "unknown_keys", "all_keys", "_corrupt_record")]
    more = "all_keys" in cfgs.columns
    text = lambda c: F.col("all_keys").getItem(c) if more else F.lit(None).cast("string")

    def value(c):
        if not isinstance(cfgs.schema[c].dataType, T.StructType):
            return F.coalesce(F.col(c).cast("string"), text(c))
        whole = F.map_from_entries(F.array_sort(F.map_entries(F.from_json(text(c), _TEXT_MAP))))
        return F.coalesce(F.to_json(whole), F.to_json(F.col(c)))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in cols])
    if more:
        known = F.array(*[F.lit(c) for c in [*cols, run_col]])
        rest = F.filter(F.map_entries("all_keys"), lambda e: ~F.array_contains(known, e["key"]))
        pairs = F.concat(pairs, F.coalesce(rest, F.array().cast("array<struct<key:string,value:string>>")))
    return cfgs.select(run_col, pairs.alias("pairs"))


def config_long(cfgs: DataFrame, run_col: str = "run_name") -> DataFrame:
    """Unpivot configs to (run, key, value-as-string)."""
    return config_pairs(cfgs, run_col).select(run_col, F.explode("pairs").alias("__kv")).select(run_col, "__kv.key", "__kv.value")


def config_diff(cfgs: DataFrame, baseline_run: str, run_col: str = "run_name") -> DataFrame:
    """(key, run, value, baseline) for keys whose value differs from the baseline run's (null-safe; a key that one of the two lacks is null there).

    A run's keys are compared inside its own row with the baseline's, which is one value: nothing is joined or exploded
    but the differences.  Of several baseline rows one counts."""
    rows = config_pairs(cfgs, run_col).select(run_col, F.map_from_entries("pairs").alias("own"))
    base = rows.filter(F.col(run_col) == baseline_run).agg(F.first("own")).scalar()
    both = rows.filter(F.col(run_col) != baseline_run).withColumn("base", F.coalesce(base, F.create_map().cast("map<string,string>")))
    entries = F.transform(F.array_union(F.map_keys("own"), F.map_keys("base")), lambda k: F.struct(
        k.alias("key"), F.try_element_at("own", k).alias("value"), F.try_element_at("base", k).alias("baseline")))
    odd = F.filter(entries, lambda e: ~e["value"].eqNullSafe(e["baseline"]))
    return both.select(run_col, F.explode(odd).alias("__d")).select("__d.key", run_col, "__d.value", "__d.baseline")


def parse_overrides(col, allowed=None, config_name=None, model_path=None) -> F.Column:
    """``k=v,k=v`` → MAP<STRING,STRING>; the last of repeated keys wins, a pair without ``=`` has a null value.

    ``allowed``: keys that may be given; any other raises.  ``config_name``, ``model_path``: columns of the run's config
    name and model path; overrides given together with either raise."""
    c = F.col(col) if isinstance(col, str) else col
    for other in (config_name, model_path):
        if other is not None:
            given = F.col(other) if isinstance(other, str) else other
            c = F.when(c.isNotNull() & given.isNotNull(), F.raise_error(F.lit(
                "overrides cannot be combined with a config name or a model path")).cast("string")).otherwise(c)
    pairs = F.split(c, ",")
    key = lambda p: F.substring_index(p, "=", 1)
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: key(q) == key(p)))
    value = lambda p: F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p)))
    if allowed is not None:
        known = F.array(*[F.lit(a) for a in allowed])
        odd = F.filter(F.transform(last, key), lambda k: ~F.array_contains(known, k))
        last = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown override: "), F.array_join(odd, ", ")))
                      .cast("array<string>")).otherwise(last)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(key(p).alias("key"), value(p).alias("value"))))


def on_logging_step(log: DataFrame, every: int, step_col: str = "step") -> DataFrame:
    return log.filter((F.col(step_col) % every) == 0)


def best_step(log: DataFrame, metric: str = "eval_loss", greater: bool = False,
              run_col: str = "run") -> DataFrame:
    """Best value per run; ties → earliest step.  NULL and NaN never are the best; a run of nothing else has NULL."""
    m = log.filter(F.col("metric") == metric)
    number = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    value = -F.col("value") if greater else F.col("value")
    best = F.min(F.when(number, F.struct(value.alias("key"), F.col("step"), F.col("value")))).alias("__best")
    return m.groupBy(run_col).agg(best).select(
        run_col, F.col("__best.step").alias("best_step"), F.col("__best.value").alias("best_value"))


def early_stop(log: DataFrame, metric: str = "eval_loss", patience: int = 2,
               threshold: float = 0.0, greater: bool = False, run_col: str = "run",
               chunk_steps: int = 100_000) -> DataFrame:
    """First evaluation at which ``patience`` consecutive evaluations failed to
    improve the best of all earlier ones by more than ``threshold``; the best is
    taken over the evaluations up to the stop (training ends there).

    Skew-safe two-level scan.  (run, step) is unique and steps are integers, so
    chunk = step div ``chunk_steps`` holds at most ``chunk_steps`` rows; windows
    run per (run, chunk), and one small per-chunk table (one row per chunk)
    carries row counts, the running best and the last improving position from
    earlier chunks.  A run holding a third of all rows spreads over many tasks.
    """
    v = F.col("value") if not greater else -F.col("value")   # lower is better from here
    m = (log.filter(F.col("metric") == metric)
         .select(run_col, "step", v.alias("__v"))
         .withColumn("__c", F.floor(F.col("step") / chunk_steps).cast("long")))
    in_chunk = Window.partitionBy(run_col, "__c").orderBy("step")
    chunks = Window.partitionBy(run_col).orderBy("__c")
    before = Window.unboundedPreceding
    # pass 1: position in the run and best of all earlier evaluations
    c1 = m.groupBy(run_col, "__c").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__cm"))
    c1 = c1.select(run_col, "__c",
                   F.coalesce(F.sum("__n").over(chunks.rowsBetween(before, -1)), F.lit(0)).alias("__off"),
                   F.min("__cm").over(chunks.rowsBetween(before, -1)).alias("__bm"))
    p1 = m.join(c1, [run_col, "__c"]).withColumn("__pos", F.col("__off") + F.row_number().over(in_chunk))
    best = F.least(F.col("__bm"), F.min("__v").over(in_chunk.rowsBetween(before, -1)))  # skips nulls
    p1 = p1.withColumn("improved", best.isNull() | ((best - F.col("__v")) > threshold))
    # pass 2: streak = evaluations since the last improving one of the run
    c2 = p1.groupBy(run_col, "__c").agg(F.max(F.when(F.col("improved"), F.col("__pos"))).alias("__ci"))
    c2 = c2.select(run_col, "__c", F.max("__ci").over(chunks.rowsBetween(before, -1)).alias("__bi"))
    p2 = p1.join(c2, [run_col, "__c"])
    last_imp = F.greatest(F.col("__bi"), F.max(F.when(F.col("improved"), F.col("__pos"))).over(
        in_chunk.rowsBetween(before, Window.currentRow)))
    p2 = p2.withColumn("__streak", F.col("__pos") - last_imp)
    stops = p2.groupBy(run_col).agg(
        F.min(F.when(F.col("__streak") >= patience, F.col("step"))).alias("stop_step"))
    upto = log.join(stops, run_col).filter(
        F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step"))).drop("stop_step")
    return stops.join(best_step(upto, metric, greater, run_col), run_col)


def retain_checkpoints(ckpts: DataFrame, k: int, best: DataFrame | None = None,
                       run_col: str = "run") -> DataFrame:
    """Newest ``k`` checkpoints per run, plus the best one when given, with ``rank_newest`` from 1.

    A bounded top-k: every task hands on ``k`` rows a run at most.  The rank of a best checkpoint beyond
    them is a count of the newer ones, added up from partial counts; no run is sorted whole."""
    newest = Window.partitionBy(run_col).orderBy(F.desc("step"))
    top = ckpts.withColumn("rank_newest", F.row_number().over(newest)).filter(F.col("rank_newest") <= k)
    if best is None:
        return top
    one = best.select(F.col(run_col).alias("__run"), F.col("best_step").alias("__best"))
    since = ckpts.join(one, F.col(run_col).eqNullSafe(F.col("__run"))).filter(F.col("step") >= F.col("__best"))
    rank = since.groupBy("__run", "__best").agg(F.count(F.lit(1)).alias("rank_newest")).filter(F.col("rank_newest") > k)
    old = ckpts.join(rank, F.col(run_col).eqNullSafe(F.col("__run")) & (F.col("step") == F.col("__best"))).drop("__run", "__best")
    return top.unionByName(old.withColumn("rank_newest", F.col("rank_newest").cast("int")))


def resume_point(ckpts: DataFrame, explicit: str | None = None, run_col: str = "run",
                 outputs: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Explicit checkpoint wins, else the latest detected one per run.

    ``outputs`` lists the files of the runs' output folders (a row a file, column
    ``run_col``): a run that has files but no checkpoint raises, whether or not one is given explicitly.  ``overwrite``:
    the folders are not looked at, so nothing is detected and nothing raises."""
    last = ckpts.groupBy(run_col).agg(F.max_by("path", "step").alias("last_checkpoint"),
                                      F.max("step").alias("last_step"))
    if outputs is not None:
        last = last.join(outputs.select(run_col).distinct(), run_col, "full_outer")
    if overwrite:
        last = last.withColumn("last_checkpoint", F.lit(None).cast("string")).withColumn("last_step", F.lit(None).cast("long"))
    elif outputs is not None:
        stop = F.raise_error(F.concat(F.lit("output folder is not empty but holds no checkpoint: "), F.col(run_col)))
        last = last.withColumn("last_checkpoint", F.coalesce("last_checkpoint", stop.cast("string")))
    return last.withColumn("resume_from", F.coalesce(F.lit(explicit).cast("string"),
                                                     F.col("last_checkpoint")))


def grad_norms(log: DataFrame, every: int | None = None, run_col: str = "run") -> DataFrame:
    """L2 norm per (run, step, parameter) from gradient values; optional logging-step filter."""
    src = log if every is None else on_logging_step(log, every)
    sq = F.aggregate("grad", F.lit(0.0), lambda acc, g: acc + g.cast("double") * g.cast("double"))
    return src.groupBy(run_col, "step", "name").agg(F.sqrt(F.sum(sq)).alias("grad_norm"))


def param_totals(inv: DataFrame, storage_col: str | None = None) -> DataFrame:
    src = inv.dropDuplicates([storage_col]) if storage_col else inv
    tot = F.sum("numel")
    tr = F.sum(F.when(F.col("trainable"), F.col("numel")).otherwise(0))
    return src.agg(tot.alias("all_params"), tr.alias("trainable_params"),
                   (F.lit(100.0) * tr / tot).alias("trainable_pct"))


def param_dtypes(inv: DataFrame) -> DataFrame:
    return inv.groupBy("dtype").agg(
        F.sum("numel").alias("numel"),
        (F.sum(F.col("numel") * F.col("bytes_per_elem")) / F.lit(1024.0 ** 3)).alias("memory_gb"))


def param_layers(inv: DataFrame) -> DataFrame:
    """Per top-level layer (name up to the first dot): trainable / frozen counts."""
    layer = F.split(F.col("name"), r"\.").getItem(0)
    return inv.groupBy(layer.alias("layer")).agg(
        F.sum(F.when(F.col("trainable"), F.col("numel")).otherwise(0)).alias("trainable"),
        F.sum(F.when(~F.col("trainable"), F.col("numel")).otherwise(0)).alias("non_trainable")) \
        .withColumn("frozen", F.col("trainable") == 0)


def compare_runs(log: DataFrame, metric: str, greater: bool = False,
                 run_col: str = "run") -> DataFrame:
    """Long comparison: per step, each run's value and its rank among runs."""
    m = log.filter(F.col("metric") == metric)
    order = F.desc("value") if greater else F.asc("value")
    w = Window.partitionBy("step").orderBy(order)
    return m.select("step", run_col, "value").withColumn("rank", F.rank().over(w))


def compare_runs_wide(log: DataFrame, metric: str, runs: list[str], run_col: str = "run") -> DataFrame:
    """Wide comparison: one column per run (explicit run list: no discovery pass)."""
    m = log.filter(F.col("metric") == metric)
    return m.groupBy("step").pivot(run_col, runs).agg(F.first("value"))
