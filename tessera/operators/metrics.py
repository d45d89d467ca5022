"""Evaluation aggregates.

Everything reduces to ``agg`` over rows or exploded positions; logits are
reduced to ids (arg-max) as early as possible, never shipped whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import BLEU_EPSILON, BLEU_MAX_N, BLEU_SAMPLE_ROWS, IGNORE_INDEX
from tessera.functions import arrays as A
from tessera.operators import kernels as K
from tessera.session import ship_package


def argmax_class(df: DataFrame, logits_col: str = "logits", out_col: str = "pred") -> DataFrame:
    """Arg-max class per row (first maximum wins)."""
    return df.withColumn(out_col, A.argmax(logits_col))


def argmax_long(df: DataFrame, keys, class_col: str = "class_id", logit_col: str = "logit",
                out_col: str = "pred") -> DataFrame:
    """Long form (keys…, class_id, logit): arg-max with ties to the smallest class id."""
    return df.groupBy(*keys).agg(
        F.max_by(class_col, F.struct(F.col(logit_col), -F.col(class_col))).alias(out_col))


def token_accuracy(pairs: DataFrame, pred_col: str = "pred", label_col: str = "label",
                   ignore: int | None = None) -> DataFrame:
    """Share of equal (pred, label) pairs.  By default −100 labels count (as wrong)."""
    src = pairs if ignore is None else pairs.filter(F.col(label_col) != ignore)
    return src.agg(F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy"))


def row_cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """−log softmax(logits)[label] (label is a 0-based class id)."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    lab = F.col(label) if isinstance(label, str) else label
    return A.logsumexp(lg) - F.element_at(lg, lab.cast("int") + 1).cast("double")


def cross_entropy(df: DataFrame, logits_col: str = "logits", label_col: str = "label",
                  ignore: int = IGNORE_INDEX) -> DataFrame:
    """Mean CE over rows whose label is not ``ignore`` (already aligned)."""
    kept = df.filter(F.col(label_col) != ignore)
    return kept.agg(F.avg(row_cross_entropy(logits_col, label_col)).alias("cross_entropy"))


def shifted_cross_entropy(df: DataFrame, seq_col: str, pos_col: str = "pos",
                          logits_col: str = "logits", label_col: str = "label",
                          ignore: int = IGNORE_INDEX) -> DataFrame:
    """Sequences in long form: logits at position t score the label at t+1.

    The window is partitioned by sequence (bounded by sequence length).
    """
    w = Window.partitionBy(seq_col).orderBy(pos_col)
    nxt = df.withColumn("__next", F.lead(label_col).over(w)).filter(F.col("__next").isNotNull())
    return cross_entropy(nxt, logits_col, "__next", ignore)


def mean_loss(df: DataFrame, loss_col: str = "loss") -> DataFrame:
    return df.agg(F.avg(loss_col).alias("loss"))


def perplexity(loss: Column | str) -> Column:
    """exp(loss); overflow gives +Infinity."""
    col = F.col(loss) if isinstance(loss, str) else loss
    return F.exp(col)


def eval_samples(df: DataFrame, cap: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg((n if cap is None else F.least(n, F.lit(cap).cast("long"))).alias("eval_samples"))


def _matches(n_keys: int, max_n: int):
    """Rows (keys…, hyp, ref) → (keys…, matches): clipped n-gram matches for n = 1..``max_n``, row by row."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        for rb in batches:
            found, start = [], 0
            held = np.cumsum(sum(np.diff(np.asarray(rb.column(i).offsets).astype(np.int64)) for i in (n_keys, n_keys + 1)))
            while start < rb.num_rows:  # rows of about RUN_TOKENS ids at once
                before = held[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(held, before + K.RUN_TOKENS, side="right")))
                part, start = rb.slice(start, stop - start), stop
                sides = []
                for i in (n_keys, n_keys + 1):
                    rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    for first, offsets, flat in K.list_runs(part.column(i)):
                        rows.append(K.row_of(offsets) + first)
                        values.append(flat)
                    sides += [np.concatenate(rows), np.concatenate(values)]
                found.append(K.clipped_matches(*sides, part.num_rows, max_n))
            out = np.concatenate(found) if found else np.zeros((0, max_n), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * max_n, pa.int32()), pa.array(out.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*rb.columns, lists], names=[*rb.schema.names, "__m"])
    return fn


def sentence_bleu(df: DataFrame, keys, hyp_col: str = "pred", ref_col: str = "labels",
                  max_n: int = BLEU_MAX_N, epsilon: float = BLEU_EPSILON,
                  id_bound: int | None = None, pad_id: int | None = None) -> DataFrame:
    """Sentence BLEU per row (one reference), uniform weights, smoothing method 1.

    p_n = clipped matches / max(1, hyp n-grams); zero numerators become ε.
    No unigram match → 0.  Brevity penalty exp(1 − r/c) when c ≤ r (c = 0 → 0).
    n-grams are counted inside the row by sorting (``kernels.clipped_matches``): no row of n-grams, no shuffle.
    ``pad_id`` is taken out of both sides first; a null side is empty.
    """
    keys = list(keys)
    ship_package(df.sparkSession)
    real = (lambda c: F.col(c)) if pad_id is None else (lambda c: F.filter(c, lambda x: x != pad_id))
    base = df.select(*keys, real(hyp_col).cast("array<int>").alias("__h"), real(ref_col).cast("array<int>").alias("__r"))
    schema = T.StructType([*base.schema.fields, T.StructField("__m", T.ArrayType(T.LongType()))])
    per_row = (base.mapInArrow(_matches(len(keys), max_n), schema)
               .withColumn("__c", F.greatest(F.coalesce(F.size("__h"), F.lit(0)), F.lit(0)))
               .withColumn("__rl", F.greatest(F.coalesce(F.size("__r"), F.lit(0)), F.lit(0))))
    logp = None
    for k in range(1, max_n + 1):
        m = F.col("__m")[k - 1].cast("double")
        den = F.greatest(F.col("__c") - k + 1, F.lit(1)).cast("double")
        p = F.when(m > 0, m).otherwise(F.lit(epsilon)) / den
        term = F.log(p) / F.lit(max_n)
        logp = term if logp is None else logp + term
    c, r = F.col("__c").cast("double"), F.col("__rl").cast("double")
    bp = F.when(c > r, 1.0).when(c == 0, 0.0).otherwise(F.exp(1 - r / c))
    return per_row.select(*keys, F.when(F.col("__m")[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(logp)).alias("bleu"))


def bleu(df: DataFrame, keys, hyp_col: str = "pred", ref_col: str = "labels",
         sample: int | None = BLEU_SAMPLE_ROWS, order_cols=None, id_bound: int | None = None,
         pad_id: int | None = None) -> DataFrame:
    """Mean sentence BLEU over the first ``sample`` rows (by ``order_cols``) or all rows."""
    src = df
    if sample is not None:
        src = df.orderBy(*(order_cols or keys)).limit(sample)
    per = sentence_bleu(src, keys, hyp_col, ref_col, id_bound=id_bound, pad_id=pad_id)
    return per.agg(F.coalesce(F.avg("bleu"), F.lit(0.0)).alias("bleu"))


def last_token(df: DataFrame, ids_col: str = "input_ids", pad_id: int | None = None,
               strict: bool = False, out_col: str = "last_pos") -> DataFrame:
    """Right-most non-pad position and the id there (the pooled position)."""
    if strict and pad_id is None:
        raise ValueError("cannot handle more than one row without a pad id")
    pos = A.last_non_pad(ids_col, pad_id)
    return (df.withColumn(out_col, pos.cast("int"))
            .withColumn("pooled_id", F.element_at(F.col(ids_col), F.col(out_col) + 1)))


def problem_type(schema: T.StructType, label_col: str, num_labels: int) -> str:
    """regression (1 label) / single-label (integer labels) / multi-label."""
    if num_labels == 1:
        return "regression"
    dt = schema[label_col].dataType
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "single_label_classification"
    return "multi_label_classification"


def mse(df: DataFrame, pred_col: str = "pred", label_col: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(pred_col) - F.col(label_col), 2)).alias("mse"))


def class_ce(df: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    return df.agg(F.avg(row_cross_entropy(logits_col, label_col)).alias("class_ce"))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce(df: DataFrame, logits_col: str = "logits", labels_col: str = "labels") -> DataFrame:
    """Multi-label BCE with logits, mean over every (row, label) element."""
    z = F.arrays_zip(F.col(logits_col).alias("x"), F.col(labels_col).alias("y"))
    el = df.select(F.explode(z).alias("__z"))
    return el.agg(F.avg(bce_with_logits(F.col("__z.x").cast("double"),
                                        F.col("__z.y").cast("double"))).alias("bce"))


def token_class_ce(df: DataFrame, logits_col: str = "logits", labels_col: str = "labels",
                   ignore: int = IGNORE_INDEX) -> DataFrame:
    """Per-position CE, no shift: logits ARRAY<ARRAY<DOUBLE>> vs labels ARRAY<INT>."""
    z = F.arrays_zip(F.col(logits_col).alias("lg"), F.col(labels_col).alias("y"))
    el = df.select(F.explode(z).alias("__z")).select(F.col("__z.lg").alias("lg"), F.col("__z.y").alias("y"))
    return el.filter(F.col("y") != ignore).agg(
        F.avg(row_cross_entropy("lg", "y")).alias("token_class_ce"))


def choice_ce(df: DataFrame, item_col: str, choice_col: str, score_col: str,
              label_col: str) -> DataFrame:
    """Multiple choice: per item, logsumexp(scores) − score of the labelled choice; mean.

    Two aggregations with partial (map-side) combine; no per-item list is built,
    so an item with a huge number of candidates never sits in one task's memory.
    """
    stats = df.groupBy(item_col).agg(F.max(score_col).alias("__m"), F.max(label_col).alias("__lab"))
    joined = df.select(item_col, choice_col, score_col).join(stats, item_col)
    per = joined.groupBy(item_col).agg(
        (F.first("__m") + F.log(F.sum(F.exp(F.col(score_col) - F.col("__m"))))).alias("__lse"),
        F.max(F.when(F.col(choice_col) == F.col("__lab"), F.col(score_col))).alias("__pick"))
    return per.agg(F.avg(F.col("__lse") - F.col("__pick")).alias("choice_ce"))


def span_ce(df: DataFrame, start_logits: str = "start_logits", end_logits: str = "end_logits",
            start_col: str = "start", end_col: str = "end") -> DataFrame:
    """Clamp start/end to [0, len]; positions equal to len are ignored; (CE_s + CE_e)/2."""
    n = F.size(start_logits)
    s = F.greatest(F.lit(0), F.least(F.col(start_col), n))
    e = F.greatest(F.lit(0), F.least(F.col(end_col), n))
    ce_s = F.avg(F.when(s != n, row_cross_entropy(start_logits, s)))
    ce_e = F.avg(F.when(e != n, row_cross_entropy(end_logits, e)))
    return df.agg(((ce_s + ce_e) / 2).alias("span_ce"))


def choice_position(df: DataFrame, ids_col: str, cls_id: int, out_col: str = "cls_pos") -> DataFrame:
    """0-based position of the first ``cls_id``; absent → the last token."""
    ids = F.col(ids_col)
    found = F.array_position(ids, F.lit(cls_id))
    return df.withColumn(out_col, F.when(found > 0, found - 1).otherwise(F.size(ids) - 1).cast("int"))


def evaluate(pairs_acc: DataFrame, losses: DataFrame, bleu_df: DataFrame,
             samples: DataFrame) -> DataFrame:
    """One metrics row: accuracy, loss, perplexity, bleu, eval_samples.

    The inputs are one-row aggregates; they are combined as scalar subqueries."""
    loss = losses.select("loss").scalar()
    return pairs_acc.select("accuracy", loss.alias("loss"), bleu_df.select("bleu").scalar().alias("bleu"),
                            samples.select("eval_samples").scalar().alias("eval_samples"),
                            perplexity(loss).alias("perplexity"))


def user_metric(df: DataFrame, group_cols, fn, value_col: str, name: str,
                return_type: str = "double") -> DataFrame:
    """A user-supplied metric as a grouped-aggregate pandas UDF (Series → scalar).

    The hook for a user ``compute_metrics``: Spark groups and shuffles, ``fn``
    sees one group's values as a pandas Series (keep groups bounded, e.g. per
    batch or per split, not one global group).
    """
    import pandas as pd
    from tessera.session import ship_package
    ship_package(df.sparkSession)

    def agg(v: pd.Series) -> float:
        return fn(v)
    agg.__annotations__ = {"v": pd.Series, "return": float}
    udf = F.pandas_udf(agg, return_type)
    return df.groupBy(*group_cols).agg(udf(F.col(value_col)).alias(name))
