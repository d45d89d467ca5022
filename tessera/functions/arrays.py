"""Per-row array expressions (higher-order functions, JVM-side).

All helpers take and return Columns; none of them leaves the row, so they run
inside whole-stage codegen with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def empty_like(arr: Column) -> Column:
    return F.slice(arr, 1, 0)


def interleave_mask(ids, mask_id, pad_id) -> Column:
    """x0, M, x1, M, …, x(n-1): length 2n-1; the slot before x_k is pad when x_k is pad."""
    ids, m, p = _c(ids), _lit(mask_id), _lit(pad_id)
    pairs = F.flatten(F.transform(ids, lambda x: F.array(F.when(x == p, p).otherwise(m), x)))
    n = F.size(ids)
    return F.when(n > 0, F.slice(pairs, 2, n * 2 - 1)).otherwise(empty_like(ids))


def interleave_attention(am) -> Column:
    """Each attention value doubled, first dropped: length 2n-1."""
    am = _c(am)
    n = F.size(am)
    pairs = F.flatten(F.transform(am, lambda a: F.array(a, a)))
    return F.when(n > 0, F.slice(pairs, 2, n * 2 - 1)).otherwise(empty_like(am))


def stride(arr, start: int = 0, step: int = 2) -> Column:
    """Every ``step``-th element from 0-based ``start`` (token slots of the interleaved form)."""
    return F.filter(_c(arr), lambda x, i: (i >= start) & (((i - start) % step) == 0))


def drop_pad(arr, pad_id) -> Column:
    """Remove pad ids; a null ``pad_id`` keeps the array unchanged."""
    arr = _c(arr)
    if pad_id is None:
        return arr
    p = _lit(pad_id)
    return F.when(p.isNull(), arr).otherwise(F.filter(arr, lambda x: x != p))


def dual_labels(labels, interleaved: bool = True) -> Column:
    """Targets for the interleaved form (length 2n-2): even slots labels[1:], odd labels[:-1].

    Not interleaved: labels[1:].
    """
    lab = _c(labels)
    n = F.size(lab)
    if not interleaved:
        return F.when(n > 1, F.slice(lab, 2, n - 1)).otherwise(empty_like(lab))
    idx = F.sequence(F.lit(0), n * 2 - 3)
    body = F.transform(idx, lambda i: F.when(i % 2 == 0, F.element_at(lab, F.floor(i / 2).cast("int") + 2))
                       .otherwise(F.element_at(lab, F.floor(i / 2).cast("int") + 1)))
    return F.when(n > 1, body).otherwise(empty_like(lab))


def last_non_pad(ids, pad_id) -> Column:
    """Index of the right-most non-pad id (all pad → 0); no pad id → last index."""
    ids = _c(ids)
    if pad_id is None:
        return F.size(ids) - 1
    p = _lit(pad_id)
    return F.coalesce(F.array_max(F.transform(ids, lambda x, i: F.when(x != p, i).otherwise(0))),
                      F.lit(0))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def logsumexp(arr) -> Column:
    """Stable log Σ exp(x)."""
    a = _c(arr)
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(s)


def shift_pairs(pred, label) -> Column:
    """arrays_zip(pred[:-1], label[1:]) as an array of (pred, label) structs."""
    p, lab = _c(pred), _c(label)
    n = F.least(F.size(p), F.size(lab))
    zipped = F.arrays_zip(F.slice(p, 1, n - 1).alias("pred"), F.slice(lab, 2, n - 1).alias("label"))
    return F.when(n > 1, zipped).otherwise(F.slice(zipped, 1, 0))


def infill(ids) -> Column:
    """(left, target, right) for each mask slot: targets x_0 … x_(n-2).

    The slot between x_k and x_(k+1) is labelled x_k and sees x_(k-1) (null for
    k = 0) on the left and x_(k+1) on the right.
    """
    a = _c(ids)
    n = F.size(a)
    body = F.transform(F.sequence(F.lit(0), n - 2),
                       lambda k: F.struct(F.when(k >= 1, F.element_at(a, F.greatest(k, F.lit(1))))
                                          .alias("left"),
                                          F.element_at(a, k + 1).alias("target"),
                                          F.element_at(a, k + 2).alias("right")))
    return F.when(n > 1, body).otherwise(F.array().cast(
        "array<struct<left:int,target:int,right:int>>"))
