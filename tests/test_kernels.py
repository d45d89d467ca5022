"""Array kernels, scoring by distinct pairs and row-wise BLEU against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import metrics as E
from tessera.operators import model as N


def test_code_counts_fold_and_hand_on():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 500, 5000)
    c, got, most = K.CodeCounts(fold_bytes=800, max_codes=100), Counter(), 0
    for part in np.array_split(codes, 13):
        for k, n in c.add(part):
            most = max(most, len(k))
            got.update(dict(zip(k.tolist(), n.tolist())))
        assert c.held < 800 and len(c.codes) < 300
    for k, n in c.finish():
        got.update(dict(zip(k.tolist(), n.tolist())))
    assert got == Counter(codes.tolist()) and most < 300


def plain_bleu(h, r, eps=0.1):
    m = []
    for n in range(1, 5):
        grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))  # noqa: E731, B023
        m.append(sum((grams(h) & grams(r)).values()))
    if not m[0]:
        return 0.0
    logp = sum(math.log((v or eps) / max(1, len(h) - n)) for n, v in enumerate(m)) / 4
    return (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(logp)


def test_bleu_in_the_row_matches_plain_version(spark, monkeypatch):
    monkeypatch.setattr(K, "RUN_TOKENS", 40)
    rnd = random.Random(4)
    big = [0, 2 ** 31 - 1, 7, 9, 11]
    rows = [(i, [rnd.choice(big) for _ in range(rnd.randrange(0, 30))], [rnd.choice(big) for _ in range(rnd.randrange(0, 30))]) for i in range(60)]
    rows += [(60, None, [1]), (61, [1], None), (61, [1, 2, 3, 4], [1, 2, 3, 4]), (62, [], [])]
    df = spark.createDataFrame(rows, "k long, pred array<int>, labels array<int>").repartition(3)
    out = E.sentence_bleu(df, ["k"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["k"], round(r["bleu"], 9)) for r in out.collect())
    assert got == sorted((k, round(plain_bleu(h or [], r or []), 9)) for k, h, r in rows)


def plain_scores(train, rows, vocab, add_k=1.0):
    pair, prev, uni = Counter(), Counter(), Counter(x for t in train for x in t)
    for t in train:
        for a, b in zip(t, t[1:]):
            pair[a, b] += 1
            prev[a] += 1
    top = {a: min((-n, y) for (x, y), n in pair.items() if x == a)[1] for a in prev}
    fb = min((-n, x) for x, n in uni.items())[1]
    out = []
    for k, ids in rows:
        ids = ids or []
        nll = [-math.log((pair[p] + add_k) / (prev[p[0]] + add_k * vocab)) for p in zip(ids, ids[1:])]
        out.append((k, ids, [top.get(x, fb) for x in ids], round(sum(nll) / len(nll), 9) if nll else None, len(nll)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_pairs,chunk", [(10_000, 1000), (0, 1000), (3, 50)])
def test_scores_match_plain_version_by_both_routes(spark, monkeypatch, max_pairs, chunk):
    monkeypatch.setattr(N, "CHUNK_TOKENS", chunk)
    rnd = random.Random(9)
    ids = lambda: [min(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.randrange(0, 25))]
    train, rows = [ids() for _ in range(20)], [(i // 2, ids()) for i in range(40)] + [(50, []), (51, None), (52, [11]), (53, [1] * 300)]
    tdf = spark.createDataFrame([(t,) for t in train], "input_ids array<int>").repartition(2)
    df = spark.createDataFrame(rows, "k int, input_ids array<int>").repartition(4)
    out = N.score_next_token(N.fit_next_token(tdf), df, ["k"], 12, train_blocks=tdf, stats_bound=12, max_pairs=max_pairs)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["k"], r["labels"] or [], r["pred"], None if r["loss"] is None else round(r["loss"], 9), r["n_pairs"]) for r in out.collect()), key=repr)
    assert got == plain_scores(train, rows, 12)


def test_counts_stay_right_when_they_are_handed_on(spark, monkeypatch):
    rows = [([1, 2, 1, 2, 3],), ([],), (None,), ([2],), ([3, 1, 2],)]
    df = spark.createDataFrame(rows, "input_ids array<int>").coalesce(1)
    want = Counter(p for (r,) in rows for p in zip(r or [], (r or [])[1:]))
    got = {(r["prev_id"], r["next_id"]): r["n"] for r in N.fit_next_token(df).collect()}
    assert got == want
    fast = sorted(map(tuple, N.infill_counts(df, id_bound=4).select("left", "target", "right", "n").collect()), key=repr)
    slow = sorted(map(tuple, N.infill_counts(df).select("left", "target", "right", "n").collect()), key=repr)
    assert fast == slow
    assert N.unigram_top(df).first()[0] == 2


def test_triples_of_any_lists_in_slices(spark, monkeypatch):
    """Triples cut in Arrow equal the array form: null and empty lists, one value, null values, several keys, runs cut anywhere."""
    from tessera.functions import arrays as A
    from tessera.operators import blocks as B
    rows = [(i, None if i % 7 == 0 else f"k{i}", None if i % 11 == 0 else [None if (i + j) % 5 == 0 else j for j in range(i % 9)]) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b string, input_ids array<int>").repartition(3)
    old = df.select("a", "b", F.posexplode(A.infill("input_ids")).alias("pos", "t")).select("a", "b", "pos", "t.*")
    got = B.infill_triples(df, ["a", "b"])
    assert got.columns == old.columns and [f.dataType for f in got.schema] == [f.dataType for f in old.schema]
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, old.collect()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([list(range(i % 6)) for i in range(40)], pa.list_(pa.int32()))], names=["k", "x"])
    names = ["k", "pos", "left", "target", "right"]
    whole = [r for b in B._triples(names)([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(K, "RUN_TOKENS", 7)
    cut = list(B._triples(names)([batch]))
    assert len(cut) > 5 and [r for b in cut for r in b.to_pylist()] == whole


def test_counts_are_handed_on_in_small_batches():
    """A task's counts leave in batches of ``GIVEN_CODES`` at most, and a fold holds 8 MB of codes."""
    held = K.CodeCounts()
    codes = np.arange(1_300_000, dtype=np.int64)
    parts = [*held.add(codes), *held.add(codes[:5]), *held.finish()]
    assert max(len(c) for c, _ in parts) <= K.GIVEN_CODES and held.fold_bytes <= 8 << 20
    assert sum(int(n.sum()) for _, n in parts) == 1_300_005


def test_lookup_in_slices(spark, monkeypatch):
    """A batch is looked up some values at a time, nulls and empty lists at the cuts too."""
    from tessera.operators import tokens as TK
    table = pa.table({"key": pa.array([1, 2, 3]), "value": pa.array([10, 20, 30], pa.int32())})
    monkeypatch.setattr(TK, "_mapped", lambda name: table)
    monkeypatch.setattr(TK, "RUN_TOKENS", 4)
    lists = [[1, 2], None, [], [3, 9, 1, 1, 1, 1, 2], [2], [], None, [1, 2, 3], [3]]
    whole = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array([[1], *lists, [2]], pa.list_(pa.int64()))], names=["k", "x"])
    for batch in (whole, whole.slice(1, 9), whole.slice(0, 0)):
        out = list(TK._lookup_partition("t", 0, "x", "y", -1)([batch]))
        want = [{"k": r["k"], "y": None if r["x"] is None else [{1: 10, 2: 20, 3: 30}.get(v, -1) for v in r["x"]]} for r in batch.to_pylist()]
        assert [r for b in out for r in b.to_pylist()] == want
        assert len(out) > 1 or batch.num_rows == 0
