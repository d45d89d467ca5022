"""Repeated and null keys, large slices, epoch permutations and the unbounded vocabulary."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import rowindex as L
from tessera.operators import tokens as TK
from tessera.plans.corpus import CorpusPlan, CorpusSpec

SPEC = CorpusSpec(validation_percent=30, vocab_size=64, block_size=4, batch_rows=5)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return CorpusPlan(spark, str(tmp_path), SPEC)


@pytest.mark.parametrize("border", [0, 1, 2])
def test_corpus_with_repeated_and_null_keys_keeps_every_token(spark, tmp_path, border):
    rows = [(1, "a b c")] * 7 + [(1, "d e")] * 2 + [(None, "f g h")] * (2 + border) + [(None, "i")] + [(i, f"a j{i} k") for i in range(5, 12)] + [(5, None), (5, "")]
    cp = corpus(spark, tmp_path, rows)
    n = len(rows)
    cut = round(n * 0.3)
    split = cp.split.collect()
    assert sorted(r["idx"] for r in split) == list(range(n))
    assert sum(r["split"] == "validation" for r in split) == cut
    tokens = cp.tokens.select("split", F.size("tokens").alias("n")).collect()
    assert sum(r["split"] == "validation" for r in tokens) == cut and len(tokens) == n
    encoded = sum(r["n"] for r in cp.encoded.select(F.size("input_ids").alias("n")).collect() if (r["n"] or 0) > 0)
    ids = cp.encoded.select("split", "input_ids").collect()
    indexed = cp._copies(L.same_rows(cp.encoded.select(*cp.ident, "input_ids").groupBy(*cp.ident).agg(F.first("input_ids").alias("input_ids")), cp.index, cp.ident))
    assert sum(len(r["input_ids"] or []) for r in indexed.collect()) == encoded == sum(len(r["input_ids"] or []) for r in ids)
    # batches of whole rows: what is packed is each batch's tokens less its tail
    per = {}
    for r in indexed.collect():
        per[r["split"], r["split_idx"] // 5] = per.get((r["split"], r["split_idx"] // 5), 0) + len(r["input_ids"] or [])
    packed = sum(len(r["input_ids"]) for r in cp.packed_ids.collect())
    assert packed == sum(t if t < 4 else t - t % 4 for t in per.values())
    train = cp.train_tokens.select(F.size("tokens").alias("n")).collect()
    assert len(train) == n - cut


def test_corpus_without_training_rows(spark, tmp_path):
    cp = CorpusPlan(spark, str(tmp_path), CorpusSpec(validation_percent=100))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["split"] for r in cp.tokens.collect()} == {"validation"} and cp.train_tokens.count() == 0


def test_pack_whole_keeps_repeated_rows(spark):
    rows = [(1, [1, 2, 3])] * 3 + [(1, [4])] + [(None, [5, 6])] * 2 + [(2, None), (2, []), (3, [7, 8])]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>").repartition(4)
    got = B.pack_whole(df, 5, "k").orderBy("block_no").collect()
    flat = [x for r in got for x in r["input_ids"]]
    assert len(flat) == 15 and flat[:4] == [5, 6, 5, 6] and [len(r["input_ids"]) for r in got] == [5, 5, 5]
    assert sorted(B.pack_whole(df, 100, "k").first()["input_ids"]) == sorted(x for _, ids in rows for x in ids or [])


@pytest.mark.parametrize("n", [1, 40, 333, 700, 999, 1000, 5000])
def test_large_slices_are_filters(spark, monkeypatch, n):
    monkeypatch.setattr(L, "TAKE_ROWS", 30)
    monkeypatch.setattr(L, "CUTS", 5)
    monkeypatch.setattr(L, "CUT_SAMPLE", 40)
    rnd = random.Random(n)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.randrange(50), i) for i in range(600)] + [("b", 7, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(4)
    out = L.slice_rows(df, ["g", "o"], n)
    got = [tuple(r) for r in out.collect()]
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    want = sorted(rows, key=key)
    assert sorted(map(key, got)) == sorted(map(key, want[:n]))
    border = key(want[min(n, 1000) - 1])
    assert n <= 30 or sorted((r for r in got if key(r) < border), key=repr) == sorted((r for r in rows if key(r) < border), key=repr)
    assert all(got.count(r) <= rows.count(r) for r in set(got))
    if n > 30:
        assert "TakeOrdered" not in _plan(out)


def test_slice_filter_reaches_the_scan(spark, monkeypatch):
    monkeypatch.setattr(L, "TAKE_ROWS", 1000)
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey")
    plan = _plan(L.slice_rows(orders, "o_orderkey", 5000))
    assert "LessThanOrEqual(o_orderkey" in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 143, 1000])
def test_epoch_permutation_is_bijective_and_keyed(spark, n):
    ix = spark.range(n).withColumnRenamed("id", "idx")
    places = lambda seed, epoch: [r["place"] for r in L.epoch_batches(ix, n, seed, epoch, 8).orderBy("idx").collect()]
    first = places(1, 0)
    assert sorted(first) == list(range(n)) and first == places(1, 0)
    if n > 100:
        assert first != places(1, 1) and first != places(2, 0)
    assert "Exchange" not in _plan(L.epoch_batches(ix, n, 1, 0, 8))


def test_unbounded_vocabulary_has_no_single_partition_of_tokens(spark):
    toks = spark.createDataFrame([(["x", "y", "y", "<unk>", "z"],), (None,)], "tokens array<string>")
    vocab = TK.build_vocab(toks)
    got = {r["token"]: (r["token_id"], r["is_special"]) for r in vocab.collect()}
    assert got["y"] == (0, False) and got["<unk>"][1] is False and got["<|endoftext|>"] == (4, True)
    lines = _plan(vocab).splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "SinglePartition" in x]
    assert all("HashAggregate(keys=[__pid" in x for x in below)  # the offsets: a row a partition
