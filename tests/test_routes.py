"""Both physical routes of a lookup, and the null, NaN and repeat rules."""

import math

import pytest
from pyspark.sql import Row

from tessera.operators import runs, tokens
from tessera.operators.rowindex import with_group_index
from tessera.sources import packed


def test_lookup_routes_agree_on_repeats_null_and_empty(spark):
    vocab = spark.createDataFrame([("<unk>", 0, True), ("a", 1, False), ("b", 2, False)], "token string, token_id int, is_special boolean")
    rows = spark.createDataFrame([(2, ["b"]), (2, ["a", "z"]), (2, ["b"]), (1, None), (1, [])], "k int, tokens array<string>")
    key = lambda df, c: sorted(((r["k"], r[c]) for r in df.collect()), key=repr)
    fast = tokens.encode(rows, vocab, keep=["k"])
    slow = tokens.encode(rows, vocab, keep=["k"], max_broadcast_entries=0)
    assert key(fast, "input_ids") == key(slow, "input_ids") == sorted([(2, [2]), (2, [1, 0]), (2, [2]), (1, None), (1, [])], key=repr)
    ids = fast.select("k", "input_ids")
    back = tokens.shuffle_lookup(ids, vocab, "token_id", "token", "input_ids", "tokens")
    assert key(back, "tokens") == key(tokens.decode(ids, vocab, vocab_bound=3), "tokens")


def test_group_index_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 5), ("x", 1), (None, 3), ("x", 2)], "g string, o int")
    got = sorted(((r["g"] or "", r["o"], r["step"]) for r in with_group_index(rows, "g", "o").collect()))
    assert got == [("", 3, 1), ("", 5, 2), ("x", 1, 1), ("x", 2, 2)]


@pytest.mark.parametrize("greater,want", [(True, (1, 2.0)), (False, (2, 1.0))])
def test_best_step_leaves_nan_and_null_out(spark, greater, want):
    log = spark.createDataFrame([("r", 0, "m", math.nan), ("r", 1, "m", 2.0), ("r", 2, "m", 1.0), ("r", 3, "m", None), ("n", 0, "m", math.nan)],
                                "run string, step int, metric string, value double")
    got = {r["run"]: (r["best_step"], r["best_value"]) for r in runs.best_step(log, "m", greater).collect()}
    assert got == {"r": want, "n": (None, None)}


def test_overrides_last_wins_and_unknown_raises(spark):
    df = spark.createDataFrame([Row(o="a=1,b=x=y,a=2,c")])
    assert df.select(runs.parse_overrides("o").alias("m")).first()["m"] == {"b": "x=y", "a": "2", "c": None}
    with pytest.raises(Exception, match="unknown override: b"):
        df.select(runs.parse_overrides("o", allowed=["a", "c"]).alias("m")).collect()


def test_metrics_rerun_replaces_its_phase(spark, tmp_path):
    df = spark.createDataFrame([(1.0,)], "loss double")
    for phase in ("eval", "train", "eval"):
        packed.write_metrics(df, str(tmp_path / "m"), "r", phase)
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_partial_counts_fold(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FOLD_BYTES", 1)
    import pyarrow as pa
    batches = [pa.RecordBatch.from_arrays([pa.array([["a", "b"], None, ["a"]])], names=["t"]) for _ in range(3)]
    got = {}
    for b in tokens._partial_counts(iter(batches)):
        for t, n in zip(*b.to_pydict().values(), strict=True):
            got[t] = got.get(t, 0) + n
    assert got == {"a": 6, "b": 3}


def test_resume_point_raises_on_files_without_a_checkpoint(spark):
    ck = spark.createDataFrame([("a", 5, "checkpoint-5"), ("a", 10, "checkpoint-10")], "run string, step int, path string")
    files = spark.createDataFrame([("a", "log"), ("b", "log"), ("b", "x")], "run string, file string")
    with pytest.raises(Exception, match="holds no checkpoint: b"):
        runs.resume_point(ck, outputs=files).collect()
    with pytest.raises(Exception, match="holds no checkpoint: b"):
        runs.resume_point(ck, "given", outputs=files).collect()
    got = {r["run"]: r["resume_from"] for r in runs.resume_point(ck, "given", outputs=files, overwrite=True).collect()}
    assert got == {"a": "given", "b": "given"}
    assert runs.resume_point(ck, outputs=files, overwrite=True).first()["resume_from"] is None
    assert runs.resume_point(ck, outputs=files.where("run = 'a'")).first()["resume_from"] == "checkpoint-10"


def test_overrides_conflict_with_config_name_and_model_path(spark):
    df = spark.createDataFrame([("a=1", None, None), (None, "c", "m")], "o string, c string, m string")
    whole = runs.parse_overrides("o", config_name="c", model_path="m")
    assert [r[0] for r in df.select(whole).collect()] == [{"a": "1"}, None]
    for row in (("a=1", "c", None), ("a=1", None, "m")):
        with pytest.raises(Exception, match="cannot be combined"):
            spark.createDataFrame([row], df.schema).select(whole).collect()


def test_retained_checkpoints_are_a_bounded_top_k(spark):
    rows = [(r, s, f"checkpoint-{s}") for r in ("a", "b", None) for s in range(1, 40)]
    ck = spark.createDataFrame(rows, "run string, step long, path string").repartition(4)
    best = spark.createDataFrame([("a", 3), ("b", 39), (None, 36)], "run string, best_step long")
    out = runs.retain_checkpoints(ck, 2, best)
    got = sorted(((r["run"] or "", r["step"], r["rank_newest"]) for r in out.collect()))
    assert got == [("", 36, 4), ("", 38, 2), ("", 39, 1), ("a", 3, 37), ("a", 38, 2), ("a", 39, 1), ("b", 38, 2), ("b", 39, 1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
