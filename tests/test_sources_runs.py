"""Sources/sinks round trips and run analytics on small written fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import runs as R
from tessera.sources.corpus import read_corpus, select_text, text_column
from tessera.sources.packed import (build_or_read, packed_name, read_packed, records_per_shard,
                                    require_split, write_packed)


def test_text_column_rule(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    with pytest.raises(TypeError):
        text_column(pages)
    conv = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert text_column(conv) == "text"
    firsts = spark.createDataFrame([("a", 1)], "body string, n int")
    assert text_column(firsts) == "body"
    assert select_text(firsts).columns == ["text"]


def test_read_text_corpus(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("line one\nline two\n")
    df = read_corpus(spark, str(p), "text")
    assert [r.text for r in df.collect()] == ["line one", "line two"]


def test_packed_publish_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, 0, [1, 2]), ("validation", 0, 0, [3, 4])],
                               "split string, batch_id long, block_no long, input_ids array<int>")
    root = str(tmp_path)
    assert write_packed(df, root, "wiki", 2, sample_run=True) is None
    path = write_packed(df, root, "wiki", 2)
    assert path.endswith(packed_name("wiki", 2)) and packed_name("wiki", 2) == "wiki-seq2-tokenized-grouped"
    val = read_packed(spark, root, "wiki", 2, "validation").collect()
    assert [r.input_ids for r in val] == [[3, 4]]
    require_split(read_packed(spark, root, "wiki", 2), "validation")
    with pytest.raises(ValueError):
        require_split(read_packed(spark, root, "wiki", 2), "test")
    calls = []
    again = build_or_read(spark, root, "wiki", 2, lambda: calls.append(1) or df)
    assert again.count() == 2 and calls == []
    assert records_per_shard(1024) > 1_000_000


def test_configs_and_diff(spark, tmp_path):
    base = {"run_name": "base", "model_type": "gpt2", "dataset": {"path": "wikitext", "name": "w103", "num_proc": 20},
            "validation_split_percentage": "1", "block_size": 1024, "learning_rate": 1e-4, "extra_key": 5}
    var = dict(base, run_name="var", model_type="duo-predict-gpt2", block_size=512)
    for c in (base, var):
        (tmp_path / f"{c['run_name']}.json").write_text(json.dumps(c, indent=2))
    cfgs = R.read_configs(spark, str(tmp_path / "*.json"))
    rows = {r.run_name: r for r in cfgs.collect()}
    assert rows["base"].validation_split_percentage == "1"
    assert rows["base"].dataset.num_proc == 20
    assert rows["base"].unknown_keys == ["extra_key"]
    diff = {(r.key, r.value, r.baseline) for r in R.config_diff(cfgs, "base").collect()}
    assert ("model_type", "duo-predict-gpt2", "gpt2") in diff
    assert ("block_size", "512", "1024") in diff
    assert not any(k == "learning_rate" for k, _, _ in diff)


def test_config_diff_takes_keys_outside_the_schema(spark, tmp_path):
    base = {"run_name": "base", "model_type": "gpt2", "dataset": {"path": "p", "name": "n"}, "learning_rate": 1e-4, "apply_drift": False}
    runs = [base, dict(base, run_name="drift", apply_drift=True), dict(base, run_name="more", rotatinghead="soft", dataset={"name": "n", "path": "p"}),
            {k: v for k, v in dict(base, run_name="less").items() if k != "apply_drift"},
            dict(base, run_name="data", dataset={"path": "p", "name": "n", "revision": "r"})]
    for c in runs:
        (tmp_path / f"{c['run_name']}.json").write_text(json.dumps(c))
    cfgs = R.read_configs(spark, str(tmp_path / "*.json"))
    diff = {(r.run_name, r.key, r.value, r.baseline) for r in R.config_diff(cfgs, "base").collect()}
    assert {d for d in diff if d[0] != "data"} == {("drift", "apply_drift", "true", "false"), ("more", "rotatinghead", "soft", None),
                                                   ("less", "apply_drift", None, "false")}
    assert [d[1] for d in diff if d[0] == "data"] == ["dataset"]


def test_parse_overrides(spark):
    df = spark.createDataFrame([("a=1,b=x",)], "s string")
    m = df.select(R.parse_overrides("s").alias("m")).collect()[0].m
    assert m == {"a": "1", "b": "x"}


def test_param_reports(spark):
    inv = spark.createDataFrame([("wte.weight", 100, True, "float32", 4), ("h.0.attn", 50, False, "float32", 4),
                                 ("h.0.mlp", 50, True, "bfloat16", 2), ("ln_f.weight", 10, False, "float32", 4)],
                                "name string, numel long, trainable boolean, dtype string, bytes_per_elem int")
    t = R.param_totals(inv).collect()[0]
    assert (t.all_params, t.trainable_params) == (210, 150)
    layers = {r.layer: (r.trainable, r.non_trainable, r.frozen) for r in R.param_layers(inv).collect()}
    assert layers == {"wte": (100, 0, False), "h": (50, 50, False), "ln_f": (0, 10, True)}
    d = {r.dtype: r.numel for r in R.param_dtypes(inv).collect()}
    assert d == {"float32": 160, "bfloat16": 50}


def test_resume_and_retain(spark):
    ck = spark.createDataFrame([("r", s, f"checkpoint-{s}") for s in (500, 1000, 1500)],
                               "run string, step int, path string")
    assert R.resume_point(ck).collect()[0].resume_from == "checkpoint-1500"
    assert R.resume_point(ck, "checkpoint-500").collect()[0].resume_from == "checkpoint-500"
    best = spark.createDataFrame([("r", 500)], "run string, best_step int")
    kept = sorted(r.step for r in R.retain_checkpoints(ck, 1, best).collect())
    assert kept == [500, 1500]


def test_metrics_sink(spark, tmp_path):
    from tessera.sources.packed import write_metrics
    df = spark.createDataFrame([(0.5, 1.2)], "accuracy double, loss double")
    write_metrics(df, str(tmp_path / "m"), "run1", "eval")
    back = spark.read.json(str(tmp_path / "m")).collect()[0]
    assert back.run == "run1" and back.phase == "eval" and back.accuracy == 0.5


def test_read_merges_file(spark, tmp_path):
    from tessera.operators.bpe import read_merges, segment_words
    p = tmp_path / "merges.txt"
    p.write_text("#version: 0.2\nl o\nlo w\ne r\n\n")
    m = read_merges(spark, str(p))
    assert [(r["rank"], r.left, r.right) for r in m.orderBy("rank").collect()] == \
        [(0, "l", "o"), (1, "lo", "w"), (2, "e", "r")]
    words = spark.createDataFrame([("lower",), ("low",), ("x",)], "word string")
    seg = {r.word: r.pieces for r in segment_words(words, m).collect()}
    assert seg == {"lower": ["low", "er"], "low": ["low"], "x": ["x"]}


def test_read_vocab_file(spark, tmp_path):
    import json

    import pytest

    from tessera.operators.tokens import add_specials, encode, read_vocab
    p = tmp_path / "vocab.json"
    words = {"<unk>": 0, "low": 1, " \u00e9\"\n": 2, "er": 7, "<|endoftext|>": 3}
    p.write_text(json.dumps(words))
    vocab = read_vocab(spark, str(p))
    assert {r.token: (r.token_id, r.freq, r.is_special) for r in vocab.collect()} == \
        {t: (i, 0, t in ("<unk>", "<|endoftext|>")) for t, i in words.items()}
    assert {r.token: r.token_id for r in add_specials(vocab).collect()} == {**words, "<|MASK|>": 8}
    rows = spark.createDataFrame([(1, ["low", "er", "none", " \u00e9\"\n"]), (2, [])], "doc_id long, tokens array<string>")
    assert {r.doc_id: r.input_ids for r in encode(rows, vocab, keep=["doc_id"]).collect()} == {1: [1, 7, 0, 2], 2: []}
    for text in ("", "[1]", '{"a": 1, "b": 1}', '{"a": null}'):
        p.write_text(text)
        with pytest.raises(ValueError):
            read_vocab(spark, str(p))


def test_many_configs_to_a_file(spark, tmp_path):
    """Configs of a table go to a few files, not one each, and are read whole, lines within them too."""
    import os

    from tessera.operators import runs as R
    from tessera.plans import registry as P
    rows = [(i, f"s{i}", i % 25, 0.0) for i in range(1, 501)] + [(None, "none", 3, 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(2).write.parquet(str(tmp_path / "supplier.parquet"))
    folder = P._supplier_configs(spark, str(tmp_path))
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("part-")]) <= 2
    got = {r["run_name"]: r["seed"] for r in R.read_configs(spark, folder, many=True).collect()}
    assert got == {None if k is None else f"run-{k}": n for k, _, n, _ in rows}
    (tmp_path / "two.json").write_text('{"run_name": "a",\n "seed": 1}\n\x1e{"run_name": "b",\r\n "seed": 2}\x1e')
    pairs = R.read_configs(spark, str(tmp_path / "two.json"), many=True).select("run_name", "seed").collect()
    assert sorted(map(tuple, pairs)) == [("a", 1), ("b", 2)]
