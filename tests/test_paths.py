"""The fast and the general physical routes agree; plan shapes stay as designed."""

from pyspark.sql import functions as F

from tessera.functions.text import pretokenize
from tessera.operators import blocks as B
from tessera.operators import model as N
from tessera.operators import tokens as TK
from tessera.operators.rowindex import with_row_index

ROWS = [(0, [5, 6, 7, 5, 6]), (1, []), (2, [9]), (3, [5, 6, 5, 6, 5]), (4, [1, 2]), (5, [7, 7, 7])]


def _blocks(spark, parts=3):
    return spark.createDataFrame(ROWS, "k long, input_ids array<int>").repartition(parts)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x or 0) for x in t))


def test_pair_counts_arrow_equals_explode(spark):
    b = _blocks(spark)
    fast = N.fit_next_token(b, id_bound=16)
    slow = N.fit_next_token(b)
    assert _rows(fast.select("prev_id", "next_id", "n")) == _rows(slow.select("prev_id", "next_id", "n"))


def test_infill_counts_arrow_equals_explode(spark):
    b = _blocks(spark)
    fast = N.infill_counts(b, id_bound=16)
    slow = N.infill_counts(b)
    cols = ["left", "right", "target", "n"]
    assert _rows(fast.select(*cols)) == _rows(slow.select(*cols))
    assert (None, 6, 5, 2) in _rows(fast.select(*cols))  # row starts: no left neighbour


def test_token_counts_arrow_equals_explode(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (["b", "c"],), (None,)], "tokens array<string>")
    a = _rows(TK.token_counts(df))
    b = _rows(TK.token_counts(df, arrow_combine=False))
    assert a == b == [("a", 2), ("b", 2), ("c", 1)]


def test_encode_broadcast_equals_shuffle(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "the dog"), (2, ""), (3, "zebra the")],
                                 "doc_id long, text string")
    toks = docs.select("doc_id", pretokenize("text").alias("tokens"))
    vocab = TK.build_vocab(toks.filter("doc_id < 2"), size=3)
    fast = TK.encode(toks, vocab, keep=["doc_id"], vocab_bound=10)
    slow = TK.encode(toks, vocab, keep=["doc_id"], max_broadcast_entries=0)
    a = {r.doc_id: r.input_ids for r in fast.collect()}
    b = {r.doc_id: r.input_ids for r in slow.collect()}
    assert a == b and a[2] == []
    unk = {r.token: r.token_id for r in vocab.collect()}["<unk>"]
    assert a[3][0] == unk  # "zebra" is unknown


def test_decode_roundtrip(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, "c c")], "doc_id long, text string")
    toks = docs.select("doc_id", pretokenize("text").alias("tokens"))
    vocab = TK.build_vocab(toks)
    enc = TK.encode(toks, vocab, keep=["doc_id"])
    dec = {r.doc_id: "".join(r.tokens) for r in TK.decode(enc, vocab).collect()}
    assert dec == {0: "a b a c", 1: "c c"}


def test_unbounded_vocab_ids_follow_frequency(spark):
    toks = spark.createDataFrame([(["x", "y", "y", "z", "z", "z"],)], "tokens array<string>")
    v = {r.token: r.token_id for r in TK.build_vocab(toks).collect()}
    assert (v["z"], v["y"], v["x"]) == (0, 1, 2) and v["<unk>"] == 3 and v["<|endoftext|>"] == 4
    m = {r.token: r.token_id for r in TK.add_specials(TK.build_vocab(toks), bounded=False).collect()}
    assert m["<|MASK|>"] == 5


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_encode_has_no_exchange(spark):
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    toks = docs.select("doc_id", pretokenize("text").alias("tokens"))
    vocab = TK.build_vocab(toks, size=10)
    enc = TK.encode(toks, vocab, keep=["doc_id"], vocab_bound=12)
    assert "Exchange" not in _plan(enc)


def test_pack_shuffles_once(spark):
    df = spark.createDataFrame([(i, list(range(i % 5))) for i in range(40)], "doc long, input_ids array<int>")
    ix = with_row_index(df, "doc", "idx")
    plan = _plan(B.pack_blocks(ix, 4, 10, cols=("input_ids",)))
    # token arrays move once: the window's exchange on batch_id is reused by the
    # block groupBy; the only other hash exchange is the per-partition count table
    assert plan.count("Exchange hashpartitioning(batch_id") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Exchange hashpartitioning(__pid" in plan


def test_read_packed_prunes_split_partitions(spark, tmp_path):
    from tessera.sources.packed import read_packed, write_packed
    df = spark.createDataFrame([("train", 0, 0, [1, 2]), ("validation", 0, 0, [3, 4])],
                               "split string, batch_id long, block_no long, input_ids array<int>")
    write_packed(df, str(tmp_path), "c", 2)
    plan = _plan(read_packed(spark, str(tmp_path), "c", 2, "validation"))
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan and "= validation)" in plan


def test_corpus_scan_reads_only_needed_columns(spark):
    from tessera.plans.registry import QUERIES
    plan = _plan(QUERIES["pretokenize"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_json_corpus_with_schema(spark, tmp_path):
    from tessera.sources.corpus import read_corpus, select_text
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": 1, "text": "a b"}\n{"id": 2, "text": "c"}\n')
    df = select_text(read_corpus(spark, str(p), "json", schema="id long, text string"), keep=["id"])
    assert [(r.id, r.text) for r in df.orderBy("id").collect()] == [(1, "a b"), (2, "c")]


def test_queries_run_from_another_directory(tmp_path):
    """Workers import the package shipped with addPyFile, not from the cwd."""
    import subprocess
    import sys
    import textwrap
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys; sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__ as E
        print("ROWS", E.queries()["encode_docs"](s, "/root/testdata/sf0.001").count())
    """)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]


def test_corpus_index_holds_no_text_and_blocks_prune(spark):
    from tessera.plans.corpus import CorpusPlan
    cp = CorpusPlan(spark, "/root/testdata/sf0.001")
    plan = _plan(cp.packed_ids)
    moved = [line for line in plan.splitlines() if "Exchange" in line or "ExistingRDD" in line]
    assert moved and not any("text" in line for line in moved)
    blocks = _plan(cp.blocks("validation").select("input_ids"))
    assert "PartitionFilters: [isnotnull(split" in blocks and "ReadSchema: struct<input_ids:array<int>>" in blocks


def test_pack_whole_equals_one_batch(spark):
    lists = [[], [1, 2, 3], None, [4], [5, 6, 7, 8, 9], [10]]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, input_ids array<int>").repartition(3)
    for bs, want in ((4, [[1, 2, 3, 4], [5, 6, 7, 8]]), (64, [list(range(1, 11))])):
        got = [r.input_ids for r in B.pack_whole(df, bs, "k").orderBy("block_no").collect()]
        assert got == want
    assert B.pack_whole(df.limit(0), 4, "k").count() == 0
