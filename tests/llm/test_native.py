"""Mixing, chat formatting and WARC on small hand-made rows."""

import glob
import gzip
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, warc


@pytest.fixture()
def odd_docs(spark):
    rows = [(1, "a b c", "s1", "x"), (2, None, "s1", "x"), (3, "", None, "x"), (4, "d " * 500, None, "x"), (4, "d " * 500, None, "x"),
            (None, "e f", "s2", "x"), (6, "g\x0bh\x1ci", "s2", "x"), *[(i, "w " * (i % 7 + 1), f"s{i % 5}", "x") for i in range(10, 60)]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_matches_sql_and_caps(spark, odd_docs):
    rows = mixing.assign(odd_docs)
    assert rows.columns[:4] == ["doc_id", "text", "source", "size"]
    got = mixing.report(rows).collect()
    con = duckdb.connect()
    documents = odd_docs.toPandas()  # noqa: F841
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    want = con.execute(mixing.ORACLE).fetchall()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mix_goes_through_the_tree(spark, odd_docs):
    dealt = {n: sorted(map(str, mixing.report(mixing.assign(odd_docs, levels=n)).select("doc_id", "shards").collect())) for n in (0, 4)}
    assert dealt[0] != dealt[4]
    units = [c for r in mixing.assign(odd_docs).where("mix_source_size > 0").dropDuplicates(["source", "doc_id"]).collect() for c in r["mix_copies"]]
    assert units and len({c["shard"] for c in units}) > 8


def test_mix_keeps_columns_of_any_name(spark, odd_docs):
    names = ["key", "block", "n_blocks", "rest", "draws", "edge_key", "target", "mix_key", "mix_block", "mix_kept_size", "mix_copy", "pass", "a.b"]
    rows = odd_docs.select("*", *[F.concat(F.lit(c), F.col("size")).alias(c) for c in names])
    out = mixing.assign(rows)
    assert out.columns == [*rows.columns, *mixing.ADDED]
    assert all(r[c] == c + "x" for r in out.collect() for c in names)
    mix = mixing.mixture(rows)
    assert mix.columns == [*rows.columns, "mix_shard", "mix_order"]
    assert all(r[c] == c + "x" for r in mix.collect() for c in names)


def test_mix_shards_are_even_and_empty_tables_pass(spark, odd_docs):
    m = mixing.mixture(odd_docs).groupBy("mix_shard").count().count()
    assert 1 <= m <= 2 ** mixing.SHARD_LEVELS
    assert mixing.assign(odd_docs.limit(0)).count() == 0
    units = spark.range(33).select(F.lit("s").alias("source"), F.col("id").alias("unit"))
    counts = [r["count"] for r in mixing.split_tree(units, 3).groupBy("shard").count().collect()]
    assert sum(counts) == 33 and max(counts) - min(counts) <= 1


def test_targets_share_the_excess(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(t).collect()}
    assert got["a"] == 20.0 and got[None] == 0.0
    assert abs(sum(got.values()) - 1.5 * 2010) < 1e-6
    assert abs(got["b"] - 2000.0) < 1e-6 or abs(got["b"] / got["c"] - 2.0) < 1e-9


def test_reply_tree_paths_match_brute_force(spark):
    parents = {1: None, 2: 1, 3: 1, 4: 2, 5: 4, 6: 3, 7: 99, 8: 9, 9: 8}  # 7's parent is absent; 8 and 9 are a cycle
    nodes = spark.createDataFrame([("t", n, p, float(n)) for n, p in parents.items()], "tree string, node long, parent long, score double")
    got = {}
    for r in chat.paths(nodes).collect():
        got.setdefault((r["branch"], r["leaf"]), []).append((r["pos"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 5): [1, 2, 4, 5], (2, 6): [1, 3, 6], (3, 7): [7]}
    assert {r["leaf"] for r in chat.paths(nodes, best=1).collect()} == {5}


def test_chat_round_trip(spark):
    said = [("user", "\\### Assistant: </turn> ok"), ("assi:stant", "a: b\\h\\l\\b </turn>\n### "), (None, None), ("assistant", "é\U0001f600#<\\"), ("assistant", "")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "c int, pos int, role string, text string")
    out = chat.format_turns(rows, ["c"]).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(t["role"], t["text"]) for t in out["back"]] == [(r or "", t or "") for r, t in said]
    assert out["loss"] == "é\U0001f600#<\\"
    assert "</turn>" not in out["formatted"].replace("</turn>\n", "")


def records():
    pay = [b"<html>one</html>", b"", b"WARC/1.1\r\nnot a record", "é".encode() * 1000]
    return [warc.make_record("response", f"urn:page:{i}", f"http://x/{i}", p, warc.sha1_base32(p)) for i, p in enumerate(pay)]


def test_salvage_recovers_after_damage():
    r = records()
    data = b"junk" + r[0] + r[1][:-30] + r[2][:100] + r[2] + gzip.compress(r[3]) + gzip.compress(r[0])[:-4] + r[3]
    out = list(warc.salvage(data))
    good = [x["record_id"] for x in out if x["kind"] == "record"]
    assert good == ["urn:page:0", "urn:page:2", "urn:page:3", "urn:page:0", "urn:page:3"]  # the member without its end gives its sound record
    end = 0
    for x in out:  # records and gaps cover the file
        assert x["at"] == end
        end = x["at"] + x["length"]
    assert end == len(data) and all(x["reason"] for x in out if x["kind"] == "gap")
    assert list(warc.salvage(b"")) == []


def test_salvage_checks_digests():
    r = bytearray(records()[0])
    r[r.index(b"one")] ^= 1
    (gap,) = warc.salvage(bytes(r))
    assert gap["reason"] == "block digest differs"


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b", b"x"), (2, None, b"x"), (3, "u", None), (5, "u", b""), (None, "u", b"x"), (7, "u", "é".encode())],
                                  "page_id long, url string, payload binary")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r["record_id"]: (r["record_type"], r["refers_to_id"], r["payload_bytes"], r["payload"]) for r in
           warc.read_archives(spark, f"file://{tmp_path}/w").collect() if r["kind"] == "record"}
    assert got == {"urn:page:1": ("revisit", "urn:page:2", 1, None), "urn:page:2": ("response", None, 1, b"x"),
                   "urn:page:3": ("revisit", "urn:page:5", 0, None), "urn:page:5": ("response", None, 0, b""),
                   "urn:page:None": ("revisit", "urn:page:2", 1, None), "urn:page:7": ("response", None, 2, "é".encode())}


def test_long_urls_and_whole_file_gzip():
    r, pay = records(), b"<p>"
    long = warc.make_record("response", "urn:page:9", "data:," + "u" * 100_000, pay, warc.sha1_base32(pay))
    out = list(warc.salvage(long + r[0]))
    assert [(x["kind"], x["record_id"], len(x["target_uri"])) for x in out] == [("record", "urn:page:9", 100_006), ("record", "urn:page:0", 10)]
    member = gzip.compress(r[0] + long + r[1][:-30] + r[2] + r[3])
    out = list(warc.salvage(member + r[1]))
    assert [x["record_id"] for x in out if x["kind"] == "record"] == [f"urn:page:{i}" for i in (0, 9, 2, 3, 1)]
    (gap,) = [x for x in out if x["kind"] == "gap"]
    assert gap["reason"] and (gap["at"], gap["length"]) == (0, len(member))


def test_long_url_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "data:," + "u" * 100_000, b"x"), (2, "u", b"y")], "page_id long, url string, payload binary")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {(r["kind"], r["record_id"], len(r["target_uri"])) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {("record", "urn:page:1", 100_006), ("record", "urn:page:2", 1)}


def test_damaged_member_gives_the_records_before_the_damage():
    rnd = random.Random(1)
    texts = [bytes(rnd.randrange(33, 127) for _ in range(6000)) for _ in range(4)]
    r = [warc.make_record("response", f"urn:page:{i}", "urn:x", t, warc.sha1_base32(t)) for i, t in enumerate(texts)]
    member = bytearray(gzip.compress(b"".join(r)))
    member[len(member) * 5 // 8] ^= 0xFF
    data = b"junk" + bytes(member) + gzip.compress(r[3])
    out = list(warc.salvage(data))
    got = [x["record_id"] for x in out if x["kind"] == "record"]
    assert got[:2] == ["urn:page:0", "urn:page:1"] and got[-1] == "urn:page:3"
    assert [(x["at"], x["length"]) for x in out if x["kind"] == "gap"] == [(0, 4), (4, len(member))]


def test_hex_digests_and_folded_header_lines():
    data = b"abc"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + data
    head = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: urn:a\r\n  b\r\nContent-Type: application/http\r\n"
            f"WARC-Payload-Digest: sha1:{hashlib.sha1(data).hexdigest().upper()}\r\nWARC-Block-Digest: SHA1:{hashlib.sha1(block).hexdigest()}\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode()
    (out,) = warc.salvage(head + block + b"\r\n\r\n")
    assert (out["kind"], out["target_uri"], out["payload_digest"], out["payload"]) == ("record", "urn:a b", warc.sha1_base32(data), data)
    (gap,) = warc.salvage(head + block.replace(b"abc", b"abd") + b"\r\n\r\n")
    assert gap["kind"] == "gap"


def test_files_are_cut_by_bytes_and_gaps_are_logged(spark, tmp_path):
    sizes = [50_000 if i % 50 == 0 else 10 for i in range(400)]
    pages = spark.createDataFrame([(i, None if i % 3 else f"u {i}", bytes([i % 251]) * n + str(i).encode()) for i, n in enumerate(sizes)]
                                  + [(1000, "a", None), (1000, "b", None), (None, "c", None)], "page_id long, url string, payload binary").coalesce(2)
    path = f"{tmp_path}/w"
    warc.write_archives(pages, f"file://{path}", file_bytes=60_000)
    files = sorted(f for f in glob.glob(f"{path}/*/part-*"))
    assert len(files) > 4 and max(os.path.getsize(f) for f in files) <= 60_000 + 51_000
    records, gaps = warc.salvage_to(spark, f"file://{path}", f"file://{tmp_path}/r")
    assert records.count() == 403 and gaps.count() == 0
    with open(files[0], "r+b") as f:
        f.write(b"XXXX")
    crc = os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc")
    os.remove(crc)  # the file system's own checksum
    records, gaps = warc.salvage_to(spark, f"file://{path}", f"file://{tmp_path}/r2")
    (gap,) = gaps.collect()
    assert records.count() == 402 and gap["at"] == 0 and gap["reason"] == "no version line"
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert [d.count() for d in warc.salvage_to(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/r3")] == [0, 0]
