"""Line dedup, vector codes and collocations against plain versions on small hand-made rows."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import collocations as co
from tessera.llm import dualtree as dt
from tessera.llm import linededup as ld

LONG = "This line is certainly longer than forty code points"


def plain_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def line_rows():
    rows = [(i, f"{LONG}\nown {i}\n{LONG.upper()} \n") for i in range(1, 8)]  # a line twice in a document, in two cases
    rows += [(20, "\n".join([LONG] * 50)), (None, f"\t{LONG}"), (21, None), (22, ""), (23, "\n"), (24, "ü" * 39), (25, "ü" * 40)]
    rows += [(5, f"{LONG}\nown 5\n{LONG.upper()} \n"), (6, f"other text\n{LONG}")]  # repeated ids: equal and other text
    rows += [(30 + i, f"{LONG} É\r\n{'x' * 39}\nshort") for i in range(4)]  # four documents: too few
    rows += [(40 + i, "\n" + "a" * 40 + f"\n{i}") for i in range(5)] + [(50 + i % 4, "b" * 40) for i in range(9)]  # nine rows, four ids
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (8, 3)])
def test_lines_match_plain_version(spark, line_rows, batches, fanout):
    df = spark.createDataFrame(line_rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as line", "1 as n", "'y' as kept")
    out = ld.dedup_lines(df, batches=batches, fanout=fanout)
    assert out.columns == ["row", "n_lines", "n_dropped", "kept"] and out.schema["row"].dataType.names == df.columns
    got = sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=repr)
    assert got == plain_lines(line_rows)
    assert sum(x[2] for x in got) > 20


def test_lines_of_an_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled_and_disjoint(spark):
    runs = ld.LineRuns(spark, buckets=2, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, 0, 100 - b, 1) for k in range(b, b + 3)], "h1 long, h2 long, owner long, n long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    keys = [r["h1"] for name in runs.runs for r in spark.table(name).collect()]
    assert sorted(keys) == list(range(7))
    assert sorted((r["h1"], r["owner"]) for r in runs.repeated(3).collect()) == [(2, 100), (3, 99), (4, 98)]
    join = spark.table(runs.runs[0]).join(spark.table(runs.runs[1]).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    assert "Exchange" not in join._jdf.queryExecution().executedPlan().toString()
    runs.drop()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not kept:
        return []
    width = max(parts, -(-max(len(r[1]) for r in kept) // parts) * parts)
    vec = lambda r: [math.floor(Fraction(c) * 1024) for c in r[1]] + [0] * (width - len(r[1]))
    w = width // parts
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[vec(r)[p * w:(p + 1) * w] for r in ordered[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    cut = [[vec(r)[p * w:(p + 1) * w] for p in range(parts)] for r in kept]
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = defaultdict(list)
            for x in cut:
                of[best(p, x[p])[1]].append(x[p])
            new.append([[sum(c) // len(of[j]) for c in zip(*of[j])] if j in of else e for j, e in enumerate(books[p])])
        books = new
    out = []
    for r, x in zip(kept, cut):
        near = [best(p, x[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near)))
    return sorted(out, key=repr), ",".join(str(c) for b in books for e in b for c in e)


def odd_vectors(n=400, d=10, big=1.0):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) * big for v in rng.normal(size=d).astype("float32") * (0.05 if i % 3 else 1)], i % 4) for i in range(n)]
    rows += [(1000 + i, rows[5][1], None) for i in range(60)]  # copies, null labels
    rows += [(5, rows[6][1], 1), (None, rows[7][1], 1), (None, [0.0] * d, 2), (2000, None, 1), (2001, [1.0, None] * (d // 2), 1),
             (2002, [float("nan")] * d, 1), (2003, [float("inf")] * d, 1), (2004, [0.5, 0.25], 3), (2005, [], 3)]
    return rows


@pytest.mark.parametrize("entries,rounds,big", [(256, 4, 1.0), (16, 2, 1.0), (12, 2, 1e12), (12, 1, 1e18)])
def test_codes_match_plain_version(spark, monkeypatch, entries, rounds, big):
    monkeypatch.setattr(dt, "LEAF", 8)
    rows = odd_vectors(400 if big == 1.0 else 60, big=big)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as code", "2 as error").repartition(3)
    out, books = dt.encode_vectors(df, entries=entries, rounds=rounds)
    got = sorted(((r["row"]["vec_id"], r["code"], r["error"]) for r in out.collect()), key=repr)
    want, text = plain_codes(rows, entries=entries, rounds=rounds)
    assert got == sorted([(i, c, e if e < 1 << 63 else None) for i, c, e in want], key=repr)
    assert dt.books_text(books) == text
    assert out.schema["row"].dataType.names == df.columns


def test_codes_of_an_empty_table(spark):
    out, books = dt.encode_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert out.count() == 0 and books == []


def test_dual_tree_assigns_like_brute_force_and_whole_nodes():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, size=(20, 3))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-3, 4, size=(3000, 3))).astype(float)
    entries = np.concatenate([centres, centres[:5]]).astype(float)  # equal entries: the lower number wins
    tree, own, whole = dt.Tree(x, 16), np.full(3000, -1), 0

    def visit(at, entry):
        nonlocal whole
        whole += isinstance(entry, int) and tree.bounds[at][1] - tree.bounds[at][0]
        own[slice(*tree.bounds[at]) if isinstance(entry, int) else at] = entry

    dt.assign(tree, dt.book_tree(entries), visit)
    want = np.argmin(((tree.x[:, None, :] - entries[None]) ** 2).sum(2), axis=1)
    assert (own == want).all() and whole > 1000


def test_op12_matches_sql(spark, tmp_path):
    df = spark.createDataFrame([r for r in odd_vectors() if r[1] is None or len(r[1]) == 10][:-3], "vec_id long, embedding array<float>, label int")
    df = df.where("size(embedding) = 10 or embedding is null").selectExpr("vec_id", "slice(embedding, 1, 8) as embedding", "label")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, dt.op12_codes(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(dt.ORACLE).fetchall(), key=repr)
    sha = {r[4] for r in got}
    assert len(sha) == 1 and len(sha.pop()) == len(hashlib.sha256().hexdigest())


def plain_phrases(rows, min_count, max_words, top):
    f, n = defaultdict(Counter), Counter()
    cut = {ord(c): "\n" for c in ".,;:!?\n\x0b\x0c\r"}
    for text, lang in rows:
        lang = lang or "und"
        for piece in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(cut).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= min_count and len(p) > 1}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        rows = []
        for p, a in often.items():
            if p in inside:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = np.random.default_rng(5)
    words = ["New", "york", "City", "the", "é b", "x\x1cy", "ÀB", "of", "a", "a"]
    rows = [(" ".join(words[i] for i in rng.integers(0, 10, 30)) + ["", ". New York", "\tthe, a!"][j % 3], ["en", "de", None, "und"][j % 4]) for j in range(120)]
    return rows + [(None, "en"), ("", None), (" .. ", "fr"), ("a " * 3000, "de"), ("rare words only", "es")] + [("New York City hall\n", "en")] * 40


@pytest.mark.parametrize("max_table,tile_pairs", [(1_000_000, 1), (1_000_000, 1 << 30), (0, 1 << 30)])
def test_phrases_match_plain_version(spark, phrase_rows, monkeypatch, max_table, tile_pairs):
    monkeypatch.setattr(co, "DENSE_PAIRS", tile_pairs)
    df = spark.createDataFrame(phrase_rows, "text string, lang string").selectExpr("*", "1 as n", "'x' as phrase", "2 as id").repartition(3)
    got = sorted(map(tuple, co.collocations(df, min_count=12, top=40, max_table=max_table).collect()))
    assert got == plain_phrases(phrase_rows, 12, 5, 40) and len(got) > 60


def test_phrases_of_an_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(co, "TILE", 8)
    monkeypatch.setattr(co, "DENSE_PAIRS", 20)
    monkeypatch.setattr(co, "PAIR_BUFFER", 300)
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.08, 2000) - 1, 60).astype(np.int32)
    ids[::17] = -1
    codes = co.pair_codes(ids)
    tiles, got = co.Tiles(), Counter()
    parts = [p for i in range(0, len(codes), 100) for p in tiles.add(codes[i:i + 100])]
    for c, n in [*parts, *tiles.fold(), *tiles.cells()]:
        got.update(dict(zip(c.tolist(), n.tolist())))
    assert got == Counter(codes.tolist())


def test_a_fold_keeps_few_dense_tiles(monkeypatch):
    monkeypatch.setattr(co, "TILE", 8)
    monkeypatch.setattr(co, "DENSE_PAIRS", 20)
    codes = np.repeat([co.pair_codes(np.array([8 * i + 1, 8 * i + 2], np.int32))[0] for i in range(40)], 30)
    tiles, got, most = co.Tiles(), Counter(), 0
    list(tiles.add(codes))
    for part in (tiles.fold(), tiles.cells()):  # one fold of forty full tiles
        for c, n in part:
            most = max(most, len(tiles.dense))
            got.update(dict(zip(c.tolist(), n.tolist())))
        most = max(most, len(tiles.dense))
    assert got == Counter(codes.tolist()) and most <= co.DENSE_TILES


def test_tiled_codes_come_back():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 1 << 31, 500), [0, (1 << 31) - 1, (1 << 31) - 1, 0, 0]]).astype(np.int32)
    codes = co.pair_codes(ids)
    assert (co.untiled(co.tiled(codes)) == codes).all() and (co.tiled(codes) >= 0).all()


def test_distinct_lookups_of_a_row_equal_the_table(spark, phrase_rows, monkeypatch):
    """A join meets a row's distinct words alone, and both ways give the same neighbours."""
    import pyarrow as pa
    monkeypatch.setattr(co, "STREAM", 200)
    docs = spark.createDataFrame(phrase_rows, "text string, lang string").where("lang is not null").select("lang", "text").coalesce(1)
    ids = co.numbered(docs.mapInArrow(co._word_counts, "lang string, word string, n long").groupBy("lang", "word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").where("n >= 12"), "word")

    def pairs(streams):
        out = defaultdict(Counter)
        for r in streams.collect():
            out[r["lang"]].update(co.pair_codes(np.frombuffer(r["ids"], np.int32)).tolist())
        return {k: v for k, v in out.items() if v}

    table, joined = (pairs(co.word_streams(docs, ids, n)) for n in (1000, 0))
    assert table == joined and len(table) == 3
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": t} for t in ["a b a a"] * 9 + ["c. a", None]])
    rows = list(co._local_words([batch]))
    assert len(rows) == 1 and rows[0].column("keys").to_pylist() == [["a", "b", "c"]]
    known = pa.RecordBatch.from_pydict({"lang": ["en"], "ids": rows[0].column("ids"), "found": [[0 << 32 | 7, 1 << 32 | 9]]})
    ids = np.frombuffer(next(co._renumbered([known])).column("ids")[0].as_py(), np.int32)
    assert ids.tolist() == [7, 9, 7, 7, -1] * 9


def test_op11_hands_small_batches_to_python(spark, tmp_path):
    spark.createDataFrame([("a b", "en")], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        assert co.op11_phrases(spark, str(tmp_path)).count() == 0
        assert int(spark.conf.get(name).rstrip("b")) <= 8 << 20
    finally:
        spark.conf.set(name, old)
