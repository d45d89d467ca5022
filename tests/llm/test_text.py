"""Text operators against brute force, the library, or held-out labels."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ann, bytebpe, cotrain, dac, imatch, jaccard, langid, transducer
from tessera.llm.components import components

TRICKY = ["", "  ", "It's a TEST'S don't", "x" * 3000, "日本語 ２ ½ é ΑΣ. İ ﬁ ß \x1c a\U0001f600‍\U0001f469", "<|endoftext|>a b</w>c <|startoftext|>", "�\u0000a", "!!!'s'S''ll \n\n  x"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, size string"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang and lang[i], "s", 0, "x", "y") for i, t in enumerate(texts)], DOCS)


def library(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bytebpe.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_transducer_equals_library():
    lib, own = library("word_bpe_49k.json"), transducer.load(bytebpe.vocabulary("word_bpe_49k.json"))
    rnd = random.Random(3)
    texts = TRICKY + ["".join(rnd.choice("abcdeinthrso'é-. 1日Σ\n") for _ in range(rnd.randrange(400))) for _ in range(200)]
    texts += ["".join(rnd.choice("inthaes") for _ in range(2500)) for _ in range(5)]  # longer than the window
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t).tolist()
        d = transducer.Decoder(own)
        assert got == want
        assert d.feed(got[:5]) + d.feed(got[5:]) + d.finish() == lib.decode(want, skip_special_tokens=False)


def test_byte_bpe_equals_library():
    lib, own = library("byte_bpe_50k.json"), bytebpe.ByteBpe(bytebpe.vocabulary("byte_bpe_50k.json"))
    for t in TRICKY + ["a  b\t\tc d_e f1²", "naïve café"]:
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encode_documents_null_and_clashing(spark):
    df = docs(spark, ["hello world", None, ""]).withColumnRenamed("size", "ids")
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in transducer.encode_documents(df, bytebpe.vocabulary("word_bpe_49k.json")).collect()}
    assert got[1] == got[2] == ([], "") and got[0][1] == "hello</w> world</w>"


def test_codes_give_random_access():
    rnd = np.random.default_rng(0)
    ids = np.concatenate([rnd.integers(0, 70000, 3000), rnd.integers(0, 255, 2000), [2 ** 31, 0]]).astype("u4")
    s = dac.Segment(dac.pack(ids, [5, None, 9], [2000, 0, len(ids) - 2000], 3, 1))
    assert s.doc_ids == [5, None, 9] and len(s.document(1)) == 0
    assert [s.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (17, 18), (1000, 3333), (len(ids), len(ids))):
        assert (s.slice(a, b) == ids[a:b]).all()


def test_token_files(spark, tmp_path):
    texts = [*TRICKY, None, "same", "same", "z " * 5000]
    dac.write_tokens(docs(spark, texts), f"file://{tmp_path}/t", bytebpe.vocabulary("byte_bpe_50k.json"), n_ranges=3)
    lib, start = library("byte_bpe_50k.json"), 0
    got = {r["doc_id"]: r for r in dac.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], list(got[i]["ids"])) == (start, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_ordered_neighbours(spark):
    texts = [f"t{i}" * (i % 5) for i in range(40)] + [None]
    df = docs(spark, texts).select("doc_id", "text")
    rows = imatch.with_next(df, 7).rdd.glom().collect()
    seen = {}
    for part in rows:
        for a, b in itertools.pairwise(part):
            if not a["guest"]:
                seen[a["doc_id"]] = b["doc_id"]
    assert seen == {i: (i - 1) % 41 for i in range(41)}
    assert imatch.with_next(df.limit(0), 3).count() == 0


def test_fingerprints():
    make = imatch.Fingerprinter(np.sort(np.array([imatch.term_hash(w) for w in ("alpha", "beta", "gamma", "delta")], "u8")))
    a, b = make("Alpha beta gamma rare"), make("gamma, BETA alpha other")
    assert a == b and imatch.likeness(a, b) == 1.0  # the same lexicon terms
    assert imatch.likeness(a, make("alpha beta delta gamma")) < 1
    assert make("") == make(None) and make("!!") != make("??") and imatch.likeness(make("one two three four"), make("five six seven eight")) == 0


def brute_links(texts):
    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else ({t} if t and not t.isspace() else set())
    sets = [grams(t) for t in texts]
    return {(i, j) for i, j in itertools.permutations(range(len(texts)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [1024, 6])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = [" ".join(base)] * 5 + [None, "", " ", "a b", "A b", "!!", "!!"]
    for _ in range(25):
        t = list(base)
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(20)]
    want = brute_links(texts)
    got = {r["doc_id"]: r for r in jaccard.join_similar(docs(spark, texts)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(a == i for a, _ in want) for i in range(len(texts))}
    low = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(low))
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i, c in enumerate(low) if i == c}


def test_jaccard_join_on_repeated_ids(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    a = [rnd.choice(words) for _ in range(80)]
    b, other = a[:-1] + ["changed"], [rnd.choice(words) for _ in range(80)]
    a, b, other, long = " ".join(a), " ".join(b), " ".join(other), "\t" + "z " * 60_000
    rows = [(1, a), (1, a), (2, b), (3, b), (3, other), (3, None), (4, other), (4, other), (5, long), (5, "alone"), (6, long), (7, ""), (7, None), (None, a), (None, None), (8, "x")]
    frame = spark.createDataFrame([(i, t, "g", "h") for i, t in rows], "doc_id long, text string, gone_id string, id string")
    items = sorted({(i, t) for i, t in rows if i is not None and t}, key=str)
    pairs = {(items[x], items[y]) for x, y in brute_links([t for _, t in items])}
    low = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for (i, _), (j, _) in pairs:
            low[i] = low[j] = min(low[i], low[j])
    want = [(i, low.get(i), sum(p == (i, t) for p, _ in pairs)) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in jaccard.join_similar(frame).collect())
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [
        (1, a), (5, long if long < "alone" else "alone"), (7, None), (None, a), (None, None), (8, "x")]))
    assert jaccard.join_similar(frame.limit(0)).count() == 0 and jaccard.keep_one(frame.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9995, 160)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= 160


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (95, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ngrams_match_plain_python():
    texts = ["Añb 1c", "", None, "x", "12", "ab"]
    _, owner = langid.ngrams(texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        want = sum(max(0, len(f" {w} ") - n + 1) for w in words for n in langid.SIZES)
        assert (owner == i).sum() == want


def test_language_id(spark):
    rnd = random.Random(2)
    make = {"aa": "ka ko ki ke ta to".split(), "bb": "zu zi zo pu pi po".split()}
    langs = [rnd.choice(["aa", "bb"]) for _ in range(300)]
    texts = ["".join(rnd.choice(make[x]) + rnd.choice(["", " "]) for _ in range(60)) for x in langs]
    df = docs(spark, [*texts, None, "12 !"], [*langs, None, None])
    filters = langid.learn(df)
    assert sorted(filters.languages) == ["aa", "bb"] and (filters.false_positive < 0.01).all()
    pred, score = filters.predict([*texts, None, "12 !"])
    assert np.mean([a == b for a, b in zip(pred, langs, strict=False)]) > 0.99
    assert pred[-2:] == ["und", "und"] and ((score >= 0) & (score <= 1)).all()
    assert langid.keep_known(df).columns == df.columns
    assert langid.learn(df.limit(0)).predict(["a"])[0] == ["und"]


def test_learned_sets_masks_and_coverage(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([0, 3, 80]))) for _ in range(60)]
    langs = [rnd.choice(["x", "x", "y", "z", None]) for _ in texts]
    filters = langid.learn(docs(spark, [*texts, None, "zz " * 40_000], [*langs, "x", "x"]))
    count = {}
    for t, x in zip([*texts, "zz " * 40_000], [*langs, "x"], strict=True):
        for g in langid.ngrams([t])[0].tolist() if x else ():
            count.setdefault(x, Counter())[g] += 1
    total = {x: sum(c.values()) for x, c in count.items()}
    assert filters.languages == sorted(total, key=lambda x: (-total[x], x))
    share = {x: {g: n / total[x] for g, n in c.items()} for x, c in count.items()}
    mean = {g: sum(share[x].get(g, 0) for x in share) / len(share) for c in count.values() for g in c}
    kept = {x: {g for g, s in share[x].items() if s >= langid.MIN_SHARE and s >= langid.MIN_PART * mean[g] * (1 - 1e-12)} for x in share}
    for i, x in enumerate(filters.languages):
        grams = np.array(sorted(mean), "u8")
        has = filters.bits(filters.masks(grams), i).astype(bool)
        assert kept[x] <= set(grams[has].tolist()) and has.sum() - len(kept[x]) <= 2  # a filter has no false negative
        assert abs(filters.coverage[i] - sum(n for g, n in count[x].items() if g in kept[x] and n > 1) / total[x]) < 1e-9


def test_co_training(spark):
    rnd = random.Random(4)
    texts, y = [], []
    for i in range(300):
        good = i % 4 > 0
        words = ["".join(rnd.choice("abcde") for _ in range(4)) for _ in range(40)]
        texts.append(" ".join(words) if good else " ".join(w.upper() + "!!" for w in words))
        y.append(int(good))
    df = docs(spark, [*texts, None, ""], ["en"] * 302)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 3] + [(1, y[1]), (None, 1), (3, None)], "doc_id long, quality int")
    model = cotrain.fit(df, labels)
    q, c, p = model.score(texts, ["en"] * 300, ["s"] * 300)
    assert np.mean((q >= 0.5) == np.array(y, bool)) > 0.98 and ((q >= 0) & (q <= 1)).all()
    kept = cotrain.keep_good(df, labels)
    assert kept.columns == df.columns and not {300, 301} & {r["doc_id"] for r in kept.collect()}
    assert cotrain.fit(df, labels.limit(0)).score(["a", None], ["en"] * 2, ["s"] * 2)[0].tolist() == [0.5, 0.0]


def test_views_hand_over_the_surest_of_all_rows(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcXYZ 19!\n") for _ in range(rnd.choice([1, 5, 30, 200]))) for _ in range(400)]
    texts = [*texts, *[texts[7]] * 150, *texts[:40], None, "", "w " * 30_000]  # a hot text, repeats, empty and long ones
    df = docs(spark, texts, ["en"] * len(texts)).repartition(5)
    rows = df.select(cotrain.F.xxhash64("text", "lang", "source").alias("key"), "text", "lang", "source")
    made = [(r["key"], (r["text"], r["lang"], r["source"])) for r in rows.collect()]
    views = [x.astype("f2").astype("f4") for x in cotrain.features(*[list(c) for c in zip(*[m[1] for m in made], strict=True)])]
    rows = cotrain.feature_rows(rows, "key long")
    g = np.random.default_rng(3)
    models = []
    for x in views:
        models.append(cotrain.Logistic.on(x))
        models[-1].w = g.normal(0, 3, x.shape[1]).astype("f4")
    given = [np.array([made[7][0], made[30][0]]), np.zeros(0, "i8")]
    quota = (9, 25)
    got = cotrain.surest_rows(rows, models, given, quota)
    for k, (keys, good, x) in enumerate(got):
        z, want = models[k].logit(views[k]), set()
        for c, sign in ((0, -1), (1, 1)):
            sure = {m[0]: sign * v for m, v in zip(made, z, strict=True) if sign * v >= np.log(0.95 / 0.05) and m[0] not in given[k]}
            want |= {(key, c) for key in sorted(sure, key=lambda i: (-sure[i], i))[:quota[c]]}
        assert set(zip(keys.tolist(), good.tolist(), strict=True)) == want and len(keys) == len(want) > 9
        of = dict(zip([m[0] for m in made], views[1 - k], strict=True))
        assert all((of[key].astype("f2") == row).all() for key, row in zip(keys.tolist(), x, strict=True))
    assert [len(part[0]) for part in cotrain.surest_rows(rows.limit(0), models, given, quota)] == [0, 0]


def test_a_labelled_id_on_many_rows_is_one_row_of_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cotrain, "co_train", lambda views, y, surest, handed: seen.append((views[0].shape, views[1].shape, y.tolist())))
    df = docs(spark, [f"text {i}" for i in range(60)], ["en"] * 60)
    df = df.withColumn("doc_id", cotrain.F.when(cotrain.F.col("doc_id") < 50, 3).when(cotrain.F.col("doc_id") < 55, cotrain.F.lit(None)).otherwise(cotrain.F.col("doc_id")))
    cotrain.fit(df, spark.createDataFrame([(3, 1), (57, 0), (58, 1), (99, 1)], "doc_id long, quality int"), labelled=4)
    assert seen[0][0] == (3, cotrain.BUCKETS + 4) and seen[0][1][0] == 3 and sorted(seen[0][2]) == [0, 1, 1]


def test_samples_and_bound_of_the_classifier(spark, monkeypatch):
    assert cotrain.LABELLED == 8000
    monkeypatch.setattr(cotrain, "fit", lambda *_: None)
    monkeypatch.setattr(cotrain, "score_column", lambda *_: lambda: cotrain.F.struct(cotrain.F.col("text").cast("double").alias("q")))
    kept = cotrain.keep_good(docs(spark, ["0.2", "0.4", "0.5", "0.9"]), None)
    assert [r["text"] for r in kept.collect()] == ["0.5", "0.9"]  # a score from 0.3 to 0.5 is not kept


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    rnd = np.random.default_rng(1)
    v = rnd.standard_normal((400, 16))
    v[100:230] = v[100]  # many copies of one vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, ann.F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        best = [int(i) for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        hits += len(set(best) & {x[1] for x in found})
        assert [x[0] for x in sorted(found)] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert ann.neighbours(df.limit(0), ann.F.col("vec_id") % 20 == 0).count() == 0


def test_edited_digest(spark, tmp_path):
    df = docs(spark, ["abcdef", "xyz", None]).select("doc_id", "text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in imatch.op5_imatch(spark, str(tmp_path)).collect()}
    want = {0: "abc", 1: "xya", 2: ""}  # the next of 0 is the first, 2, which is null
    assert {i: r["edited_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_pair_test_by_ranks_equals_the_merge_rule():
    """Whether two tokens stay apart, read from merge ranks, against the rule itself on small ordered lists."""
    import random

    from tessera.llm.transducer import Merges, transduce
    for seed in range(400):
        rng = random.Random(seed)
        tokens, merges = ["a", "b"], []
        for _ in range(rng.randint(1, 9)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        m = Merges({t: i for i, t in enumerate(tokens)}, merges)
        assert m.ordered
        for left in m.symbols:
            for right in m.symbols:
                a, b = "".join(m.symbols[left]), "".join(m.symbols[right])
                assert m._apart(a, b) == (m.merge(m.symbols[left] + m.symbols[right]) == [a, b]), (merges, a, b)
        word = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        assert [tokens[t] for run in transduce(m, word) for t in run] == m.merge(list(word))


def test_unordered_merge_lists_use_the_rule():
    from tessera.llm.transducer import Merges, transduce
    merges = [("ab", "c"), ("a", "b"), ("c", "a")]
    tokens = ["a", "b", "c", "abc", "ab", "ca"]
    m = Merges({t: i for i, t in enumerate(tokens)}, merges)
    assert not m.ordered
    for word in ("abc", "abca", "cabc", "abcabcab", "ccaab"):
        assert [tokens[t] for run in transduce(m, word) for t in run] == m.merge(list(word))


def test_words_and_their_marks_are_encoded_without_the_pattern():
    """A word, or a word and a closing mark, is cut without the word pattern and remembered once; ids are the library's."""
    texts = ["wörd, é. a; b ñandú! q) (x) end", "ª º µ aª, 3, a1. _a a_, İ, ſ, ŉ. ǅ!", "I 't. don't, ,, a.. a!? x'", "naïve naïve, naïve", ""]
    one = bytebpe.ByteBpe(bytebpe.vocabulary("byte_bpe_50k.json"))
    for _ in range(2):  # from the model, then from what is remembered
        assert [one.encode(t).tolist() for t in texts] == [one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert " naïve" not in one.pieces and {"naïve", "naïve,"} <= set(one.runs)


def test_what_a_worker_remembers_is_bounded_in_bytes(monkeypatch):
    """Runs and pre-tokens seen once leave again, whatever their number and length; ids stay the library's."""
    monkeypatch.setattr(bytebpe, "MEMO", 20_000)
    monkeypatch.setattr(bytebpe, "RUN_MEMO", 20_000)
    monkeypatch.setattr(bytebpe, "KNOWN", 20_000)
    one, rnd = bytebpe.ByteBpe(bytebpe.vocabulary("byte_bpe_50k.json")), random.Random(5)
    word = lambda: "".join(rnd.choice("abdeinorstéñ1,.'\n") for _ in range(rnd.randrange(1, 14)))
    for k in range(12):
        texts = [" ".join(["often", *(word() for _ in range(120)), "x1" * 5000, "often,"]) for _ in range(4)]
        want = [one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [one.encode(t).tolist() for t in texts] == want
        ids, counts = one.encode_all(texts)
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
        for memo in (one.pieces, one.runs):
            assert sum(sys.getsizeof(x) + sys.getsizeof(v) for g in (memo, memo.elder) for x, v in g.items()) <= 40_000
        words, their = one.known
        assert sum(map(len, words.to_pylist())) + 4 * len(their.flatten()) <= 20_000
    assert "often" in one.runs or "often" in one.runs.elder  # what is asked for again stays


def test_texts_encoded_together_equal_the_library():
    lib, one = library("byte_bpe_50k.json"), bytebpe.ByteBpe(bytebpe.vocabulary("byte_bpe_50k.json"))
    texts = [*TRICKY, "a  ", "\n  ", " ", " a", "a \n", "a   b", "word", "naïve naïve, naïve", "a \t b word word, 12", "<|endoftext|> b"]
    for some in (texts, texts[::-1], texts, [""], ["word"], ["日本"], []):
        ids, counts = one.encode_all(some)
        want = [lib.encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_batches_are_encoded_in_parts(spark, tmp_path):
    """Slices of a batch hold every row once, in order; files read back equal the library over segments and ranges."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * k if k % 4 else None for k in range(40)])], names=["text"])
    got = list(dac.parts(batch, 100))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and len(got) > 5
    assert sum(p.num_rows for p in dac.parts(batch.slice(0, 0), 100)) == 0
    lib = library("byte_bpe_50k.json")
    rows = [(7, "same id b"), (7, "same id a"), (7, None), (None, "no id"), (3, "x y, z."), (9, ""), (2, "a " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dac.write_tokens(df, f"file://{tmp_path}/p", bytebpe.vocabulary("byte_bpe_50k.json"), n_ranges=2)
    got = sorted(dac.read_tokens(spark, f"file://{tmp_path}/p").collect(), key=lambda r: r["start"])
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [list(r["ids"]) for r in got] == [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
