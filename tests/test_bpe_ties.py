"""BPE learning where very many pairs share the best count."""

import random

import pytest
from pyspark.sql import DataFrame

from tessera.operators import bpe


def plain_bpe(words, n):
    words, out = [(list(w), c) for w, c in words], []
    while len(out) < n:
        counts = {}
        for w, c in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + c
        if not counts:
            break
        best = min(counts, key=lambda p: (-counts[p], p))
        out.append((*best, counts[best]))
        new = []
        for w, c in words:
            i, merged = 0, []
            while i < len(w):
                if tuple(w[i:i + 2]) == best:
                    merged.append(w[i] + w[i + 1])
                    i += 2
                else:
                    merged.append(w[i])
                    i += 1
            new.append((merged, c))
        words = new
    return out


def learned(spark, words, n, per_round):
    df = spark.createDataFrame([(list(w), c) for w, c in words], "symbols array<string>, n long")
    return [(r["left"], r["right"], r["count"]) for r in bpe.learn_bpe(df, n, per_round=per_round).orderBy("rank").collect()]


def test_nine_thousand_tied_pairs_hand_over_a_bounded_number(spark, monkeypatch):
    words = [(chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i), 3) for i in range(9000)]
    held, frames, lists = [], DataFrame.toPandas, DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: held.append(len(p := frames(df))) or p)
    monkeypatch.setattr(bpe, "tied_merges", lambda *a, f=bpe.tied_merges: (held.append(len(m := f(*a))), m)[1])
    got = learned(spark, words, 250, 100)
    assert got == [(w[0], w[1], 3) for w, _ in sorted(words)[:250]]
    assert held and max(held) <= 201 and lists  # 100 pairs at first, twice as many in the next round


@pytest.mark.parametrize("seed", range(4))
def test_ties_match_one_by_one_learning(spark, seed):
    rnd = random.Random(seed)
    words = [("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6))), 1) for _ in range(14)]
    want = plain_bpe(words, 30)
    assert learned(spark, words, 30, 2) == want


def test_words_are_segmented_all_at_once():
    """``_segment_ids`` gives the ids of ``_segment``'s pieces, for repeated symbols, symbols made twice, unknown characters and empty words."""
    import random
    draw = random.Random(5)
    pairs = [("a", "a"), ("b", "a"), ("aa", "a"), ("a", "b"), ("aa", "b"), ("ab", "ab"), ("b", "b"), ("a", "ab"), ("é", "a"), ("abab", "aa")]
    words = ["", "a", "aaaaaaa", "ab" * 9, "zé", "日a", *("".join(draw.choices("abéz", k=draw.randrange(12))) for _ in range(400))]
    for n in (0, 3, len(pairs)):
        ranks = {p: k for k, p in enumerate(pairs[:n])}
        for ids in ({"<unk>": 9, "a": 0, "b": 1, "aa": 2, "ab": 3, "z": 4, "abab": 5}, {"a": 0, "ab": 1}, {}):
            unk = ids.get("<unk>")
            got = bpe._segment_ids(words, bpe._segment_tables(ranks, ids, unk), ids, unk)
            assert got == [[ids.get(p, unk) for p in bpe._segment(w, ranks)] for w in words]


def test_encoding_segments_no_word_alone(spark, monkeypatch):
    """Encoding takes the words of a batch together: the word-by-word way is not called."""
    from tessera.operators.bpe import bpe_vocab, encode_bpe, learn_bpe, word_counts
    df = spark.createDataFrame([(1, ["low", " low", " lower", "low"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    words = word_counts(df)
    merges = learn_bpe(words, 4)
    calls = []
    tables = bpe._segment_tables
    monkeypatch.setattr(bpe, "_segment_tables", lambda *a: calls.append(1) or tables(*a))
    got = {r["doc_id"]: r["input_ids"] for r in encode_bpe(df, merges, bpe_vocab(words, merges), keep=["doc_id"]).collect()}
    assert calls and got[2] == [] and got[3] is None and got[1][0] == got[1][-1] and len(got[1]) >= 4
