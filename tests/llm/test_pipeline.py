"""The pipeline's stages on a small fixture, each against a plain version on its own input."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import cotrain, langid, mixing
from tessera.llm.bytebpe import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        made = stage(spark, docs, SF).persist()
        out[name] = docs, made
        docs = made
    return out


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages_keep_columns_and_only_drop_or_draw(stages):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "language_id", "ngram_jaccard", "source_mix", "bpe_tokens"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns
        assert set(rows(after, after.columns)) <= set(rows(before, after.columns))
        assert after.count() > 0


def test_quality_stage_keeps_what_scores_enough(spark, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    score = cotrain.score_column(spark, cotrain.fit(before, labels))
    kept = {r["doc_id"] for r in before.select("doc_id", score()["q"].alias("q")).collect() if r["q"] >= cotrain.KEEP_AT}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == kept
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good - kept) * 20 <= len(good)  # clean documents stay; README has the error counts of both kinds


def test_language_stage_keeps_texts_of_a_known_language(spark, stages):
    before, after = stages["language_id"]
    filters = langid.learn(before.where(~langid.held_out(F.col("doc_id"))))
    texts = before.select("doc_id", "text").collect()
    lang, score = filters.predict([r["text"] for r in texts])
    bound = dict(zip(filters.languages, langid.KEEP_AT * filters.coverage, strict=True))
    assert {r["doc_id"] for r, x, s in zip(texts, lang, score) if s > 0 and s >= bound[x]} == {r["doc_id"] for r in after.select("doc_id").collect()}


def test_near_duplicate_stage_leaves_one_of_each_class(stages):
    from tessera.llm.jaccard import THRESHOLD
    before, after = stages["ngram_jaccard"]

    def grams(text):
        import re
        words = re.findall(r"\w+", (text or "").lower())
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    sets = {r["doc_id"]: grams(r["text"]) for r in after.select("doc_id", "text").collect()}
    ids = sorted(i for i in sets if len(sets[i]) > 20)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if len(sets[a] & sets[b]) >= (THRESHOLD + 0.02) * len(sets[a] | sets[b])]
    assert not close
    texts = {r["text"] for r in before.select("text").collect()}
    assert len(texts) >= after.select("text").distinct().count() == after.count()


def test_mix_stage_draws_what_the_plan_takes(stages):
    before, after = stages["source_mix"]
    plan = mixing.assign(before.select("doc_id", "source", "text"))
    want = {r["doc_id"]: r["n"] for r in plan.select("doc_id", F.size("mix_copies").alias("n")).collect() if r["n"]}
    assert Counter(r["doc_id"] for r in after.select("doc_id").collect()) == want
    assert max(want.values()) <= 2


def test_token_stage_equals_the_library(stages):
    from tokenizers import Tokenizer
    before, after = stages["bpe_tokens"]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = []
    for r in before.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert rows(after, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=repr)


def test_pipeline_passes_an_empty_table(spark, stages):
    docs = stages["quality_classifier"][0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
