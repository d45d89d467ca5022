"""Registered queries: key → (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the given tables (whole tables,
no row caps except where a limit is the feature: slices, previews, BLEU sample).
Computed columns carry the same names in the plan and in the SQL; doubles are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import EOS_TOKEN, MASK_TOKEN, UNK_TOKEN
from tessera.functions import arrays as A
from tessera.functions.text import pretokenize
from tessera.operators import blocks as B
from tessera.operators import metrics as E
from tessera.operators import model as N
from tessera.operators import rowindex as L
from tessera.operators import tokens as TK
from tessera.plans import oracle_sql as O
from tessera.plans.corpus import BLOCK_KEYS, SPEC, CorpusPlan
from tessera.session import ensure_checkpoint_dir, scratch_path, ship_package
from tessera.sources.corpus import read_corpus, read_table, select_text, text_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEP = "\x01"


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return _fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def md5_ids(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.array_join(c, ","))


def r6(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def md5_sql(col: str) -> str:
    return f"md5(array_to_string({col}, ','))"


# ---------------------------------------------------------------- sources

@register("scan_corpus", """
SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def scan_corpus(spark, sf):
    df = read_corpus(spark, f"{sf}/documents.parquet", "parquet")
    return df.select("doc_id", "lang", "source", F.length(text_column(df)).cast("long").alias("n_chars"))


@register("resolve_text_column", """
SELECT conv_id, turn, 'text' AS text_col, CAST(length(text) AS BIGINT) AS n_chars FROM conversations""")
def resolve_text_column(spark, sf):
    df = read_table(spark, sf, "conversations")
    name = text_column(df)
    return df.select("conv_id", "turn", F.lit(name).alias("text_col"),
                     F.length(name).cast("long").alias("n_chars"))


# ---------------------------------------------------------------- index, splits

@register("row_index", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents""")
def row_index(spark, sf):
    return L.with_row_index(read_table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("split_first_n", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents ORDER BY doc_id LIMIT 100""")
def split_first_n(spark, sf):
    docs = read_table(spark, sf, "documents")
    return L.slice_rows(docs, "doc_id", 100).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@register("split_percent", O.with_corpus("SELECT doc_id, idx, split, split_idx FROM sp2"))
def split_percent(spark, sf):
    return CorpusPlan(spark, sf).split.select("doc_id", "idx", "split", "split_idx")


@register("cap_samples", """
SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 200""")
def cap_samples(spark, sf):
    conv = read_table(spark, sf, "conversations")
    return L.cap_samples(conv, ["conv_id", "turn"], 200).select("conv_id", "turn", "role")


@register("preview", """SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 3""")
def preview(spark, sf):
    return L.preview(read_table(spark, sf, "documents"), "doc_id", 3).select("doc_id", "lang")


@register("shuffle_batches", """
SELECT doc_id, shuffle_key, idx, idx // 64 AS batch_id FROM (
  SELECT doc_id, shuffle_key, row_number() OVER (ORDER BY shuffle_key, doc_id) - 1 AS idx
  FROM (SELECT doc_id, md5(concat_ws('|', CAST(doc_id AS VARCHAR), '43', '0')) AS shuffle_key FROM documents))""")
def shuffle_batches(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    return L.shuffle_batches(docs, "doc_id", seed=43, epoch=0, batch_size=64).select(
        "doc_id", "shuffle_key", "idx", "batch_id")


SLICE = 30_000


@register("slice_large", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT {SLICE}""")
def slice_large(spark, sf):
    """L1, L3 beyond what one task may take: a filter up to the key of the last row."""
    items = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return L.cap_samples(items, ["l_orderkey", "l_linenumber"], SLICE)


def _feistel_sql(seed: int, epoch: int, rounds: int = L.FEISTEL_ROUNDS) -> str:
    """One step of the permutation on column x, in SQL."""
    out = "SELECT idx, n, a, b, x // b AS l, x % b AS r FROM src"
    for i in range(rounds):
        half, side = ("r", "a") if i % 2 == 0 else ("l", "b")
        mixed = f"CAST('0x' || substr(md5(concat_ws('/', '{seed}', '{epoch}', '{i}', CAST({half} AS VARCHAR))), 1, 12) AS BIGINT) % {side}"
        out = (f"SELECT idx, n, a, b, (l + {mixed}) % a AS l, r FROM ({out})" if i % 2 == 0
               else f"SELECT idx, n, a, b, l, (r + {mixed}) % b AS r FROM ({out})")
    return f"SELECT idx, n, a, b, l * b + r AS x FROM ({out})"


@register("epoch_batches", f"""
WITH RECURSIVE ix AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
side AS (SELECT doc_id, idx, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM ix),
walk AS (SELECT idx, n, a, b, x FROM (WITH src AS (SELECT idx, n, a, (n + a - 1) // a AS b, idx AS x FROM side) {_feistel_sql(43, 1)})
         UNION ALL SELECT idx, n, a, b, x FROM (WITH src AS (SELECT * FROM walk WHERE x >= n) {_feistel_sql(43, 1)}))
SELECT doc_id, idx, x AS place, x // 64 AS batch_id FROM walk JOIN side USING (idx) WHERE x < walk.n""")
def epoch_batches(spark, sf):
    """L6 by a keyed bijection of the row index: the epoch order needs no second sort."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    ix = L.with_row_index(docs, "doc_id")
    return L.epoch_batches(ix, docs.count(), seed=43, epoch=1, batch_size=64).select("doc_id", "idx", "place", "batch_id")


# ---------------------------------------------------------------- tokens

@register("pretokenize", O.with_corpus(f"""
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, chr(1))) AS tokens_md5
FROM tok"""))
def pretokenize_q(spark, sf):
    docs = select_text(read_table(spark, sf, "documents"), keep=["doc_id"])
    t = docs.select("doc_id", pretokenize("text").alias("tokens"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("tokens", SEP)).alias("tokens_md5"))


@register("build_vocab", O.with_corpus("SELECT token, token_id, freq, is_special FROM vocab0"))
def build_vocab_q(spark, sf):
    return CorpusPlan(spark, sf).base_vocab.select("token", "token_id", "freq", "is_special")


@register("vocab_with_mask", O.with_corpus("SELECT token, token_id, freq, is_special FROM vocab"))
def vocab_with_mask(spark, sf):
    return CorpusPlan(spark, sf).vocab.select("token", "token_id", "freq", "is_special")


@register("unbounded_vocab", f"""
WITH cnt AS (SELECT token, count(*) AS freq FROM (SELECT unnest({O.tokens_expr('text')}) AS token FROM documents) GROUP BY token),
reg AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) - 1 AS INTEGER) AS token_id, freq, false AS is_special FROM cnt),
n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM reg)
SELECT * FROM reg UNION ALL SELECT {O.q(UNK_TOKEN)}, n, 0, true FROM n
UNION ALL SELECT {O.q(EOS_TOKEN)}, n + 1, 0, true FROM n""")
def unbounded_vocab(spark, sf):
    """T2 without a size: ids by the distributed index, specials appended; no token meets another in one task."""
    docs = CorpusPlan(spark, sf).docs
    return TK.build_vocab(docs.select(pretokenize("text").alias("tokens")))


@register("encode_docs", O.with_corpus(f"""
SELECT doc_id, split, CAST(len(input_ids) AS BIGINT) AS n_tokens, CAST(n_unk AS BIGINT) AS n_unk,
       {md5_sql('input_ids')} AS ids_md5 FROM enc"""))
def encode_docs(spark, sf):
    cp = CorpusPlan(spark, sf)
    unk = cp.token_id(UNK_TOKEN)
    return cp.encoded.select("doc_id", "split", F.size("input_ids").cast("long").alias("n_tokens"),
                             F.size(F.filter("input_ids", lambda x: x == F.lit(unk))).cast("long").alias("n_unk"),
                             md5_ids("input_ids").alias("ids_md5"))


@register("vocab_coverage", O.with_corpus(f"""
SELECT max(id) AS max_id, count(DISTINCT id) AS distinct_ids, (SELECT count(*) FROM vocab) AS vocab_size,
       CAST({SPEC.vocab_size + 2} AS BIGINT) AS expected_size,
       (SELECT count(*) FROM vocab) > {SPEC.vocab_size + 2} AS needs_resize
FROM (SELECT unnest(input_ids) AS id FROM enc)"""))
def vocab_coverage(spark, sf):
    cp = CorpusPlan(spark, sf)
    out = TK.vocab_coverage(cp.encoded, cp.vocab, SPEC.vocab_size + 2)
    return out.select(F.col("max_id").cast("int").alias("max_id"), "distinct_ids", "vocab_size",
                      "expected_size", "needs_resize")


@register("special_ids", O.with_corpus(f"""
SELECT max(CASE WHEN token = {O.q(MASK_TOKEN)} THEN token_id END) AS mask_id,
       max(CASE WHEN token = {O.q(EOS_TOKEN)} THEN token_id END) AS eos_id,
       max(CASE WHEN token = {O.q(UNK_TOKEN)} THEN token_id END) AS unk_id,
       max(CASE WHEN token = {O.q(EOS_TOKEN)} THEN token_id END) AS pad_id FROM vocab"""))
def special_ids(spark, sf):
    return TK.special_ids(CorpusPlan(spark, sf).vocab)


@register("decode_ids", O.with_corpus(f"""
SELECT t.doc_id, CAST(length(d.txt) AS BIGINT) AS n_chars, md5(d.txt) AS text_md5,
       d.txt = s.text AS roundtrip
FROM (SELECT doc_id, string_agg(CASE WHEN v.token IS NULL THEN {O.q(UNK_TOKEN)} ELSE v.token END, ''
                                ORDER BY pos) AS txt
      FROM tpos LEFT JOIN vocab v USING (token) GROUP BY doc_id) d
JOIN tok t USING (doc_id) JOIN sp2 s USING (doc_id)
UNION ALL
SELECT t.doc_id, 0, md5(''), s.text = '' FROM tok t JOIN sp2 s USING (doc_id) WHERE len(t.tokens) = 0"""))
def decode_ids(spark, sf):
    cp = CorpusPlan(spark, sf)
    dec = TK.decode(cp.encoded.select("doc_id", "input_ids"), cp.vocab, vocab_table=cp.vocab_table)
    txt = F.array_join("tokens", "")
    out = dec.join(cp.docs, "doc_id")
    return out.select("doc_id", F.length(txt).cast("long").alias("n_chars"), F.md5(txt).alias("text_md5"),
                      (txt == F.col("text")).alias("roundtrip"))


# ---------------------------------------------------------------- packing, labels, masks (B*)

PACK_OUT = f"SELECT split, batch_id, block_no, CAST(len(input_ids) AS BIGINT) AS n_tokens, " \
           f"{md5_sql('input_ids')} AS ids_md5 FROM packed"


def _pack_out(df: DataFrame) -> DataFrame:
    return df.select("split", "batch_id", "block_no", F.size("input_ids").cast("long").alias("n_tokens"),
                     md5_ids("input_ids").alias("ids_md5"))


@register("pack_blocks", O.with_corpus(PACK_OUT))
def pack_blocks(spark, sf):
    return _pack_out(CorpusPlan(spark, sf).packed)


@register("labels_copy", O.with_corpus(f"""
SELECT split, batch_id, block_no, {md5_sql('input_ids')} AS labels_md5 FROM packed"""))
def labels_copy(spark, sf):
    p = B.with_labels(CorpusPlan(spark, sf).packed)
    return p.select("split", "batch_id", "block_no", md5_ids("labels").alias("labels_md5"))


def _interleave_sql() -> str:
    return """
il AS (SELECT split, batch_id, block_no, input_ids,
         list_transform(range(1, 2 * len(input_ids)), lambda j:
           CASE WHEN j % 2 = 1 THEN input_ids[(j + 1) // 2]
                WHEN input_ids[j // 2 + 1] = pad THEN input_ids[j // 2 + 1]
                ELSE msk END) AS ids2,
         list_transform(range(1, 2 * len(input_ids)), lambda j: 1) AS am2
       FROM packed,
            (SELECT token_id AS pad FROM vocab WHERE token = '<|endoftext|>'),
            (SELECT token_id AS msk FROM vocab WHERE token = '<|MASK|>'))"""


@register("interleave_mask", O.with_corpus(f"""
SELECT split, batch_id, block_no, CAST(len(ids2) AS BIGINT) AS n_ids, {md5_sql('ids2')} AS ids_md5,
       {md5_sql('input_ids')} AS labels_md5 FROM il""", _interleave_sql()))
def interleave_mask(spark, sf):
    cp = CorpusPlan(spark, sf)
    out = B.interleave_mask(cp.packed, cp.token_id(MASK_TOKEN), cp.token_id(EOS_TOKEN))
    return out.select("split", "batch_id", "block_no", F.size("input_ids").cast("long").alias("n_ids"),
                      md5_ids("input_ids").alias("ids_md5"), md5_ids("labels").alias("labels_md5"))


@register("interleave_attention", O.with_corpus(f"""
SELECT split, batch_id, block_no, CAST(len(am2) AS BIGINT) AS n_mask, {md5_sql('am2')} AS mask_md5
FROM il""", _interleave_sql()))
def interleave_attention(spark, sf):
    p = CorpusPlan(spark, sf).packed
    am = A.interleave_attention("attention_mask")
    return p.select("split", "batch_id", "block_no", F.size(am).cast("long").alias("n_mask"),
                    md5_ids(am).alias("mask_md5"))


@register("dual_labels", O.with_corpus(f"""
SELECT split, batch_id, block_no, CAST(len(dl) AS BIGINT) AS n_labels, {md5_sql('dl')} AS labels_md5
FROM (SELECT split, batch_id, block_no,
        list_transform(range(0, 2 * len(input_ids) - 2), lambda i:
          CASE WHEN i % 2 = 0 THEN input_ids[i // 2 + 2] ELSE input_ids[i // 2 + 1] END) AS dl
      FROM packed)"""))
def dual_labels(spark, sf):
    p = B.dual_labels(B.with_labels(CorpusPlan(spark, sf).packed))
    return p.select("split", "batch_id", "block_no", F.size("dual_labels").cast("long").alias("n_labels"),
                    md5_ids("dual_labels").alias("labels_md5"))


@register("infill_triples", O.with_corpus("""
SELECT split, batch_id, block_no, CAST(k - 1 AS INTEGER) AS pos,
       CASE WHEN k > 1 THEN input_ids[k - 1] END AS "left", input_ids[k] AS target, input_ids[k + 1] AS "right"
FROM (SELECT *, unnest(range(1, len(input_ids))) AS k FROM packed)"""))
def infill_triples(spark, sf):
    p = CorpusPlan(spark, sf).packed
    return B.infill_triples(p, ["split", "batch_id", "block_no"])


@register("random_mask", O.with_corpus(f"""
SELECT split, batch_id, block_no, CAST(coalesce(max(k), 0) AS INTEGER) AS n_masked,
       md5(string_agg(CAST(CASE WHEN cand AND rk <= k THEN (SELECT token_id FROM vocab WHERE token = '<|MASK|>')
                                ELSE id END AS VARCHAR), ',' ORDER BY pos)) AS masked_md5
FROM (
  SELECT *, CASE WHEN cand THEN row_number() OVER (PARTITION BY split, batch_id, block_no, cand ORDER BY h) END AS rk,
         CASE WHEN ncand > 0 THEN greatest(1, CAST(floor(ncand * 0.15) AS INTEGER)) ELSE 0 END AS k
  FROM (
    SELECT *, md5(concat_ws('|', rowkey, CAST(pos AS VARCHAR), '0')) AS h,
           count(*) FILTER (WHERE cand) OVER (PARTITION BY split, batch_id, block_no) AS ncand
    FROM (
      SELECT *, NOT list_contains((SELECT list(token_id) FROM vocab WHERE is_special), id) AS cand
      FROM (SELECT split, batch_id, block_no, split || ':' || batch_id || ':' || block_no AS rowkey,
                   unnest(input_ids) AS id, generate_subscripts(input_ids, 1) - 1 AS pos
            FROM packed))))
GROUP BY ALL"""))
def random_mask(spark, sf):
    cp = CorpusPlan(spark, sf)
    specials = [cp.token_id(t) for t in (UNK_TOKEN, EOS_TOKEN, MASK_TOKEN)]
    p = cp.packed.withColumn("rowkey", F.concat_ws(":", "split", "batch_id", "block_no"))
    m = B.random_mask(p, "rowkey", cp.token_id(MASK_TOKEN), specials, seed=0)
    return m.select("split", "batch_id", "block_no", F.col("n_masked").cast("int").alias("n_masked"),
                    md5_ids("masked_ids").alias("masked_md5"))


@register("token_stats", O.with_corpus("""
SELECT split, count(*) AS n_blocks, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens FROM packed GROUP BY split"""))
def token_stats(spark, sf):
    return B.token_stats(CorpusPlan(spark, sf).packed)


@register("step_plan", O.with_corpus("""
SELECT split, n_blocks, steps_per_epoch, steps_per_epoch * 5 AS total_steps,
       unnest(CASE WHEN steps_per_epoch * 5 >= 500 THEN range(500, steps_per_epoch * 5 + 1, 500)
                   ELSE [NULL] END) AS eval_step
FROM (SELECT split, n_blocks, CAST(ceil(ceil(n_blocks / 64) / 1) AS BIGINT) AS steps_per_epoch
      FROM (SELECT split, count(*) AS n_blocks FROM packed GROUP BY split))"""))
def step_plan(spark, sf):
    st = B.token_stats(CorpusPlan(spark, sf).packed)
    sp = B.step_plan(st, per_device_batch=64, grad_accum=1, epochs=5, every=500)
    return sp.select("split", "n_blocks", "steps_per_epoch", "total_steps", "eval_step")


# ---------------------------------------------------------------- next-token model + scoring

@register("fit_bigram", O.with_corpus("SELECT prev_id, next_id, n FROM bg"))
def fit_bigram(spark, sf):
    return CorpusPlan(spark, sf).bigram


@register("score_bigram", O.with_corpus(f"""
SELECT batch_id, block_no, n_pairs, round(loss, 6) AS loss, {md5_sql('pred')} AS pred_md5,
       {md5_sql('labels')} AS labels_md5 FROM scored"""))
def score_bigram(spark, sf):
    s = CorpusPlan(spark, sf).scored
    return s.select("batch_id", "block_no", "n_pairs", r6("loss").alias("loss"),
                    md5_ids("pred").alias("pred_md5"), md5_ids("labels").alias("labels_md5"))


ACC_SQL = """acc AS (SELECT avg(CASE WHEN pred[i] = labels[i + 1] THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM (SELECT pred, labels, unnest(range(1, len(labels))) AS i FROM scored))"""


@register("shift_pairs", O.with_corpus("""
SELECT batch_id, block_no, count(*) AS n_pairs, count(*) FILTER (WHERE pred[i] = labels[i + 1]) AS n_equal
FROM (SELECT batch_id, block_no, pred, labels, unnest(range(1, len(labels))) AS i FROM scored) GROUP BY ALL"""))
def shift_pairs(spark, sf):
    pairs = B.shift_pairs(CorpusPlan(spark, sf).scored, BLOCK_KEYS)
    return pairs.groupBy(*BLOCK_KEYS).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(F.when(F.col("pred") == F.col("label"), 1)).alias("n_equal"))


@register("token_accuracy", O.with_corpus("SELECT round(accuracy, 6) AS accuracy FROM acc", ACC_SQL))
def token_accuracy(spark, sf):
    pairs = B.shift_pairs(CorpusPlan(spark, sf).scored, BLOCK_KEYS)
    return E.token_accuracy(pairs).select(r6("accuracy").alias("accuracy"))


@register("mean_loss", O.with_corpus("SELECT round(avg(loss), 6) AS loss FROM scored"))
def mean_loss(spark, sf):
    return E.mean_loss(CorpusPlan(spark, sf).scored).select(r6("loss").alias("loss"))


@register("perplexity", O.with_corpus("SELECT round(exp(avg(loss)), 6) AS perplexity FROM scored"))
def perplexity(spark, sf):
    m = E.mean_loss(CorpusPlan(spark, sf).scored)
    return m.select(r6(E.perplexity("loss")).alias("perplexity"))


BLEU10 = O.bleu_ctes("(SELECT * FROM scored ORDER BY batch_id, block_no LIMIT 10)", "batch_id, block_no")
BLEU_ALL = O.bleu_ctes("scored", "batch_id, block_no")


@register("bleu_sample", O.with_corpus(
    "SELECT round(coalesce(avg(bleu), 0.0), 6) AS bleu FROM bleu_rows", BLEU10))
def bleu_sample(spark, sf):
    cp = CorpusPlan(spark, sf)
    b = E.bleu(cp.scored_first(10), BLOCK_KEYS, sample=None, id_bound=cp.vocab_rows)
    return b.select(r6("bleu").alias("bleu"))


@register("bleu_all", O.with_corpus(
    "SELECT batch_id, block_no, round(bleu, 6) AS bleu FROM bleu_rows", BLEU_ALL))
def bleu_all(spark, sf):
    cp = CorpusPlan(spark, sf)
    per = E.sentence_bleu(cp.scored, BLOCK_KEYS, id_bound=cp.vocab_rows)
    return per.select(*BLOCK_KEYS, r6("bleu").alias("bleu"))


@register("eval_samples", O.with_corpus("SELECT count(*) AS eval_samples FROM scored"))
def eval_samples(spark, sf):
    return E.eval_samples(CorpusPlan(spark, sf).packed_ids.filter(F.col("split") == "validation"))


EVAL_SQL = O.with_corpus("""
SELECT round(acc.accuracy, 6) AS accuracy, round(l.loss, 6) AS loss, round(exp(l.loss), 6) AS perplexity,
       round(coalesce(b.bleu, 0.0), 6) AS bleu, n.eval_samples
FROM acc, (SELECT avg(loss) AS loss FROM scored) l, (SELECT avg(bleu) AS bleu FROM bleu_rows) b,
     (SELECT count(*) AS eval_samples FROM scored) n""", ACC_SQL + "," + BLEU10)


def _evaluate(spark, sf) -> DataFrame:
    cp = CorpusPlan(spark, sf)
    s = cp.scored_table
    row = E.evaluate(E.token_accuracy(B.shift_pairs(s, BLOCK_KEYS)), E.mean_loss(s),
                     E.bleu(s, BLOCK_KEYS, sample=10, id_bound=cp.vocab_rows, pad_id=cp.token_id(EOS_TOKEN)), E.eval_samples(s))
    return row.select(r6("accuracy").alias("accuracy"), r6("loss").alias("loss"),
                      r6("perplexity").alias("perplexity"), r6("bleu").alias("bleu"), "eval_samples")


register("evaluate", EVAL_SQL)(_evaluate)


@register("fit_infill", O.with_corpus("""
SELECT "left", "right", context_total, target AS top_target FROM (
  SELECT "left", "right", target, CAST(sum(n) OVER (PARTITION BY "left", "right") AS BIGINT) AS context_total,
         row_number() OVER (PARTITION BY "left", "right" ORDER BY n DESC, target ASC) AS rk
  FROM (SELECT "left", "right", target, count(*) AS n FROM (
          SELECT CASE WHEN k > 1 THEN ids[k - 1] END AS "left", ids[k] AS target, ids[k + 1] AS "right"
          FROM (SELECT ids, unnest(range(1, len(ids))) AS k FROM trp)) GROUP BY ALL))
WHERE rk = 1"""))
def fit_infill(spark, sf):
    cp = CorpusPlan(spark, sf)
    m = N.fit_infill(counts=N.infill_counts(cp.blocks("train"), id_bound=cp.vocab_rows))
    return m.select("left", "right", F.col("context_total").cast("long").alias("context_total"), "top_target")


# ---------------------------------------------------------------- classification-style losses

@register("argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred, label FROM embeddings""")
def argmax_class(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return E.argmax_class(emb, "embedding").select("vec_id", "pred", "label")


def _lse_sql(arr: str) -> str:
    return f"(list_max({arr}) + ln(list_sum(list_transform({arr}, lambda x: exp(x - list_max({arr}))))))"


@register("class_ce", f"""
SELECT round(avg({_lse_sql('e')} - e[label + 1]), 6) AS class_ce
FROM (SELECT CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)""")
def class_ce(spark, sf):
    emb = read_table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("logits"), "label")
    return E.class_ce(emb).select(r6("class_ce").alias("class_ce"))


SEQ_SQL = """(SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS e, label
              FROM embeddings)"""


@register("cross_entropy", f"""
SELECT round(avg({_lse_sql('e')} - e[nxt + 1]), 6) AS cross_entropy FROM (
  SELECT e, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM {SEQ_SQL})
WHERE nxt IS NOT NULL AND nxt <> -100""")
def cross_entropy(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    seq = emb.select(F.floor(F.col("vec_id") / 8).alias("seq_id"), (F.col("vec_id") % 8).alias("pos"),
                     F.col("embedding").cast("array<double>").alias("logits"), "label")
    ce = E.shifted_cross_entropy(seq, "seq_id", "pos", "logits", "label")
    return ce.select(r6("cross_entropy").alias("cross_entropy"))


@register("token_class_ce", f"""
SELECT round(avg({_lse_sql('e')} - e[label + 1]), 6) AS token_class_ce FROM {SEQ_SQL} WHERE label <> -100""")
def token_class_ce(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    seqs = (emb.groupBy(F.floor(F.col("vec_id") / 8).alias("seq_id"))
            .agg(F.array_sort(F.collect_list(F.struct(
                "vec_id", F.col("embedding").cast("array<double>").alias("lg"), "label"))).alias("s")))
    seqs = seqs.select(F.transform("s", lambda x: x["lg"]).alias("logits"),
                       F.transform("s", lambda x: x["label"]).alias("labels"))
    return E.token_class_ce(seqs).select(r6("token_class_ce").alias("token_class_ce"))


@register("bce_loss", """
SELECT round(avg(greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce FROM (
  SELECT CAST(l_discount AS DOUBLE) AS x, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem
  UNION ALL
  SELECT CAST(l_tax AS DOUBLE), CAST(l_linestatus = 'O' AS DOUBLE) FROM lineitem)""")
def bce_loss(spark, sf):
    line = read_table(spark, sf, "lineitem")
    df = line.select(F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).alias("logits"),
                     F.array((F.col("l_returnflag") == "R").cast("double"),
                             (F.col("l_linestatus") == "O").cast("double")).alias("labels"))
    return E.bce(df).select(r6("bce").alias("bce"))


@register("mse_loss", "SELECT round(avg(pow(l_discount - l_tax, 2)), 6) AS mse FROM lineitem")
def mse_loss(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return E.mse(li, "l_discount", "l_tax").select(r6("mse").alias("mse"))


@register("choice_ce", """
SELECT round(avg(lse - pick), 6) AS choice_ce FROM (
  SELECT l_orderkey, max(s) + ln(sum(exp(s - m))) AS lse, max(CASE WHEN l_linenumber = 1 THEN s END) AS pick
  FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s,
               max(l_discount * 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)
  GROUP BY l_orderkey)""")
def choice_ce(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"), F.lit(1).alias("label"))
    return E.choice_ce(li, "l_orderkey", "l_linenumber", "score", "label").select(
        r6("choice_ce").alias("choice_ce"))


@register("span_ce", f"""
SELECT round((avg(CASE WHEN s <> 32 THEN {_lse_sql('sl')} - sl[s + 1] END)
            + avg(CASE WHEN t <> 32 THEN {_lse_sql('el')} - el[t + 1] END)) / 2, 6) AS span_ce
FROM (SELECT CAST(embedding[1:32] AS DOUBLE[]) AS sl, CAST(embedding[33:64] AS DOUBLE[]) AS el,
             greatest(0, least(label * 3, 32)) AS s, greatest(0, least(label * 3 + 5, 32)) AS t
      FROM embeddings)""")
def span_ce(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    e = F.col("embedding").cast("array<double>")
    df = emb.select(F.slice(e, 1, 32).alias("start_logits"), F.slice(e, 33, 32).alias("end_logits"),
                    (F.col("label") * 3).alias("start"), (F.col("label") * 3 + 5).alias("end"))
    return E.span_ce(df).select(r6("span_ce").alias("span_ce"))


@register("last_token", O.with_corpus(f"""
SELECT split, batch_id, block_no, CAST(lp AS INTEGER) AS last_pos, padded[lp + 1] AS pooled_id FROM (
  SELECT *, coalesce(list_max(list_transform(range(0, len(padded)),
              lambda i: CASE WHEN padded[i + 1] <> pad THEN i ELSE 0 END)), 0) AS lp
  FROM (SELECT split, batch_id, block_no, pad,
               input_ids || list_transform(range(len(input_ids), {SPEC.block_size}), lambda i: pad) AS padded
        FROM packed, (SELECT token_id AS pad FROM vocab WHERE token = {O.q(EOS_TOKEN)})))"""))
def last_token(spark, sf):
    cp = CorpusPlan(spark, sf)
    pad = cp.token_id(EOS_TOKEN)
    bs = SPEC.block_size
    padded = F.concat("input_ids", F.array_repeat(F.lit(pad), F.lit(bs) - F.size("input_ids")))
    out = E.last_token(cp.packed.withColumn("input_ids", padded), "input_ids", pad)
    return out.select("split", "batch_id", "block_no", "last_pos", "pooled_id")


@register("choice_position", O.with_corpus("""
SELECT split, batch_id, block_no,
       CAST(CASE WHEN list_position(input_ids, c) > 0 THEN list_position(input_ids, c) - 1
                 ELSE len(input_ids) - 1 END AS INTEGER) AS cls_pos
FROM packed, (SELECT coalesce(max(token_id), -1) AS c FROM vocab WHERE token = '.')"""))
def choice_position(spark, sf):
    cp = CorpusPlan(spark, sf)
    cls = cp.token_id(".")
    out = E.choice_position(cp.packed, "input_ids", -1 if cls is None else cls)
    return out.select("split", "batch_id", "block_no", "cls_pos")


@register("masked_report", O.with_corpus(f"""
SELECT m.batch_id, m.block_no, CAST(m.pos AS INTEGER) AS pos, m.id AS original_id, vo.token AS original_token,
       vp.token_id AS predicted_id, vp.token AS predicted_token
FROM (
  SELECT *, lag(mid) OVER w AS "left", lead(mid) OVER w AS "right" FROM (
    SELECT *, CASE WHEN cand AND rk <= k THEN (SELECT token_id FROM vocab WHERE token = '<|MASK|>') ELSE id END AS mid
    FROM (
      SELECT *, CASE WHEN cand THEN row_number() OVER (PARTITION BY batch_id, block_no, cand ORDER BY h) END AS rk,
             CASE WHEN ncand > 0 THEN greatest(1, CAST(floor(ncand * 0.15) AS INTEGER)) ELSE 0 END AS k
      FROM (
        SELECT *, md5(concat_ws('|', rowkey, CAST(pos AS VARCHAR), '7')) AS h,
               count(*) FILTER (WHERE cand) OVER (PARTITION BY batch_id, block_no) AS ncand
        FROM (
          SELECT *, NOT list_contains((SELECT list(token_id) FROM vocab WHERE is_special), id) AS cand
          FROM (SELECT batch_id, block_no, batch_id || ':' || block_no AS rowkey,
                       unnest(input_ids) AS id, generate_subscripts(input_ids, 1) - 1 AS pos
                FROM packed WHERE split = 'validation')))))
  WINDOW w AS (PARTITION BY batch_id, block_no ORDER BY pos)) m
LEFT JOIN fi f ON f."left" IS NOT DISTINCT FROM m."left" AND f."right" IS NOT DISTINCT FROM m."right"
LEFT JOIN vocab vo ON vo.token_id = m.id
LEFT JOIN vocab vp ON vp.token_id = coalesce(f.top_target, (SELECT fallback_id FROM fb))
WHERE m.mid = (SELECT token_id FROM vocab WHERE token = '<|MASK|>')""", """
fi AS (SELECT "left", "right", target AS top_target FROM (
  SELECT "left", "right", target,
         row_number() OVER (PARTITION BY "left", "right" ORDER BY n DESC, target ASC) AS rk
  FROM (SELECT "left", "right", target, count(*) AS n FROM (
          SELECT CASE WHEN k > 1 THEN ids[k - 1] END AS "left", ids[k] AS target, ids[k + 1] AS "right"
          FROM (SELECT ids, unnest(range(1, len(ids))) AS k FROM trp)) GROUP BY ALL)) WHERE rk = 1)"""))
def masked_report(spark, sf):
    cp = CorpusPlan(spark, sf)
    mask = cp.token_id(MASK_TOKEN)
    specials = [cp.token_id(t) for t in (UNK_TOKEN, EOS_TOKEN, MASK_TOKEN)]
    val = cp.blocks("validation").withColumn("rowkey", F.concat_ws(":", "batch_id", "block_no"))
    m = B.random_mask(val, "rowkey", mask, specials, seed=7)
    # context of every masked slot, from the masked sequence (neighbours may be masked too)
    ids = F.col("masked_ids")
    n = F.size(ids)
    slots = F.transform(ids, lambda x, i: F.struct(
        i.alias("pos"), x.alias("mid"), F.element_at(F.col("labels"), i + 1).alias("original_id"),
        F.when(i >= 1, F.element_at(ids, F.greatest(i, F.lit(1)))).alias("left"),
        F.when(i + 2 <= n, F.element_at(ids, F.least(i + 2, n))).alias("right")))
    x = (m.select(*BLOCK_KEYS, F.explode(slots).alias("s"))
         .select(*BLOCK_KEYS, "s.*").filter(F.col("mid") == mask))
    model = N.fit_infill(counts=N.infill_counts(cp.blocks("train"), id_bound=cp.vocab_rows))
    fb = N.unigram_top(cp.blocks("train"))
    pred = N.predict_infill(model, x)
    pred = pred.select(*BLOCK_KEYS, "pos", "original_id",
                       F.coalesce(F.col("top_target"), fb.scalar()).alias("predicted_id"))
    # ids → token text (T6); the vocabulary is size-capped, so broadcast
    text = F.broadcast(spark.createDataFrame(cp.vocab_table))
    for side in ("original", "predicted"):
        named = text.select(F.col("token_id").alias(f"{side}_id"), F.col("token").alias(f"{side}_token"))
        pred = pred.join(named, f"{side}_id", "left")
    return pred.select(*BLOCK_KEYS, "pos", "original_id", "original_token", "predicted_id", "predicted_token")


# ---------------------------------------------------------------- array predicates

@register("drop_pad", O.with_corpus("""
SELECT split, batch_id, block_no, CAST(len(k) AS BIGINT) AS n_kept, md5(array_to_string(k, ',')) AS kept_md5
FROM (SELECT split, batch_id, block_no,
             list_filter(input_ids, lambda x: x <> pad) AS k
      FROM packed, (SELECT token_id AS pad FROM vocab WHERE token = '<|endoftext|>'))"""))
def drop_pad(spark, sf):
    cp = CorpusPlan(spark, sf)
    k = A.drop_pad("input_ids", cp.token_id(EOS_TOKEN))
    return cp.packed.select("split", "batch_id", "block_no", F.size(k).cast("long").alias("n_kept"),
                            md5_ids(k).alias("kept_md5"))


@register("stride_even", O.with_corpus(f"""
SELECT split, batch_id, block_no, {md5_sql('s')} AS ids_md5, s = input_ids AS roundtrip
FROM (SELECT split, batch_id, block_no, input_ids,
             list_filter(ids2, lambda x, i: (i - 1) % 2 = 0) AS s FROM il)""", _interleave_sql()))
def stride_even(spark, sf):
    cp = CorpusPlan(spark, sf)
    il = B.interleave_mask(cp.packed, cp.token_id(MASK_TOKEN), cp.token_id(EOS_TOKEN))
    s = A.stride("input_ids", 0, 2)
    return il.select("split", "batch_id", "block_no", md5_ids(s).alias("ids_md5"),
                     (s == F.col("labels")).alias("roundtrip"))


# ---------------------------------------------------------------- vectors and parameters

PAIR_SQL = """(SELECT a.vec_id // 2 AS pair_id, CAST(a.embedding AS DOUBLE[]) AS va, CAST(b.embedding AS DOUBLE[]) AS vb
   FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""


def _pairs(spark, sf):
    emb = read_table(spark, sf, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return emb.filter(F.col("vec_id") % 2 == 0), emb.filter(F.col("vec_id") % 2 == 1)


def _combine_sql(expr: str) -> str:
    return f"""
SELECT pair_id, CAST(len(c) AS BIGINT) AS n, round(list_sum(c), 4) AS total,
       round(list_sum(list_transform(c, lambda x, i: x * i)), 4) AS weighted
FROM (SELECT pair_id, {expr} AS c FROM {PAIR_SQL})"""


def _combine_out(df: DataFrame) -> DataFrame:
    c = F.col("combined")
    return df.select(F.col("pair_id"), F.size(c).cast("long").alias("n"),
                     F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"),
                     F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0),
                                         lambda acc, x: acc + x), 4).alias("weighted"))


for _how, _expr in (("mean", "list_transform(list_zip(va, vb), lambda p: (p[1] + p[2]) / 2)"),
                    ("add", "list_transform(list_zip(va, vb), lambda p: p[1] + p[2])"),
                    ("concat", "list_concat(va, vb)")):
    def _mk(how):
        def q(spark, sf):
            a, b = _pairs(spark, sf)
            return _combine_out(N.combine_vectors(a, b, "pair_id", how))
        return q
    register(f"combine_{_how}", _combine_sql(_expr))(_mk(_how))


@register("average_params", """
SELECT name, CAST(len(v) AS BIGINT) AS n, round(list_sum(v), 4) AS total FROM (
  SELECT 'p' || a.k AS name, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                                           lambda p: (p[1] + p[2]) / 2) AS v
  FROM (SELECT vec_id AS k, embedding FROM embeddings WHERE vec_id < (SELECT count(*) // 2 FROM embeddings)) a
  JOIN (SELECT vec_id - (SELECT count(*) // 2 FROM embeddings) AS k, embedding FROM embeddings
        WHERE vec_id >= (SELECT count(*) // 2 FROM embeddings)) b USING (k))""")
def average_params(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    half = emb.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")).scalar()
    e = emb.select("vec_id", half.alias("half"), F.col("embedding").cast("array<double>").alias("values"))
    a = e.filter(F.col("vec_id") < F.col("half")).select(F.concat(F.lit("p"), F.col("vec_id")).alias("name"), "values")
    b = e.filter(F.col("vec_id") >= F.col("half")).select(
        F.concat(F.lit("p"), (F.col("vec_id") - F.col("half"))).alias("name"), "values")
    avg = N.average_params(a, b)
    return avg.select("name", F.size("values").cast("long").alias("n"),
                      F.round(F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"))


# ---------------------------------------------------------------- run analytics (R*, P4)

RUNLOG_SQL = """runlog AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
                   'eval_loss' AS metric, value FROM events)"""


def runlog(spark, sf) -> DataFrame:
    """The events table as a run log: run = event_type, step = order in the run."""
    from tessera.operators.rowindex import with_group_index
    ev = read_table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    lg = with_group_index(ev, "event_type", ["ts", "event_id"], "step")
    return lg.select(F.col("event_type").alias("run"), "step", F.lit("eval_loss").alias("metric"), "value")


def _runs(final: str) -> str:
    return f"WITH {RUNLOG_SQL}\n{final}"


@register("log_steps", _runs("SELECT run, step, value FROM runlog WHERE step % 100 = 0"))
def log_steps(spark, sf):
    from tessera.operators.runs import on_logging_step
    return on_logging_step(runlog(spark, sf), 100).select("run", "step", "value")


BEST_SQL = """best AS (SELECT run, step AS best_step, value AS best_value FROM (
   SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value, step) AS rk FROM runlog) WHERE rk = 1)"""


@register("best_step", _runs(f", {BEST_SQL}\nSELECT run, best_step, best_value FROM best"))
def best_step(spark, sf):
    from tessera.operators.runs import best_step as bs
    return bs(runlog(spark, sf)).select("run", "best_step", "best_value")


@register("early_stop", _runs(f""", {BEST_SQL},
imp AS (SELECT run, step, value, coalesce(min(value) OVER (PARTITION BY run ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value > 0.0, true) AS improved FROM runlog),
grp AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run ORDER BY step) AS g FROM imp),
stk AS (SELECT *, sum(CAST(NOT improved AS INTEGER)) OVER (PARTITION BY run, g ORDER BY step) AS streak FROM grp)
SELECT s.run, s.stop_step, b.best_step, b.best_value
FROM (SELECT run, min(CASE WHEN streak >= 2 THEN step END) AS stop_step FROM stk GROUP BY run) s
JOIN (SELECT run, step AS best_step, value AS best_value FROM (
        SELECT r.run, r.step, r.value, row_number() OVER (PARTITION BY r.run ORDER BY r.value, r.step) AS rk
        FROM runlog r JOIN (SELECT run, min(CASE WHEN streak >= 2 THEN step END) AS stop_step FROM stk GROUP BY run) x
          USING (run)
        WHERE x.stop_step IS NULL OR r.step <= x.stop_step) WHERE rk = 1) b USING (run)"""))
def early_stop(spark, sf):
    from tessera.operators.runs import early_stop as es
    return es(runlog(spark, sf), patience=2, threshold=0.0).select("run", "stop_step", "best_step", "best_value")


@register("retain_checkpoints", _runs(f""", {BEST_SQL}
SELECT run, step, path, rank_newest FROM (
  SELECT r.run, r.step, 'checkpoint-' || r.step AS path,
         row_number() OVER (PARTITION BY r.run ORDER BY r.step DESC) AS rank_newest, b.best_step
  FROM runlog r JOIN best b USING (run))
WHERE rank_newest <= 5 OR step = best_step"""))
def retain_checkpoints(spark, sf):
    from tessera.operators.runs import best_step as bs, retain_checkpoints as rc
    lg = runlog(spark, sf)
    ck = lg.select("run", "step", F.concat(F.lit("checkpoint-"), F.col("step")).alias("path"))
    return rc(ck, 5, bs(lg)).select("run", "step", "path", F.col("rank_newest").cast("long").alias("rank_newest"))


@register("resume_point", _runs("""
SELECT run, 'checkpoint-' || max(step) AS last_checkpoint, max(step) AS last_step,
       'checkpoint-' || max(step) AS resume_from FROM runlog GROUP BY run"""))
def resume_point(spark, sf):
    from tessera.operators.runs import resume_point as rp
    lg = runlog(spark, sf)
    ck = lg.select("run", "step", F.concat(F.lit("checkpoint-"), F.col("step")).alias("path"))
    files = lg.select("run", F.concat(F.lit("events-"), F.col("step")).alias("file"))  # what the runs' folders hold besides
    return rp(ck, outputs=files).select("run", "last_checkpoint", "last_step", "resume_from")


@register("compare_runs", _runs("""
SELECT step, run, value, rank() OVER (PARTITION BY step ORDER BY value) AS rank FROM runlog"""))
def compare_runs(spark, sf):
    from tessera.operators.runs import compare_runs as cr
    return cr(runlog(spark, sf), "eval_loss").select("step", "run", "value", F.col("rank").cast("long").alias("rank"))


@register("grad_norms", """
SELECT run, step, name, round(sqrt(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda g: g * g)))), 6)
       AS grad_norm
FROM (SELECT 'run' || (label % 2) AS run, vec_id // 10 AS step, 'h.' || (vec_id % 3) || '.weight' AS name, embedding
      FROM embeddings) WHERE step % 5 = 0 GROUP BY ALL""")
def grad_norms(spark, sf):
    from tessera.operators.runs import grad_norms as gn
    emb = read_table(spark, sf, "embeddings")
    log = emb.select(F.concat(F.lit("run"), (F.col("label") % 2)).alias("run"),
                     F.floor(F.col("vec_id") / 10).alias("step"),
                     F.concat(F.lit("h."), (F.col("vec_id") % 3), F.lit(".weight")).alias("name"),
                     F.col("embedding").alias("grad"))
    return gn(log, every=5).select("run", "step", "name", r6("grad_norm").alias("grad_norm"))


INV_SQL = """inv AS (SELECT lower(replace(p_type, ' ', '.')) || '.w' || p_partkey AS name,
                 CAST(p_size AS BIGINT) * 1024 AS numel, p_retailprice < 1500 AS trainable,
                 CASE WHEN p_size < 20 THEN 'float32' WHEN p_size < 40 THEN 'bfloat16' ELSE 'float16' END AS dtype,
                 CASE WHEN p_size < 20 THEN 4 ELSE 2 END AS bytes_per_elem FROM part)"""


def inventory(spark, sf) -> DataFrame:
    """The part table as a parameter inventory (name, numel, trainable, dtype, bytes)."""
    p = read_table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.concat(F.lower(F.regexp_replace("p_type", " ", ".")), F.lit(".w"), F.col("p_partkey")).alias("name"),
        (size.cast("long") * 1024).alias("numel"), (F.col("p_retailprice") < 1500).alias("trainable"),
        F.when(size < 20, "float32").when(size < 40, "bfloat16").otherwise("float16").alias("dtype"),
        F.when(size < 20, 4).otherwise(2).alias("bytes_per_elem"))


@register("param_totals", f"""WITH {INV_SQL}
SELECT CAST(sum(numel) AS BIGINT) AS all_params,
       CAST(sum(CASE WHEN trainable THEN numel ELSE 0 END) AS BIGINT) AS trainable_params,
       round(100.0 * sum(CASE WHEN trainable THEN numel ELSE 0 END) / sum(numel), 6) AS trainable_pct FROM inv""")
def param_totals(spark, sf):
    from tessera.operators.runs import param_totals as pt
    return pt(inventory(spark, sf)).select("all_params", "trainable_params", r6("trainable_pct").alias("trainable_pct"))


@register("param_dtypes", f"""WITH {INV_SQL}
SELECT dtype, CAST(sum(numel) AS BIGINT) AS numel, round(sum(numel * bytes_per_elem) / 1073741824.0, 6) AS memory_gb
FROM inv GROUP BY dtype""")
def param_dtypes(spark, sf):
    from tessera.operators.runs import param_dtypes as pd_
    return pd_(inventory(spark, sf)).select("dtype", "numel", r6("memory_gb").alias("memory_gb"))


@register("param_layers", f"""WITH {INV_SQL}
SELECT split_part(name, '.', 1) AS layer,
       CAST(sum(CASE WHEN trainable THEN numel ELSE 0 END) AS BIGINT) AS trainable,
       CAST(sum(CASE WHEN NOT trainable THEN numel ELSE 0 END) AS BIGINT) AS non_trainable,
       sum(CASE WHEN trainable THEN numel ELSE 0 END) = 0 AS frozen
FROM inv GROUP BY 1""")
def param_layers(spark, sf):
    from tessera.operators.runs import param_layers as pl
    return pl(inventory(spark, sf))


@register("parse_overrides", """
SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS "user", CAST(json_extract(props, '$.k') AS VARCHAR) AS k
FROM events""")
def parse_overrides(spark, sf):
    from tessera.operators.runs import parse_overrides as po
    ev = read_table(spark, sf, "events")
    s = F.concat_ws(",", F.concat(F.lit("type="), "event_type"), F.concat(F.lit("user="), "user_id"),
                    F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    m = ev.select("event_id", po(s).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("type")).alias("type"),
                    F.try_element_at("m", F.lit("user")).alias("user"),
                    F.try_element_at("m", F.lit("k")).alias("k"))


# ---------------------------------------------------------------- sinks round trips

@register("write_packed_roundtrip", O.with_corpus(PACK_OUT))
def write_packed_roundtrip(spark, sf):
    from tessera.sources.packed import read_packed, write_packed
    root = scratch_path(spark, "published")
    write_packed(CorpusPlan(spark, sf).packed, root, "documents", SPEC.block_size)
    return _pack_out(read_packed(spark, root, "documents", SPEC.block_size))


@register("read_packed", O.with_corpus(PACK_OUT + " WHERE split = 'validation'"))
def read_packed_q(spark, sf):
    from tessera.sources.packed import build_or_read, read_packed
    root = scratch_path(spark, "published")
    build_or_read(spark, root, "documents", SPEC.block_size, lambda: CorpusPlan(spark, sf).packed,
                  block_size=SPEC.block_size)
    return _pack_out(read_packed(spark, root, "documents", SPEC.block_size, "validation"))


def _no_build() -> DataFrame:
    raise AssertionError("a published dataset is read, not built again")


@register("build_or_read", O.with_corpus(PACK_OUT))
def build_or_read_q(spark, sf):
    """Build, replace on ``overwrite``, then reuse: what is returned was read, not built."""
    from tessera.sources.packed import build_or_read
    cp, root = CorpusPlan(spark, sf), scratch_path(spark, "published")
    args = (spark, root, "documents", SPEC.block_size)
    build_or_read(*args, lambda: cp.packed.filter(F.col("split") == "validation"))
    build_or_read(*args, lambda: cp.packed, overwrite=True)
    return _pack_out(build_or_read(*args, _no_build))


@register("require_split", O.with_corpus(PACK_OUT + " WHERE split = 'train'"))
def require_split_q(spark, sf):
    """The split's blocks, after the test that there are any."""
    from tessera.sources.packed import read_packed, require_split
    cp = CorpusPlan(spark, sf)
    published = read_packed(spark, cp.published, cp.spec.table, SPEC.block_size)
    return _pack_out(require_split(published, "train").filter(F.col("split") == "train"))


@register("metrics_sink", EVAL_SQL)
def metrics_sink(spark, sf):
    from tessera.sources.packed import write_metrics
    path = scratch_path(spark, "metrics")
    write_metrics(_evaluate(spark, sf), path, run="documents-bigram", phase="eval", fmt="parquet")
    return spark.read.parquet(path).select("accuracy", "loss", "perplexity", "bleu", "eval_samples")


# ---------------------------------------------------------------- streaming

def _doc_stream(spark, sf):
    from tessera.streaming.stream import stream_corpus
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # a glob (not a single file) so each micro-batch can be re-planned by later jobs
    return stream_corpus(spark, f"{sf}/documents*.parquet", schema).select("doc_id", "text")


def _stream_encoded(spark, sf, cp: CorpusPlan):
    from tessera.streaming.stream import stream_encode
    return stream_encode(_doc_stream(spark, sf), cp.vocab, cp.vocab_table, ["doc_id"])


@register("stream_tokenize", O.with_corpus(f"""
SELECT doc_id, CAST(len(input_ids) AS BIGINT) AS n_tokens, {md5_sql('input_ids')} AS ids_md5 FROM enc"""))
def stream_tokenize(spark, sf):
    from tessera.streaming.stream import run_to_table
    cp = CorpusPlan(spark, sf)
    out, ck = scratch_path(spark, "stream-enc"), scratch_path(spark, "stream-enc-ck")
    run_to_table(_stream_encoded(spark, sf, cp), out, ck)
    df = spark.read.parquet(out)
    return df.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), md5_ids("input_ids").alias("ids_md5"))


@register("stream_pack", O.with_corpus(f"""
SELECT CAST(0 AS BIGINT) AS batch_id, block_no, CAST(len(ids) AS BIGINT) AS n_tokens, {md5_sql('ids')} AS ids_md5
FROM (SELECT p // {SPEC.block_size} AS block_no, list(id ORDER BY p) AS ids FROM (
        SELECT off + pos - 1 AS p, id, total FROM (
          SELECT off, total, unnest(input_ids) AS id, generate_subscripts(input_ids, 1) AS pos FROM (
            SELECT input_ids,
                   CAST(sum(len(input_ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                        AS BIGINT) - len(input_ids) AS off,
                   CAST(sum(len(input_ids)) OVER () AS BIGINT) AS total FROM enc)))
      WHERE total < {SPEC.block_size} OR (p // {SPEC.block_size} + 1) * {SPEC.block_size} <= total
      GROUP BY 1)"""))
def stream_pack(spark, sf):
    from tessera.streaming.stream import pack_micro_batches
    cp = CorpusPlan(spark, sf)
    out, ck = scratch_path(spark, "stream-pack"), scratch_path(spark, "stream-pack-ck")
    pack_micro_batches(_stream_encoded(spark, sf, cp), SPEC.block_size, "doc_id", out, ck)
    df = spark.read.parquet(out)
    return df.select("batch_id", "block_no", F.size("input_ids").cast("long").alias("n_tokens"),
                     md5_ids("input_ids").alias("ids_md5"))


CARRY_SHARDS = 64


@register("stream_pack_carry", O.with_corpus(f"""
SELECT shard, p // {SPEC.block_size} AS seq, count(*) AS n_tokens,
       md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY p)) AS ids_md5
FROM (SELECT shard, total, off + pos - 1 AS p, id FROM (
        SELECT shard, off, total, unnest(input_ids) AS id, generate_subscripts(input_ids, 1) AS pos FROM (
          SELECT shard, input_ids, CAST(sum(len(input_ids)) OVER (PARTITION BY shard) AS BIGINT) AS total,
                 CAST(sum(len(input_ids)) OVER (PARTITION BY shard ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
                   - len(input_ids) AS off
          FROM (SELECT doc_id, input_ids,
                       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {CARRY_SHARDS} AS shard
                FROM enc))))
WHERE (p // {SPEC.block_size} + 1) * {SPEC.block_size} <= total
GROUP BY 1, 2"""))
def stream_pack_carry(spark, sf):
    from tessera.streaming.stream import pack_with_carry, run_to_table, shard_of
    cp = CorpusPlan(spark, sf)
    enc = _stream_encoded(spark, sf, cp).withColumn("shard", shard_of("doc_id", CARRY_SHARDS))
    out, ck = scratch_path(spark, "stream-carry"), scratch_path(spark, "stream-carry-ck")
    run_to_table(pack_with_carry(enc, SPEC.block_size, "doc_id"), out, ck)
    df = spark.read.parquet(out)
    return df.select("shard", "seq", F.size("input_ids").cast("long").alias("n_tokens"),
                     md5_ids("input_ids").alias("ids_md5"))


# ---------------------------------------------------------------- BPE merges (T2b), user scorer

def _bpe_merges(cp: CorpusPlan) -> tuple[DataFrame, DataFrame]:
    """The train split's word counts, and up to ``bpe_merges`` merges, whatever its alphabet."""
    from tessera.operators.bpe import learn_bpe as lb, word_counts
    from tessera.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(cp.spark)
    words = word_counts(cp.train_tokens).checkpoint()  # read by several jobs
    return words, lb(words, cp.spec.bpe_merges)


@register("learn_bpe")
def learn_bpe(spark, sf):
    return _bpe_merges(CorpusPlan(spark, sf))[1]


def _unigram_logp(pdf, table):
    import numpy as np
    counts, total, v = table
    n = pdf["input_ids"].map(len).to_numpy("int64")
    flat = np.concatenate([*pdf["input_ids"], np.zeros(0, "int64")]).astype("int64")
    sums = np.concatenate([[0.0], np.cumsum(np.log((counts[flat] + 1.0) / (total + v)))])
    ends = np.cumsum(n)
    return pdf.assign(n=n, logp=sums[ends] - sums[ends - n]).drop(columns=["input_ids"])


@register("score_udf", O.with_corpus("""
SELECT batch_id, block_no, CAST(count(*) AS BIGINT) AS n,
       round(sum(ln((coalesce(u.c, 0) + 1.0) / ((SELECT count(*) FROM tr) + (SELECT v FROM vsize)))), 6) AS logp
FROM (SELECT batch_id, block_no, unnest(input_ids) AS id FROM packed WHERE split = 'validation') x
LEFT JOIN (SELECT id, count(*) AS c FROM tr GROUP BY id) u USING (id)
GROUP BY ALL""", "tr AS (SELECT unnest(input_ids) AS id FROM packed WHERE split = 'train')"))
def score_udf(spark, sf):
    import numpy as np
    cp = CorpusPlan(spark, sf)
    train = cp.blocks("train")
    # per-id counts: one row per id, bounded by the vocabulary size
    c = train.select(F.explode("input_ids").alias("id")).groupBy("id").count().toArrow()
    v = cp.vocab_rows
    counts = np.zeros(v, dtype=np.float64)
    counts[np.asarray(c.column("id").to_pylist(), dtype=np.int64)] = c.column("count").to_pylist()
    scored = N.score_with(cp.blocks("validation").select(*BLOCK_KEYS, "input_ids"), _unigram_logp,
                          "batch_id long, block_no long, n long, logp double",
                          (counts, float(counts.sum()), float(v)))
    return scored.select(*BLOCK_KEYS, "n", r6("logp").alias("logp"))


# ---------------------------------------------------------------- config parsing on a JSON column

@register("config_scan", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(len(list_filter(json_keys(props), lambda x: x <> 'k')) AS BIGINT) AS n_unknown,
       array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') AS unknown
FROM events""")
def config_scan(spark, sf):
    from pyspark.sql import types as T
    from tessera.operators.runs import parse_configs
    ev = read_table(spark, sf, "events")
    schema = T.StructType([T.StructField("k", T.LongType())])
    cfg = parse_configs(ev, "props", schema, keep=["event_id"])
    return cfg.select("event_id", "k", F.size("unknown_keys").cast("long").alias("n_unknown"),
                      F.array_join("unknown_keys", ",").alias("unknown"))


def _supplier_configs(spark, sf: str) -> str:
    """Run configs as JSON, one a supplier, many to a file; returns their folder."""
    from tessera.operators.runs import RECORD_MARK
    path = scratch_path(spark, "configs")
    s = read_table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    made = F.to_json(F.struct(
        F.concat(F.lit("run-"), key).alias("run_name"), F.col("s_nationkey").cast("long").alias("seed"),
        (F.lit(128) * (1 + key % 3)).cast("long").alias("block_size"), (key % 2 == 0).alias("bf16"),
        F.when(key % 3 == 0, F.concat(F.lit("head-"), F.col("s_nationkey"))).alias("rotatinghead")))  # a null key is left out
    s.select(made.alias("value")).write.mode("overwrite").text(path, lineSep=RECORD_MARK)
    return path


@register("config_diff", """
WITH cfg AS (SELECT s_suppkey AS k, 'run-' || s_suppkey AS run_name, CAST(s_nationkey AS VARCHAR) AS seed,
                    CAST(128 * (1 + s_suppkey % 3) AS VARCHAR) AS block_size, CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS bf16,
                    CASE WHEN s_suppkey % 3 = 0 THEN 'head-' || s_nationkey END AS rotatinghead FROM supplier),
long AS (SELECT run_name, 'seed' AS key, seed AS value FROM cfg UNION ALL SELECT run_name, 'block_size', block_size FROM cfg
         UNION ALL SELECT run_name, 'bf16', bf16 FROM cfg UNION ALL SELECT run_name, 'rotatinghead', rotatinghead FROM cfg)
SELECT l.key, l.run_name, l.value, b.value AS baseline FROM long l JOIN long b ON b.key = l.key AND b.run_name = 'run-1'
WHERE l.run_name <> 'run-1' AND l.value IS DISTINCT FROM b.value""")
def config_diff(spark, sf):
    """Configs read whole from their files and compared with a baseline's, keys outside the schema too."""
    from tessera.operators.runs import config_diff as cd, read_configs
    return cd(read_configs(spark, _supplier_configs(spark, sf), many=True), "run-1")


@register("pack_udtf", O.with_corpus(PACK_OUT))
def pack_udtf(spark, sf):
    """UDF surface, a map that changes the number of rows: packing by a user's class over ordered batches."""
    from tessera.operators.usermap import map_ordered, packer
    cp = CorpusPlan(spark, sf)
    rows = L.map_batches(cp.placed_ids, SPEC.batch_rows, "split_idx").select("split", "batch_id", "split_idx", "input_ids")
    packed = map_ordered(rows, packer(SPEC.block_size, ["split", "batch_id"]), "split string, batch_id long, block_no long, input_ids array<int>",
                         ["split", "batch_id"], ["split_idx"])
    return _pack_out(packed)


@register("shard_batches", """
WITH ix AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
per AS (SELECT *, (n + 6) // 7 AS per FROM ix)
SELECT doc_id, idx, idx // per AS shard, (idx // per) * ((per + 63) // 64) + (idx % per) // 64 AS batch_id FROM per""")
def shard_batches(spark, sf):
    """B1 with worker shards: contiguous shards, batches restart in each."""
    ix = L.with_row_index(read_table(spark, sf, "documents").select("doc_id"), "doc_id")
    return L.map_batches(ix, 64, shards=7).select("doc_id", "idx", "shard", "batch_id")


@register("pin_docs", """
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def pin_docs(spark, sf):
    """The corpus pinned in memory (spilling to disk), then read."""
    from tessera.sources.corpus import pin
    docs = pin(read_table(spark, sf, "documents").select("lang", "text"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


# ---------------------------------------------------------------- user metric hook (E8 / UDF surface)

def _median(v):
    return float(v.median())


@register("user_metric", O.with_corpus("""
SELECT batch_id, round(median(loss), 6) AS median_loss FROM scored GROUP BY batch_id"""))
def user_metric(spark, sf):
    s = CorpusPlan(spark, sf).scored
    m = E.user_metric(s, ["batch_id"], _median, "loss", "median_loss")
    return m.select("batch_id", r6("median_loss").alias("median_loss"))


@register("encode_bpe")
def encode_bpe(spark, sf):
    """T3(b): sub-word ids from BPE merges learned on the train split."""
    from tessera.operators.bpe import bpe_vocab, encode_bpe as enc
    cp = CorpusPlan(spark, sf)
    words, merges = _bpe_merges(cp)
    out = enc(cp.tokens, merges, bpe_vocab(words, merges), keep=["doc_id"])
    return out.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"),
                      md5_ids("input_ids").alias("ids_md5"))
