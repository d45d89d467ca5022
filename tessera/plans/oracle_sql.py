"""DuckDB SQL for the independent oracle of every registered query.

The SQL is written token-level (unnest with positions, window sums), the
opposite of the Spark plans which never explode to tokens where they can avoid
it -- so the two agree only if both are right.

DuckDB notes: RE2 has no look-ahead, so the GPT-2 split is reproduced by
cutting the text before the last character of every whitespace run that is
followed by a non-space and splitting each piece with the look-ahead-free
pattern; whitespace is the explicit class of Unicode's White_Space characters.
"""

from __future__ import annotations

from tessera.constants import EOS_TOKEN, MASK_TOKEN, UNK_TOKEN
from tessera.plans.corpus import SPEC, CorpusSpec

SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACES}]"
NWS = f"[^{SPACES}]"
SPLIT_RE2 = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + SPACES + r"\p{L}\p{N}]+|" + WS + "+"
CUT = "\ue000"  # private-use character, absent from any corpus text


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens_expr(text: str) -> str:
    cut = f"regexp_replace({text}, {q('(' + WS + '+)(' + WS + ')(' + NWS + ')')}, {q(chr(92) + '1' + CUT + chr(92) + '2' + chr(92) + '3')}, 'g')"
    return (f"flatten(list_transform(string_split({cut}, {q(CUT)}), "
            f"lambda s: regexp_extract_all(s, {q(SPLIT_RE2)})))")


def half_even_boundary(n: str, p: int) -> str:
    """round-half-even(n·p/100) in exact integer arithmetic."""
    num = f"({n} * {int(p)})"
    qq, r = f"({num} // 100)", f"({num} % 100)"
    return (f"(CASE WHEN 2 * {r} > 100 THEN {qq} + 1 WHEN 2 * {r} = 100 THEN {qq} + ({qq} % 2) "
            f"ELSE {qq} END)")


def corpus_ctes(spec: CorpusSpec = SPEC) -> str:
    bs, rows, V = spec.block_size, spec.batch_rows, spec.vocab_size
    o = spec.order_col
    return f"""
docs AS (SELECT {o}, text FROM {spec.table}),
ix AS (SELECT {o}, text, row_number() OVER (ORDER BY {o}) - 1 AS idx,
              count(*) OVER () AS n_rows FROM docs),
sp AS (SELECT {o}, text, idx, {half_even_boundary('n_rows', spec.validation_percent)} AS b FROM ix),
sp2 AS (SELECT {o}, text, idx,
               CASE WHEN idx < b THEN 'validation' ELSE 'train' END AS split,
               CASE WHEN idx < b THEN idx ELSE idx - b END AS split_idx FROM sp),
tok AS (SELECT {o}, idx, split, split_idx, {tokens_expr('text')} AS tokens FROM sp2),
cnt AS (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM tok WHERE split = 'train')
        GROUP BY token),
reg AS (SELECT * FROM (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token ASC) - 1 AS INTEGER)
                              AS token_id, freq, false AS is_special FROM cnt) WHERE token_id < {V}),
nreg AS (SELECT CAST(count(*) AS INTEGER) AS n FROM reg),
vocab0 AS (SELECT * FROM reg
           UNION ALL SELECT {q(UNK_TOKEN)}, n, 0, true FROM nreg
           UNION ALL SELECT {q(EOS_TOKEN)}, n + 1, 0, true FROM nreg),
vocab AS (SELECT * FROM vocab0
          UNION ALL SELECT {q(MASK_TOKEN)}, (SELECT max(token_id) + 1 FROM vocab0), 0, true),
vsize AS (SELECT count(*) AS v FROM vocab),
unk AS (SELECT token_id AS unk_id FROM vocab WHERE token = {q(UNK_TOKEN)}),
tpos AS (SELECT {o}, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tok),
encl AS (SELECT {o}, list(coalesce(v.token_id, (SELECT unk_id FROM unk)) ORDER BY pos) AS ids,
                count(*) FILTER (WHERE v.token_id IS NULL) AS n_unk
         FROM tpos LEFT JOIN vocab v USING (token) GROUP BY {o}),
enc AS (SELECT t.{o}, t.idx, t.split, t.split_idx, coalesce(e.ids, []::INTEGER[]) AS input_ids,
               coalesce(e.n_unk, 0) AS n_unk
        FROM tok t LEFT JOIN encl e USING ({o})),
pk0 AS (SELECT split, split_idx, input_ids, len(input_ids) AS n, split_idx // {rows} AS batch_id FROM enc),
pk1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY split, batch_id ORDER BY split_idx
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS off,
               CAST(sum(n) OVER (PARTITION BY split, batch_id) AS BIGINT) AS total FROM pk0),
pk2 AS (SELECT split, batch_id, total, off + pos - 1 AS p, id
        FROM (SELECT split, batch_id, total, off, unnest(input_ids) AS id,
                     generate_subscripts(input_ids, 1) AS pos FROM pk1)),
pk3 AS (SELECT split, batch_id, p // {bs} AS block_no, p, id FROM pk2
        WHERE total < {bs} OR (p // {bs} + 1) * {bs} <= total),
packed AS (SELECT split, batch_id, block_no, list(id ORDER BY p) AS input_ids FROM pk3 GROUP BY ALL),
trp AS (SELECT input_ids AS ids FROM packed WHERE split = 'train'),
bg AS (SELECT prev_id, next_id, count(*) AS n FROM
         (SELECT ids[i] AS prev_id, ids[i + 1] AS next_id
          FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM trp)) GROUP BY ALL),
st AS (SELECT prev_id, prev_total, next_id AS top_next FROM
         (SELECT prev_id, next_id, n, sum(n) OVER (PARTITION BY prev_id) AS prev_total,
                 row_number() OVER (PARTITION BY prev_id ORDER BY n DESC, next_id ASC) AS rk FROM bg)
       WHERE rk = 1),
fb AS (SELECT id AS fallback_id FROM (SELECT unnest(ids) AS id FROM trp) GROUP BY id
       ORDER BY count(*) DESC, id ASC LIMIT 1),
va AS (SELECT batch_id, block_no, input_ids AS ids FROM packed WHERE split = 'validation'),
vx AS (SELECT batch_id, block_no, i - 1 AS pos, ids[i] AS cur,
              CASE WHEN i < len(ids) THEN ids[i + 1] END AS nxt
       FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM va)),
sc AS (SELECT vx.batch_id, vx.block_no, vx.pos, vx.cur, coalesce(st.top_next, fb.fallback_id) AS pred,
              CASE WHEN vx.nxt IS NOT NULL THEN
                -ln((coalesce(bg.n, 0) + {spec.add_k}) / (coalesce(st.prev_total, 0) + {spec.add_k} * vsize.v))
              END AS nll
       FROM vx LEFT JOIN st ON st.prev_id = vx.cur
               LEFT JOIN bg ON bg.prev_id = vx.cur AND bg.next_id = vx.nxt
               CROSS JOIN fb CROSS JOIN vsize),
scored AS (SELECT batch_id, block_no, list(cur ORDER BY pos) AS labels, list(pred ORDER BY pos) AS pred,
                  avg(nll) AS loss, count(nll) AS n_pairs FROM sc GROUP BY ALL)"""


def with_corpus(final: str, extra: str = "", spec: CorpusSpec = SPEC) -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {corpus_ctes(spec)}{more}\n{final}"


def bleu_ctes(src: str, keys: str, hyp: str = "pred", ref: str = "labels", max_n: int = 4,
              eps: float = 0.1) -> str:
    """Sentence BLEU per row of ``src`` (columns keys…, hyp, ref) → CTE ``bleu_rows``."""
    ms = ",\n       ".join(
        f"coalesce(sum(CASE WHEN n = {k} THEN least(ch, cr) END), 0) AS m{k}" for k in range(1, max_n + 1))
    logs = " + ".join(
        f"ln((CASE WHEN coalesce(m{k}, 0) > 0 THEN m{k} ELSE {eps} END) / greatest(c - {k} + 1, 1))"
        for k in range(1, max_n + 1))
    kl = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    using = keys
    return f"""
bsrc AS (SELECT {keys}, {hyp} AS h, {ref} AS r FROM {src}),
bgram AS (
  SELECT {keys}, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: h[i:i + n - 1])) AS g,
         1 AS hc, 0 AS rc FROM (SELECT *, unnest(range(1, {max_n + 1})) AS n FROM bsrc)
  UNION ALL
  SELECT {keys}, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: r[i:i + n - 1])) AS g,
         0 AS hc, 1 AS rc FROM (SELECT *, unnest(range(1, {max_n + 1})) AS n FROM bsrc)),
bcnt AS (SELECT {keys}, n, g, sum(hc) AS ch, sum(rc) AS cr FROM bgram GROUP BY ALL),
bm AS (SELECT {keys}, {ms} FROM bcnt GROUP BY ALL),
bj AS (SELECT {kl}, len(b.h) AS c, len(b.r) AS rl, m.* EXCLUDE ({keys})
       FROM bsrc b LEFT JOIN bm m USING ({using})),
bleu_rows AS (SELECT {keys},
  CASE WHEN coalesce(m1, 0) = 0 THEN 0.0
       ELSE (CASE WHEN c > rl THEN 1.0 WHEN c = 0 THEN 0.0 ELSE exp(1 - rl / c) END)
            * exp(({logs}) / {max_n}) END AS bleu
  FROM bj)"""
