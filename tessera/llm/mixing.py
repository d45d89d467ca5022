"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks: block = hash(document key) mod the source's number
of blocks, so a block is a random part of its source, and a source of any size
has at most ``BLOCKS`` of them.  A source that needs ``t`` words of its ``S``
takes whole passes over all blocks (``floor(t / S)``) and a partial pass over
a prefix of its permuted blocks; inside the block where the prefix ends,
documents in hash order fill the rest.

Every block drawn is a unit.  The tree splits the units of all sources among
the output shards: a node's units are permuted and cut in half, and the
number of each source's units in the left half then is a draw from the
multivariate hypergeometric law with exact marginals, level by level.  The
leaves give each shard exact block quotas by source.  Shards then draw their
quotas from each source's permuted blocks (consecutive, so disjoint within a
pass), and rows are shuffled within a shard by a hash key.

Scale: sizes are summed with map-side combine.  The block tables hold at most
``2 * BLOCKS`` plus two rows a source, whatever the corpus; the per-document
work is one broadcast-size lookup and no shuffle of documents.  A hot source
is cut into as many blocks as its share asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import publish

WORD = r"[^\x20\x09-\x0D]+"  # a word of the size measure
WEIGHTS = (5.0, 2.0, 1.0)  # repeated over the sources in code-point order, null last
SHARE = 1.5  # words of the mix as a part of all words
MAX_REPEAT = 2.0  # a target's cap as a multiple of its source's size
BLOCKS = 4096  # blocks of the whole corpus, about
SHARD_LEVELS = 4  # the tree has 2**SHARD_LEVELS leaves (output shards)
MAX_BROADCAST_ROWS = 100_000
SEED = "mix-1"


def draw_key(*parts: Column) -> Column:
    """Reproducible pseudo-random order key: an md5 over the seed and the parts.

    A string key, so that plain SQL engines can repeat the draw.
    """
    return F.md5(F.concat_ws("/", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def draw_block(key: Column, n_blocks: Column) -> Column:
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % n_blocks


def sizes(docs: DataFrame) -> DataFrame:
    """Words of each document (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def targets(by_source: DataFrame, share: float = SHARE, max_repeat: float = MAX_REPEAT,
            weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target words of each source from ``(source, source_size)``.

    ``share`` of all words is dealt by weight; a target stops at ``max_repeat``
    times its source's size and the excess is dealt again among the others by
    weight.  That fixed point is a water level: in order of cap / weight, the
    sources below the level are capped and the rest share what is left.
    The table has a row a source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % n
    w = F.lit(float(weights[-1]))
    for i in reversed(range(n - 1)):
        w = F.when(pos == i, F.lit(float(weights[i]))).otherwise(w)
    t = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("pool") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(after))
    # the first source (in this order) whose cap is above its part sets the level of all after it
    t = t.withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
    t = t.withColumn("water", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    part = F.col("weight") * F.col("water")
    return t.select("source", "source_size", "weight",
                    F.when(F.col("water").isNull() | (F.col("cap") <= part), F.col("cap")).otherwise(part).alias("target"))


def split_tree(units: DataFrame, levels: int = SHARD_LEVELS) -> DataFrame:
    """Deal units ``(source, unit)`` to ``2**levels`` shards, half of each node's to either side.

    Adds ``shard``.  Counts by source in a half follow the multivariate
    hypergeometric law; halves differ by one unit at most.
    """
    units = units.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        key = draw_key(F.lit(f"tree{level}"), F.col("shard"), F.col("source"), F.col("unit"))
        rank = F.row_number().over(node.orderBy(key, F.col("source"), F.col("unit")))
        units = units.withColumn("rank", rank).withColumn("of", F.count(F.lit(1)).over(node))
        units = units.withColumn("shard", F.col("shard") * 2 + (F.col("rank") * 2 > F.col("of")).cast("int")).drop("rank", "of")
    return units


def plan(docs: DataFrame, levels: int = SHARD_LEVELS, share: float = SHARE, max_repeat: float = MAX_REPEAT,
         weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Block table of the mix: ``source, n_blocks, block, source_size, target, draws, edge_key``.

    ``draws`` lists ``(pass, shard, whole)`` for each time the block is drawn.
    ``edge_key`` is the last document key taken where a partial pass ends.
    """
    small = publish(sizes(docs).select("doc_id", "source", "size"), "mix-sizes")
    by_source = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(by_source, share, max_repeat, weights)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = F.col("source_size") / F.sum("source_size").over(everything)
    t = t.withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.coalesce(F.ceil(part * F.lit(float(BLOCKS))), F.lit(1).cast("long"))))
    t = publish(t, "mix-sources")
    keyed = _lookup(small, t.drop("weight", "target", "source_size"), ["source"]).withColumn("key", draw_key(F.col("doc_id")))
    keyed = keyed.withColumn("block", draw_block(F.col("key"), F.col("n_blocks")))
    b = keyed.groupBy("source", "block").agg(F.sum("size").alias("block_size")).join(
        t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy(draw_key(F.lit("block"), F.col("source"), F.col("block")), "block")
    b = b.withColumn("upto", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = b.withColumn("before", F.col("upto") - F.col("block_size")).withColumn("place", F.row_number().over(order))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    b = b.withColumn("passes", passes.cast("int"))
    b = b.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    b = publish(b, "mix-blocks")
    # where the partial pass ends: documents of that one block in key order, while they come nearer to the target
    edge = b.where((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
    inner = Window.partitionBy("source").orderBy("key", "doc_id")
    last = _lookup(keyed, edge.select("source", "block", "before", "rest"), ["source", "block"], "inner")
    run = F.sum("size").over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    group = F.sum("size").over(Window.partitionBy("source", "key"))
    last = last.withColumn("run", run).withColumn("group", group)
    last = last.where(F.col("before") + F.col("run") - F.col("group") / 2 <= F.col("rest"))
    last = last.groupBy("source").agg(F.max("key").alias("edge_key")).withColumnRenamed("source", "s")
    b = b.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    b = b.withColumn("edge_key", F.when((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")),
                                        F.coalesce("edge_key", F.lit(""))))
    n_draws = F.col("passes") + (F.col("before") < F.col("rest")).cast("int")
    u = b.withColumn("n_draws", n_draws).where("n_draws > 0").select(
        "source", "block", "place", "passes", F.posexplode(F.sequence(F.lit(1), F.col("n_draws"))).alias("pass", "_"))
    # quotas: anonymous units through the tree; then each shard takes its quota of the permuted blocks
    nth = Window.partitionBy("source").orderBy("pass", "place")
    u = u.withColumn("unit", F.row_number().over(nth)).withColumn("whole", F.col("pass") < F.col("passes"))
    quota = split_tree(u.select("source", "unit"), levels)
    nth_quota = Window.partitionBy("source").orderBy("shard", "unit")
    quota = quota.withColumn("n", F.row_number().over(nth_quota)).select(F.col("source").alias("s"), "shard", "n")
    drawn = u.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("n"))).groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", "whole"))).alias("draws"))
    drawn = drawn.select(F.col("source").alias("s"), F.col("block").alias("k"), "draws")
    return publish(b.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")), "left").select(
        "source", "n_blocks", "block", "source_size", "target", "draws", "edge_key"), "mix-plan")


def _lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table of block or source rows; broadcast only up to ``MAX_BROADCAST_ROWS``, else AQE's skew-splitting join."""
    names = {k: f"_{k}" for k in keys}
    small = small.withColumnsRenamed(names)
    if small.count() <= MAX_BROADCAST_ROWS:
        small = F.broadcast(small)
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(small, cond, how).drop(*names.values())


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _struct(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).alias("none"))


def assign(docs: DataFrame, levels: int = SHARD_LEVELS, share: float = SHARE, max_repeat: float = MAX_REPEAT,
           weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target`` and ``mix_copies``: an array of ``(pass, shard)``.

    Null text has size 0, a null source is a source of its own that sorts
    last, a null ``doc_id`` is one more key; rows of equal ``doc_id`` and
    source are taken together.  A source of no words has target 0.  Empty
    tables give no rows.  Other columns pass through untouched, whatever their
    names; one that bears a name of the four above gives way to the result's.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    own = [c for c in columns if c not in ("doc_id", "source", "text")]
    p = plan(docs, levels, share, max_repeat, weights)
    src = p.select("source", "n_blocks").distinct()
    rows = _lookup(sizes(docs.select("doc_id", "source", "text", _struct(own).alias("rest"))), src, ["source"])
    rows = rows.withColumn("key", draw_key(F.col("doc_id")))
    rows = rows.withColumn("block", draw_block(F.col("key"), F.col("n_blocks"))).drop("n_blocks")
    rows = _lookup(rows, p.drop("n_blocks"), ["source", "block"])
    taken = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,whole:boolean>>")),
                     lambda d: d["whole"] | F.col("edge_key").isNull() | (F.col("key") <= F.col("edge_key")))
    copies = F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    return rows.select(*[F.col("rest").getField(c).alias(c) if c in own else F.col(c) for c in columns], F.col("size").alias("mix_size"),
                       F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is drawn, plus ``shard`` order in ``mix_shard, mix_order``.

    Nulls, repeats and empty tables as in ``assign``; columns of ``docs`` with one of these two names, or of those
    that ``assign`` adds, are left out.
    """
    columns = [c for c in docs.columns if c not in (*ADDED, "mix_shard", "mix_order")]
    rows = assign(docs.select(*[F.col(f"`{c}`") for c in columns]), **options)
    rows = rows.select(_struct(columns).alias("row"), F.inline("mix_copies"))
    order = draw_key(F.lit("row"), F.col("pass"), F.col("row.doc_id"))
    return rows.select("row.*", F.col("shard").alias("mix_shard"), order.alias("mix_order"))


def shuffled(mix: DataFrame) -> DataFrame:
    """Rows of the mix in shard order, shuffled within a shard, as a range-partitioned sort."""
    return mix.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``documents``, and ``shards``: the ``pass:shard`` of each
    time it is drawn, as the splitting tree deals them, joined by commas (empty if never drawn).  Nulls as in ``assign``."""
    from tessera.llm.common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return report(assign(docs))


def report(rows: DataFrame) -> DataFrame:
    """The columns of the query from those of ``assign``."""
    dealt = F.transform("mix_copies", lambda c: F.concat(c["pass"].cast("string"), F.lit(":"), c["shard"].cast("string")))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                       F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_copies")).alias("taken"),
                       F.concat_ws(",", dealt).alias("shards"))


def _tree_sql(levels: int = SHARD_LEVELS) -> str:
    """The splitting tree's levels, a CTE each: ``t0`` … ``t{levels}`` of ``(source, unit, shard)``."""
    out = ["t0 AS (SELECT source, unit, 0 AS shard FROM u)"]
    for n in range(levels):
        key = f"md5('mix-1/tree{n}/' || shard::VARCHAR || '/' || coalesce(source, 'null') || '/' || unit::VARCHAR)"
        out.append(f"""t{n + 1} AS (SELECT source, unit, shard * 2 + CASE WHEN rank * 2 > n_node THEN 1 ELSE 0 END AS shard FROM (
  SELECT source, unit, shard, count(*) OVER (PARTITION BY shard) AS n_node,
    row_number() OVER (PARTITION BY shard ORDER BY {key}, source, unit) AS rank FROM t{n}))""")
    return ",\n".join(out)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS pool, (sum(source_size) OVER ())::BIGINT AS total FROM s0),
s2 AS (SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, first_value(CASE WHEN cap > weight * level THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM s2),
s AS (SELECT source, source_size, CASE WHEN water IS NULL OR cap <= weight * water THEN cap ELSE weight * water END AS target,
  greatest(1, coalesce(ceil(source_size::DOUBLE / nullif(total, 0)::DOUBLE * 4096.0::DOUBLE), 1))::BIGINT AS n_blocks FROM s3),
k AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, md5('mix-1/' || coalesce(d.doc_id::VARCHAR, 'null')) AS key, s.n_blocks FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
kb AS (SELECT *, ('0x' || substr(key, 1, 12))::BIGINT % n_blocks AS block FROM k),
b0 AS (SELECT source, block, sum(size)::BIGINT AS block_size, any_value(source_size) AS source_size, any_value(target) AS target FROM kb GROUP BY source, block),
b1 AS (SELECT *, (sum(block_size) OVER (PARTITION BY source ORDER BY md5('mix-1/block/' || coalesce(source, 'null') || '/' || block::VARCHAR), block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto,
  row_number() OVER (PARTITION BY source ORDER BY md5('mix-1/block/' || coalesce(source, 'null') || '/' || block::VARCHAR), block) AS place,
  (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::INT AS passes FROM b0),
b AS (SELECT *, upto - block_size AS before, target - passes * source_size AS rest FROM b1),
e0 AS (SELECT kb.source, kb.key, b.before, b.rest, sum(kb.size) OVER (PARTITION BY kb.source ORDER BY kb.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
  sum(kb.size) OVER (PARTITION BY kb.source, kb.key) AS grp FROM kb JOIN b ON kb.source IS NOT DISTINCT FROM b.source AND kb.block = b.block WHERE b.before < b.rest AND b.upto > b.rest),
e AS (SELECT source, max(key) AS edge_key FROM e0 WHERE before + run - grp / 2.0 <= rest GROUP BY source),
u0 AS (SELECT source, block, place, passes, unnest(range(0, passes + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS pass FROM b),
u AS (SELECT source, block, passes, pass, row_number() OVER (PARTITION BY source ORDER BY pass, place) AS unit FROM u0),
{_tree_sql()},
q AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard, unit) AS n FROM t{SHARD_LEVELS}),
dealt AS (SELECT u.source, u.block, string_agg(u.pass::VARCHAR || ':' || q.shard::VARCHAR, ',' ORDER BY u.pass, q.shard) AS every,
  string_agg(u.pass::VARCHAR || ':' || q.shard::VARCHAR, ',' ORDER BY u.pass, q.shard) FILTER (WHERE u.pass < u.passes) AS whole
  FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source AND u.unit = q.n GROUP BY u.source, u.block)
SELECT kb.doc_id, kb.size, kb.source_size, kb.target,
  (kb.size * (b.passes + CASE WHEN b.upto <= b.rest THEN 1 WHEN b.before < b.rest AND kb.key <= coalesce(e.edge_key, '') THEN 1
     WHEN b.before < b.rest AND b.upto <= b.rest THEN 1 ELSE 0 END))::BIGINT AS taken,
  coalesce(CASE WHEN b.before < b.rest AND b.upto > b.rest AND kb.key > coalesce(e.edge_key, '') THEN dealt.whole ELSE dealt.every END, '') AS shards
FROM kb JOIN b ON kb.source IS NOT DISTINCT FROM b.source AND kb.block = b.block LEFT JOIN e ON e.source IS NOT DISTINCT FROM kb.source
LEFT JOIN dealt ON dealt.source IS NOT DISTINCT FROM b.source AND dealt.block = b.block
"""
