r"""Chat formatting of reply trees.

Messages form trees (``parent`` points to the message that one replies to).
Depth and branch score come from pointer doubling: each round joins the nodes
with themselves on the pointer, so a chain of n messages takes log2(n) rounds
and each round holds one row a node.  Leaves are ranked by branch score; the
paths of the chosen leaves are then unrolled by the same pointers, longest
jump first: every round doubles the rows up to the paths' own length, so the
work is the size of the output, never all pairs of a tree.

The joins carry keys alone; texts join once, at the end.

Template: a turn is ``### <role>: <text></turn>\n``.  Roles and texts are
escaped: a backslash becomes ``\b``, ``#`` becomes ``\h``, ``<`` becomes
``\l`` (and ``:`` in a role ``\c``), so neither marker can occur inside, and
each escape reads back to one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import publish

HEAD, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))  # in this order; undone in reverse
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, (":", "\\c")) if role else ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed((*ESCAPES, (":", "\\c")) if role else ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_replies(messages: DataFrame, order: list[str]) -> DataFrame:
    """A conversation without reply links as a tree of one branch: each row replies to the row before it.

    ``messages``: ``tree`` and the ``order`` columns.  Adds ``node`` (1, 2, …)
    and ``parent`` (null for the first).  Rows that tie in every order column
    are equal rows, so either order gives one result.
    """
    w = Window.partitionBy("tree").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    out = messages.withColumn("node", F.row_number().over(w).cast("long"))
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def branches(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer doubling over ``tree, node, parent, score``.

    Returns the jump tables (``tree, node, up``; table k jumps 2**k messages
    up) and the leaves as ``tree, leaf, depth, score`` with the score summed
    from the root.  A parent that is not in the tree counts as none.  Nodes on
    a cycle have no root, so no branch reaches them.
    """
    ids = nodes.select("tree", F.col("node").alias("up"))
    now = nodes.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = now.join(ids.withColumn("there", F.lit(True)), ["tree", "up"], "left")
    now = publish(known.select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("depth")), "tree-0")
    has_child = now.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = now.select("tree", "node").join(has_child, ["tree", "node"], "left_anti")
    size = now.count()
    done, live = now.where("up IS NULL"), now.where("up IS NOT NULL")  # nodes at their root need no more rounds
    jumps: list[DataFrame] = []
    while live.head(1) and 2 ** len(jumps) <= size:  # beyond that only cycles are left
        jumps.append(live.select("tree", "node", "up"))
        above = done.unionByName(live).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"),
                                              F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        now = publish(live.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"),
            (F.col("depth") + F.col("depth2")).alias("depth")), f"tree-{len(jumps)}")
        done, live = done.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL")
    return jumps, leaves.join(done, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "depth", "score")


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths as rows ``tree, leaf, branch, pos, node``.

    ``branch`` ranks a tree's leaves by score (best first, ties to the smaller
    leaf); ``best`` keeps that many branches (None: all of them); ``pos``
    counts from the root.
    """
    jumps, leaves = branches(nodes)
    rank = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf"))
    leaves = leaves.withColumn("branch", F.row_number().over(rank))
    if best is not None:
        leaves = leaves.where(F.col("branch") <= best)
    out = leaves.select("tree", "leaf", "branch", F.col("depth").alias("pos"), F.col("leaf").alias("node"))
    for k in reversed(range(len(jumps))):
        step = out.join(jumps[k], ["tree", "node"]).select(
            "tree", "leaf", "branch", (F.col("pos") - 2 ** k).alias("pos"), F.col("up").alias("node"))
        out = publish(out.unionByName(step), f"paths-{k}")
    return out


def format_turns(turns: DataFrame, key: list[str]) -> DataFrame:
    """One conversation a ``key`` from rows ``key…, pos, role, text`` (null role or text: empty).

    ``formatted`` is the text; ``loss_spans`` the ``(start, length)`` spans,
    in code points from 1, of the assistant texts inside it.
    """
    role, text = escape(F.coalesce("role", F.lit("")), role=True), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(HEAD), role, F.lit(ROLE_END))
    t = turns.select(*key, F.struct("pos", head.alias("head"), text.alias("body"),
                                    (F.col("role") == LOSS_ROLE).alias("loss")).alias("turn"))
    t = t.groupBy(*key).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start, n = acc["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(TURN_END)).alias("at"),
                        F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return t.select(*key, whole.alias("formatted"), F.aggregate("turns", zero, add, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``(role, text)``, unescaped."""
    parts = F.split(formatted, TURN_END)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cut = lambda p: F.locate(ROLE_END, p)
    return F.transform(parts, lambda p: F.struct(
        unescape(p.substr(F.lit(len(HEAD) + 1), cut(p) - len(HEAD) - 1), role=True).alias("role"),
        unescape(p.substr(cut(p) + len(ROLE_END), F.length(p))).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(formatted.substr(s["start"], s["length"]))))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts are the template's own control strings.

    A conversation has no reply links here, so its rows by turn (ties by role,
    then text, nulls first) are one branch.  A null ``conv_id`` is a conversation of its own.
    """
    from tessera.llm.common import table
    cols = ["conv_id", "turn", "role", "text"]
    odd = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*cols).unionByName(planted)
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = publish(linear_replies(rows, ["turn", "role", "text"]), "chat-rows")
    nodes = rows.select("tree", "node", "parent", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
    chosen = paths(nodes, best=1).select("tree", "branch", "pos", "node")
    turns = chosen.join(rows.select("tree", "node", "conv_id", "role", "text"), ["tree", "node"])
    out = format_turns(turns, ["tree", "branch", "conv_id"])
    out = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_texts(F.col("formatted"), F.col("loss_spans")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, length(role) + length(role) - length(translate(role, '\#<:', '')) AS role_chars,
  length(text) + length(text) - length(translate(text, '\#<', '')) AS text_chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
