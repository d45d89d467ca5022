"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text gets a MinHash signature of its word n-grams, cut into bands;
   ``choose_bands`` finds rows and bands for the target recall at the threshold.
2. Equal texts become one node, found by the text's MD5 and given a number
   when the table of nodes is written.  A shuffle on the band hashes finds the
   buckets; each member is tied to its bucket's smallest node, and connected
   components of these ties hold every pair that shares a bucket.
3. Inside a component every pair is compared on its full n-gram sets.  A
   component goes to one task up to ``BLOCK`` texts and ``BLOCK_CHARS``
   characters; a larger one is cut into blocks, and each pair of blocks is a
   group of its own, so a task's memory is bounded and hot groups spread out.
   A task returns a link count and a tie a text, never the pairs.
4. Components of the verified ties are the classes.

No pair of texts that shares a bucket is left out, at any group size.

Null, empty and blank texts have no n-gram and link to nothing; a text of fewer
words than an n-gram is one n-gram.  Repeated rows count once, ties go to the
smallest ``doc_id``, an empty table gives no rows, and columns of any name pass
through ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partitions, publish, table
from tessera.llm.components import components

NGRAM, THRESHOLD = 5, 0.8
RECALL, MAX_HASHES = 0.9995, 160
BLOCK, BLOCK_CHARS = 1024, 8 << 20
UNIT_TEXTS = 1024  # small components that share a task's group

_WORD = None
_POWERS = np.ones(1, "u8"), np.ones(1, "u8")
_P = 0x9E3779B97F4A7C15  # odd, so invertible
_P_INV = pow(_P, -1, 1 << 64)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose ``bands`` reach the recall within ``most`` hashes.

    A pair of similarity s shares a band with chance ``1 - (1 - s**rows)**bands``.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        make = lambda p: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, "u8")]))
        _POWERS = make(np.uint64(_P)), make(np.uint64(_P_INV))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text.

    Words are lower-cased runs of letters, digits and underscores.  Fewer than
    n words: one n-gram of them all.  No word: the text itself is the one
    n-gram.  Null, empty and blank texts have none.
    """
    global _WORD
    if _WORD is None:
        _WORD = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    if not text or text.isspace():
        return np.zeros(0, "u8")
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.concatenate([[False], _WORD[code], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        start, end = np.array([0]), np.array([len(code)])
    power, inverse = _powers(len(code) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((code.astype("u8") + np.uint64(1)) * power[:len(code)])])
    words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype("u8"))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, "u8")
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + words[k:k + len(out)]
    return np.unique(_mix(out))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mask, self.odd = (rng.integers(0, 1 << 63, bands * rows, dtype="u8") * np.uint64(2) + np.uint64(1) for _ in range(2))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash a band of the signature of a non-empty n-gram set; the band's number is in the hash."""
        low = None
        for at in range(0, len(grams), 2048):
            h = ((grams[None, at:at + 2048] ^ self.mask[:, None]) * self.odd[:, None]).min(axis=1)
            low = h if low is None else np.minimum(low, h)
        out = np.arange(1, self.bands + 1, dtype="u8")
        for row in low.reshape(self.bands, self.rows).T:
            out = _mix(out * np.uint64(0x100000001B3) + row)
        return out


def compare(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Compare texts ``left`` with texts ``right`` (masks over ``sets``), each pair once, on their full sets.

    Returns for each text the weight of the texts it links to (similarity of
    ``threshold`` or more), and the smallest index in its tie group.  Common
    n-grams are counted by matrix products, rare ones from their lists.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    grams, gram = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    df = np.bincount(gram, minlength=len(grams))
    shared = np.zeros((n, n), "f4")
    rare = max(4, n // 16)
    common = np.flatnonzero(df >= rare)
    column = np.full(len(grams), -1)
    column[common] = np.arange(len(common))
    for at in range(0, len(common), 2048):
        hit = (column[gram] >= at) & (column[gram] < at + 2048)
        m = np.zeros((n, min(2048, len(common) - at)), "f4")
        m[owner[hit], column[gram[hit]] - at] = 1
        shared += m @ m.T
    order = np.argsort(gram, kind="stable")
    first = np.concatenate([[0], np.cumsum(df)[:-1]])
    for d in range(2, min(rare, int(df.max(initial=0)) + 1)):
        starts = first[df == d]
        step = max(1, (1 << 20) // (d * d))
        for part in range(0, len(starts), step):
            docs = owner[order[starts[part:part + step, None] + np.arange(d)]]
            pairs = docs[:, :, None] * n + docs[:, None, :]
            shared += np.bincount(pairs.ravel(), minlength=n * n).reshape(n, n)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * union - 1e-6
    asked = left[:, None] & right[None, :]
    linked &= (asked | asked.T) & ~np.eye(n, dtype=bool)
    tie = np.arange(n)
    while True:
        low = np.minimum(tie, np.where(linked, tie[None, :], n).min(axis=1))
        low = low[low]
        if (low == tie).all():
            return linked @ weights, tie
        tie = low


def signatures(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """``doc_id, hash, chars, bands`` of ``docs (doc_id, text)``: the text's MD5 and its band hashes, null where it has no n-gram."""
    def sign(batches):
        import hashlib

        import pyarrow as pa
        make = MinHash(bands, rows)
        seen: dict[bytes, list] = {}
        for batch in batches:
            hashes, sizes, out = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                key = hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()
                if key not in seen:
                    if len(seen) >= 5000:
                        seen.clear()
                    grams = shingles(text, n)
                    seen[key] = make.band_hashes(grams).view("i8") if len(grams) else None
                hashes.append(key if seen[key] is not None else None)
                sizes.append(len(text or ""))
                out.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "hash", "chars", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, hash binary, chars long, bands array<long>")


def repeated(docs: DataFrame, name: str) -> DataFrame | None:
    """``name``: each ``doc_id`` that is on several rows, or None where there is none."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    again = publish(again, "jaccard-again")
    return again if again.head(1) else None


def node_texts(docs: DataFrame, members: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """``members (node, hash, low, …)`` with the ``text`` of each: of the row with ``doc_id = low`` and the MD5 ``hash``.

    Rows of the ids in ``again (again_id)`` are told apart by their MD5, and
    equal ones are aggregated first; all other texts are moved once, by id.
    """
    text = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    by_id = members.withColumnRenamed("low", "doc_id")
    if again is None:
        return by_id.join(text, "doc_id")
    same = F.col("doc_id") == F.col("again_id")
    once = by_id.join(text.join(again, same, "left_anti"), "doc_id")
    several = text.join(again, same, "left_semi").withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))
    several = several.groupBy("doc_id", "hash").agg(F.min("text").alias("text"))
    return once.unionByName(by_id.join(several, ["doc_id", "hash"]))


def verified(members: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, again: DataFrame | None = None) -> DataFrame:
    """``node, root, links``: all pairs inside each component compared in blocks.

    ``members``: ``node, hash, low, comp, weight, chars``, their texts as ``node_texts`` finds them.
    """
    spark = docs.sparkSession
    sized = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all_chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_chars") / BLOCK_CHARS))
    sized = publish(sized.withColumn("blocks", blocks), "jaccard-sizes")
    small = sized.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    units = max(1, math.ceil(small / UNIT_TEXTS))
    placed = members.join(sized.select("comp", "blocks"), "comp")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    rows = node_texts(docs, placed.drop("chars"), again)
    rows = rows.withColumn("x", F.explode(other)).withColumns({"p": F.least("x", "block"), "q": F.greatest("x", "block")})
    spread = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(units))).otherwise(F.xxhash64("comp", "p", "q"))
    rows = rows.select(spread.alias("unit"), "comp", "p", "q", "node", "block", "weight", "text")
    rows = rows.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "comp", "p", "q", "node")

    def work(batches):
        import pyarrow as pa

        def out(group):
            nodes, block, weights, sets, (p, q) = group
            keep = [i for i, s in enumerate(sets) if len(s)]
            nodes, block, weights, sets = ([v[i] for i in keep] for v in (nodes, block, weights, sets))
            if len(nodes) < 2:
                return None
            block = np.array(block)
            links, tie = compare(sets, np.array(weights, "f8"), block == p, block == q, threshold)
            low = {}  # rows are in node order, so a tie group's first row has its smallest node
            for i, t in enumerate(tie):
                low.setdefault(int(t), nodes[i])
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([low[int(t)] for t in tie], pa.int64()),
                                               pa.array(np.rint(links).astype("i8"))], names=["node", "root", "links"])

        now, group = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("unit", "comp", "p", "q", "node", "block", "weight", "text")]
            for unit, comp, p, q, node, block, weight, text in zip(*cols, strict=True):
                if (unit, comp, p, q) != now:
                    if group and (made := out(group)):
                        yield made
                    now, group = (unit, comp, p, q), ([], [], [], [], (p, q))
                group[0].append(node)
                group[1].append(block)
                group[2].append(weight)
                group[3].append(shingles(text, n))
        if group and (made := out(group)):
            yield made

    return rows.mapInArrow(work, "node long, root long, links long")


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links``, a row for each row of ``docs (doc_id, text)``.

    ``class_id`` is the smallest ``doc_id`` that a chain of links reaches; rows
    that share a ``doc_id`` are in one class.  ``n_links`` counts the other
    distinct ``(doc_id, text)`` whose text has a similarity of ``threshold`` or
    more to the row's, copies included: equal rows count once, and a ``doc_id``
    on several texts counts once a text.  Documents without an n-gram (null,
    empty, blank) link to nothing.  A null ``doc_id`` has a null class and no
    links and is nobody's link.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = publish(signatures(docs, bands, rows, n), "jaccard-signatures")
    known = signed.where("doc_id IS NOT NULL AND hash IS NOT NULL")
    items = known.select("doc_id", "hash", "chars").distinct()
    texts = items.groupBy("hash").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("weight"), F.max("chars").alias("chars"))
    texts = publish(texts.withColumn("node", F.monotonically_increasing_id()), "jaccard-texts")
    one = known.select("hash", "bands").dropDuplicates(["hash"]).join(texts.select("hash", "node"), "hash")
    keys = one.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    ties = keys.join(buckets.select("key", "first"), "key").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    comps = components(ties)
    members = publish(comps.select("node", F.col("label").alias("comp")).join(texts, "node"), "jaccard-members")
    again = repeated(docs, "again_id")
    found = publish(verified(members, docs, threshold, n, again), "jaccard-links")
    linked = found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if again is not None:  # texts of one doc_id are in one class
        own = items.join(again, F.col("doc_id") == F.col("again_id"), "left_semi").join(texts.select("hash", F.col("node").alias("u")), "hash")
        first = own.groupBy("doc_id").agg(F.min("u").alias("v"))
        linked = linked.unionByName(own.join(first, "doc_id").where("u <> v").select("u", "v"))
    labels = components(linked)
    classes = labels.join(texts.select("node", "low"), "node").groupBy("label").agg(F.min("low").alias("class_id"))
    classes = publish(labels.join(classes, "label").select("node", "class_id"), "jaccard-classes")
    per = texts.select("node", "hash", "low", "weight").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left")
    per = per.select("hash", F.coalesce("class_id", "low").alias("class_id"),
                     (F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"))
    out = signed.select("doc_id", "hash").join(per, "hash", "left")
    if again is not None:  # a text without an n-gram is in the class of its doc_id's others
        ids = out.where("doc_id IS NOT NULL AND hash IS NOT NULL").groupBy(F.col("doc_id").alias("own_id")).agg(F.min("class_id").alias("own_class"))
        ids = ids.join(again, F.col("own_id") == F.col("again_id"), "left_semi")
        out = out.join(ids, F.col("doc_id") == F.col("own_id"), "left").withColumn("class_id", F.coalesce("class_id", "own_class"))
    none = F.col("doc_id").isNull()
    return out.select("doc_id", F.when(~none, F.coalesce("class_id", "doc_id")).alias("class_id"),
                      F.when(none, F.lit(0).cast("long")).otherwise(F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest ``doc_id``; columns unchanged.

    Of several rows of that ``doc_id`` the one of the smallest text (null
    first) stays.  Rows without a ``doc_id`` are in no class and stay.
    """
    own = "id"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    pairs = join_similar(docs.select("doc_id", "text"), threshold, n)
    gone = publish(pairs.where("class_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "jaccard-gone")
    same = F.col("doc_id") == F.col(own)
    kept = docs.join(gone, same, "left_anti")
    again = repeated(docs, own)
    if again is None:
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = kept.join(again, same).groupBy(own).agg(F.min_by(row, F.struct(F.col("text").isNotNull(), "text")).alias("row"))
    return kept.join(again, same, "left_anti").unionByName(first.select("row.*"))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``documents``: similarity 0.8 on sets of five words, as ``join_similar`` states."""
    return join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
