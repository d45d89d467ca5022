"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band:
``LOW_DF <= df / N <= HIGH_DF``, that is ``ln(1 / HIGH_DF) <= idf <= ln(1 / LOW_DF)``,
with document frequencies counted over all documents.  A document keeps its
distinct lexicon terms, sorted; each of ``len(KEEP)`` random subsets of the
lexicon (subset j keeps a term with chance ``KEEP[j]``) gives one hash of the
sorted terms that remain.  Two documents whose hashes agree in some subset
share those terms exactly; the share of agreeing subsets, among those that
are not empty on both sides, is their likeness.

Size of the broadcast: the document frequencies of the lexicon's terms add up
to at most the distinct terms of all documents, so it has at most
(mean distinct terms of a document) / ``LOW_DF`` terms of 8 bytes, at any
corpus size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import range_cuts, range_no, partitions, table

LOW_DF, HIGH_DF = 1e-3, 0.2
KEEP = (1.0, 1 / 2, 1 / 4, 1 / 8, *(2.0 ** -(4 + 2 * (j % 4)) for j in range(28)))  # all; large subsets; 7 each of 1/16, 1/64, 1/256, 1/1024
MIN_TERMS = 3
FLUSH_TERMS = 400_000
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def term_hash(word: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word)


def terms(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def lexicon(docs: DataFrame, low: float = LOW_DF, high: float = HIGH_DF) -> np.ndarray:
    """Sorted 64-bit hashes of the terms in the band; a null text is a document of no terms.

    Document frequencies are summed in the tasks first (at most ``FLUSH_TERMS``
    terms at a time), then by a shuffle on the term's hash.
    """
    def count(batches):
        import pyarrow as pa
        from collections import Counter
        seen: Counter[str] = Counter()

        def out():
            keys = np.fromiter(map(term_hash, seen), "uint64", len(seen)).view("int64")
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(seen.values(), "int64", len(seen)))], names=["term", "n"])

        for batch in batches:
            for value in batch.column(0):
                seen.update(terms(value.as_py()))
                if len(seen) >= FLUSH_TERMS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    n_docs = docs.count()
    df = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    band = df.where((F.col("df") >= low * n_docs) & (F.col("df") <= high * n_docs)).select("term").toPandas()
    return np.sort(band["term"].to_numpy(dtype="int64").view("uint64"))


class Fingerprinter:
    """Fingerprints of texts under one lexicon.  Keeps a bounded memo of the words it has hashed."""

    def __init__(self, lexicon_hashes: np.ndarray, keep: tuple[float, ...] = KEEP, memo: int = 300_000):
        self.lexicon, self.memo, self.most = lexicon_hashes, {}, memo
        self.seeds = ((np.arange(1, len(keep) + 1, dtype="uint64") * np.uint64(0xD1342543DE82EF95)) | np.uint64(1))[:, None]
        self.under = np.array([int(q * 2 ** 32) for q in keep], dtype="uint64")[:, None]

    def kept(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes that stand for the text.

        Lexicon terms; all its terms if it has fewer than ``MIN_TERMS`` of
        those; the text itself if it has no term at all; none if it is empty.
        """
        words = terms(text)
        memo, out = self.memo, []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = term_hash(w)
                i = int(np.searchsorted(self.lexicon, np.uint64(h)))
                h = h if i < len(self.lexicon) and int(self.lexicon[i]) == h else 0
                if len(memo) >= self.most:
                    memo.clear()
                memo[w] = h
            if h:
                out.append(h)
        if len(out) < MIN_TERMS:
            out = [term_hash(w) for w in words] or ([term_hash(text)] if text else [])
        return np.sort(np.array(out, dtype="uint64"))

    def __call__(self, text: str | None) -> tuple[str, ...]:
        import xxhash
        kept = self.kept(text)
        with np.errstate(over="ignore"):
            mixed = (kept[None, :] ^ self.seeds) * _MIX
            mixed = ((mixed ^ (mixed >> np.uint64(29))) * self.seeds) >> np.uint64(32)
        return tuple(xxhash.xxh64_hexdigest(kept[m].tobytes()) if m.any() else "-" for m in mixed < self.under)


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of equal hashes among the subsets that are not empty on both sides; equal fingerprints: 1."""
    if a == b:
        return 1.0
    used = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
    return sum(x == y for x, y in used) / len(used)


def fingerprints(docs: DataFrame, low: float = LOW_DF, high: float = HIGH_DF) -> DataFrame:
    """``docs`` (with ``text``) plus ``imatch``: its fingerprint as one string.  Empty and null texts have the one empty fingerprint."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    @F.pandas_udf("string")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Fingerprinter(words.value)
        for texts in batches:
            yield texts.map(lambda t: ".".join(make(t)), na_action=None)

    return docs.withColumn("imatch", mark("text"))


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """Rows dealt to ``n`` ranges of descending ``doc_id``, each followed by the first row of the next range.

    One shuffle of the texts.  Adds ``rng`` and ``guest`` (1 for the copy of
    the next range's first row; after the last range, of the very first row).
    Ties in ``doc_id`` are in order of text, a null ``doc_id`` is last.
    """
    rows = docs.withColumn("neg", F.bitwise_not("doc_id"))  # ascending where doc_id descends; a cut opens its range
    cuts = range_cuts(rows, "neg", n)
    low, last = rows.agg(F.min("neg")).first()[0], len(cuts)
    rows = rows.withColumn("rng", range_no(F.col("neg"), cuts))
    before = F.when(F.col("neg").eqNullSafe(F.lit(low).cast("long")), F.lit(last))
    if cuts:
        before = before.when(F.col("neg").isin(cuts), F.col("rng") - 1)
    places = F.when(before.isNull(), F.array(F.struct(F.col("rng").alias("rng"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("rng").alias("rng"), F.lit(0).alias("guest")), F.struct(before.alias("rng"), F.lit(1).alias("guest"))))
    out = rows.withColumn("at", F.explode(places)).withColumn("rng", F.col("at.rng")).withColumn("guest", F.col("at.guest")).drop("at")
    return out.repartitionById(last + 1, F.col("rng")).sortWithinPartitions(
        "rng", "guest", F.col("neg").asc_nulls_last(), F.col("text").asc_nulls_first()).drop("neg")


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, whose second half is the next document's beginning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spark.sparkContext.broadcast(lexicon(docs))

    def compare(batches):
        import hashlib

        import pyarrow as pa
        make, held, rows = Fingerprinter(words.value), None, []

        def add(doc_id, text, mark, next_text, next_mark):
            n = len(text)
            edited = text[:n - n // 2] + next_text[:n // 2]
            other = make(edited)
            rows.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), ".".join(mark), ".".join(other),
                         likeness(mark, other), likeness(mark, next_mark)))

        def out():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                               names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text, guest in zip(*(batch.column(c) for c in ("doc_id", "text", "guest")), strict=True):
                doc_id, text, guest = doc_id.as_py(), text.as_py() or "", guest.as_py()
                if guest and held is None:
                    continue
                mark = make(text)
                if held is not None:
                    add(*held, text, mark)
                    if len(rows) >= 2000:
                        yield out()
                held = None if guest else (doc_id, text, mark)
        if rows:
            yield out()

    ordered = with_next(docs, max(1, partitions(spark)))
    return ordered.select("doc_id", "text", "guest").mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
