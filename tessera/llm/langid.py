"""Language identification by bit-sliced Bloom filters of character n-grams.

A filter's row is a bitmask with a bit for each language; an n-gram sets its
bit in ``HASHES`` rows, for every language whose set holds it.  So one lookup
(the AND of those rows) returns all languages that contain the n-gram.  A
document's n-grams are counted by language (popcounts of its masks' columns),
corrected for the filter's false positives, and the largest count decides.

A language's set: its n-grams whose share among the language's n-grams is at
least ``MIN_SHARE`` and at least ``MIN_PART`` of that n-gram's mean share over
the languages, so that stray words of another language do not enter.

Bounds: a language has at most ``1 / MIN_SHARE`` n-grams, so sets and filter
do not grow with the corpus; counts cover all training documents.

Which documents are of a known language is judged by each language's own
coverage: the share of its training n-grams that its set holds, without those
seen once (Good and Turing's estimate of what is new in an unseen text).  Both
rare n-grams that ``MIN_SHARE`` leaves out of a large corpus and scripts of
many n-grams lower that share, and the bound with it.

Cases: null, empty and letterless texts are ``und`` with score 0; a tie of
languages goes to the one learned from more n-grams, then the smaller name;
repeated rows count each time; no training row makes every text ``und``; texts
of any length are read whole, in pieces of whole documents of about ``CHUNK_CHARS``.
Other columns of any name pass through ``keep_known`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

SIZES = (2, 3, 4)  # n-gram lengths; a word's borders count as one more character
MIN_SHARE, MIN_PART = 2e-6, 0.5
HASHES, ROWS_PER_GRAM = 4, 16
FILTER_BYTES = 128 << 20  # the filters of all languages; more n-grams than fit give more false positives, which are measured and corrected
CHUNK_CHARS, FLUSH_GRAMS = 300_000, 1_000_000
UNKNOWN = "und"
KEEP_AT = 0.4  # a document under this part of its language's coverage is of no known language

_LETTER = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit n-gram hashes of some texts, lower-cased, and the number of the text of each.

    Anything but letters ends a word; an n-gram lies in a word with its borders
    and has a letter inside, so a text with a letter has an n-gram.
    """
    joined = "\0\0".join((t or "").lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(code):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    owner_ends = np.cumsum([len((t or "").lower()) + 2 for t in texts])
    word = letters()[code]
    code = np.concatenate([[0], np.where(word, code, 0), [0]]).astype("u8")
    word = code > 0
    keys, at = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m < 1:
            continue
        # letters inside; at the ends a letter or a border; not two borders alone
        ok = word[1:1 + m].copy() if n > 2 else word[:m] | word[1:1 + m]
        for k in range(2, n - 1):
            ok &= word[k:k + m]
        where = np.flatnonzero(ok)
        h = np.full(len(where), n, "u8")
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[where + k]
        keys.append(_mix(h))
        at.append(where)
    pos = np.concatenate(at)  # of the text: the second character of the window, which lies in the text or ends it
    owner = np.searchsorted(owner_ends, pos, side="right")
    return np.concatenate(keys), owner


def chunks(values: list[str | None]):
    """Slices of a list of texts of about ``CHUNK_CHARS`` together."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += len(v or "")
        if held >= CHUNK_CHARS:
            yield start, values[start:i + 1]
            start, held = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs`` (``lang, text``), counted in the tasks before the shuffle."""
    def count(batches):
        import pyarrow as pa
        held: dict[str, list] = {}
        size = 0

        def fold(parts):
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def out():
            for lang, parts in held.items():
                keys, n = fold(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view("i8")), pa.array(n.astype("i8"))],
                                                 names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, part in chunks(texts):
                keys, owner = ngrams(part)
                names = langs[start:start + len(part)]
                for lang in set(names):
                    own = np.array([x == lang for x in names])
                    mine = keys[own[owner]]
                    if len(mine):
                        held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size >= 2 * FLUSH_GRAMS:
                    for lang, parts in held.items():
                        held[lang] = [fold(parts)]
                    if sum(len(p[0][0]) for p in held.values()) >= FLUSH_GRAMS:
                        yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The bit-sliced filter: ``rows[r]`` has a bit for each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray, size: int):
        self.languages, self.size = languages, size
        self.words = masks.shape[1]
        kind = next((k for bits, k in ((8, "u1"), (16, "u2"), (32, "u4")) if len(languages) <= bits), "u8")
        self.rows = np.zeros((size, self.words), kind)  # a bit a language
        for pos in self.places(grams):
            for w in range(self.words):
                np.bitwise_or.at(self.rows[:, w], pos, masks[:, w].astype(kind))
        fill = np.array([self.bits(self.rows, i).mean() for i in range(len(languages))])
        self.false_positive = fill ** HASHES
        self.coverage = np.ones(len(languages))  # of each language's n-grams; ``learn`` sets it

    def bits(self, rows: np.ndarray, i: int) -> np.ndarray:
        """Language ``i``'s bit in each row."""
        return (rows[:, i // 64] >> rows.dtype.type(i % 64)) & rows.dtype.type(1)

    def places(self, grams: np.ndarray):
        a, b = grams, _mix(grams + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for k in range(HASHES):
            yield ((a + np.uint64(k) * b) % np.uint64(self.size)).astype("i8")

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram the languages that contain it, as a bitmask."""
        out = None
        for pos in self.places(grams):
            out = self.rows[pos] if out is None else out & self.rows[pos]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language of each text (``und`` without a letter) and its corrected share of the n-grams."""
        n_lang = len(self.languages)
        hits, total = np.zeros((n_lang, len(texts))), np.zeros(len(texts))
        for start, part in chunks(texts):
            grams, owner = ngrams(part)
            stop = start + len(part)
            total[start:stop] = np.bincount(owner, minlength=len(part))[:len(part)]
            masks = self.masks(grams) if len(grams) and n_lang else None
            for i in range(n_lang if masks is not None else 0):
                has = self.bits(masks, i)
                hits[i, start:stop] = np.bincount(owner, weights=has, minlength=len(part))[:len(part)]
        if not n_lang:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        fp = self.false_positive[:, None]
        real = np.clip((hits - total * fp) / np.maximum(1 - fp, 1e-9), 0, None)
        best = real.argmax(axis=0)  # ties: the language learned from more n-grams, as languages are in that order
        score = np.where(total > 0, real.max(axis=0) / np.maximum(total, 1), 0.0)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1)


    def known(self, texts: list[str | None], at: float = KEEP_AT) -> np.ndarray:
        """Whether each text's score reaches ``at`` times the coverage of its language (never without a letter)."""
        lang, score = self.predict(texts)
        bound = {x: at * c for x, c in zip(self.languages, self.coverage, strict=True)}
        return np.array([s > 0 and s >= bound[x] for x, s in zip(lang, score, strict=True)], bool)


def learn(docs: DataFrame) -> Filters:
    """Filters from ``lang, text`` (rows with a null in either are left out; every other row counts).

    No rows: filters without a language, whose predictions are all ``und``.
    """
    from tessera.llm.common import publish
    counts = publish(gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")), "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "lang").collect()  # a row a language
    if not totals:
        return Filters([], np.zeros(0, "u8"), np.zeros((0, 1), "u8"), 1)
    languages = [r["lang"] for r in totals]
    size = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], float(r["total"]))])
    share = counts.withColumn("share", F.col("n") / size[F.col("lang")])
    common = share.where(F.col("share") >= MIN_SHARE)
    mean = share.groupBy("gram").agg((F.sum("share") / len(languages)).alias("mean"))
    kept = common.join(mean, "gram").where(F.col("share") >= MIN_PART * F.col("mean"))
    kept = kept.select("lang", "gram", "n").toPandas()  # at most 1 / MIN_SHARE n-grams a language
    grams, at = np.unique(kept["gram"].to_numpy("int64").view("u8"), return_inverse=True)
    number = {x: i for i, x in enumerate(languages)}
    bit = kept["lang"].map(number).to_numpy("int64")
    masks = np.zeros((len(grams), -(-len(languages) // 64)), "u8")
    np.bitwise_or.at(masks, (at, bit // 64), np.uint64(1) << (bit % 64).astype("u8"))
    row_bytes = 8 * masks.shape[1] if len(languages) > 32 else 1 if len(languages) <= 8 else 2 if len(languages) <= 16 else 4
    filters = Filters(languages, grams, masks, max(1024, min(ROWS_PER_GRAM * len(grams), FILTER_BYTES // row_bytes)))
    again = np.where(kept["n"] > 1, kept["n"], 0)
    filters.coverage = np.bincount(bit, weights=again, minlength=len(languages)) / np.array([r["total"] for r in totals])
    return filters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def predict_column(spark, filters: Filters):
    """A text column -> a struct ``lang_pred, score``, from the text alone."""
    model = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = model.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return lambda text="text": predict(F.col(text))


def keep_known(docs: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the documents of no known language: no letter, or a score under ``at`` times their language's coverage; columns unchanged.

    Learned from the documents that are not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out(F.col("doc_id")))))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.known([t if isinstance(t, str) else None for t in texts], at))

    return docs.where(known("text"))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out.  A null ``doc_id`` is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", held_out(F.col("doc_id")))
    predict = predict_column(spark, learn(docs.where(~F.col("held_out"))))
    rows = docs.select("doc_id", "held_out", predict().alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
