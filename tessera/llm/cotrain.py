"""Quality classifier by co-training of two views.

View 1, text content: hashed character trigrams and word statistics.  View 2,
page metadata: source, language, and the page's shape (length, lines, shares
of kinds of characters), never its words.  Each view has a logistic model.
Each round both are fitted, score all unlabelled documents in Spark, and hand
their most confident pseudo-labels to the other view's training set.  At the
end both are calibrated and combined on a labelled fold that neither was
fitted on, and every document is scored.

Fitting uses at most ``LABELLED`` labelled documents, drawn by a hash of
``doc_id``.  A view hands over the ``HANDED`` documents it is surest of in a
round, in the classes' labelled proportion: a top-k of all unlabelled
documents that every task cuts first, then salted groups of equal hash, then
one group of a bounded size.  Both views of the unlabelled documents are
computed once and written; a round reads them.  So what reaches the driver does not grow with the corpus.

Cases: a null or blank text scores 0 and is not kept; unlabelled rows of equal
text, language and source count as one candidate, ties go to the smaller hash
of those three; of several rows of one labelled ``doc_id`` the one with the
least features is fitted on; rows of a null ``doc_id`` are unlabelled; without
two labels of each class in both folds every text that is not blank scores the
share of good labels (0.5 without any); an empty table gives no rows.  Other
columns of any name pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions, publish, scratch, table

LABELLED = 8000
ROUNDS, CONFIDENT, HANDED = 4, 0.95, 600  # HANDED: documents a view hands over in a round
BUCKETS, SOURCES, LANGS = 1024, 64, 16
KEEP_AT = 0.5
CHUNK_CHARS, CHUNK_DOCS = 500_000, 500
STEPS, L2 = 120, 1e-4


def _hash(value: object, n: int) -> int:
    import xxhash
    return xxhash.xxh32_intdigest("" if value is None else str(value)) % n


def features(texts: list, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
    """Both views of some documents (null text counts as empty)."""
    n = len(texts)
    content, page = np.zeros((n, BUCKETS + 4), "f4"), np.zeros((n, SOURCES + LANGS + 8), "f4")
    for start, stop in parts(texts):
        _chunk(texts[start:stop], content[start:stop], page[start:stop])
    for i in range(n):
        page[i, 8 + _hash(sources[i], SOURCES)] = 1
        page[i, 8 + SOURCES + _hash(langs[i], LANGS)] = 1
    return content, page


def parts(texts: list):
    """``(start, stop)`` of runs of texts that bound the memory of one step."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK_CHARS or i + 1 - start >= CHUNK_DOCS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _chunk(texts: list, content: np.ndarray, page: np.ndarray) -> None:
    n = len(texts)
    code = np.frombuffer("\0\0".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t or "") for t in texts])
    owner = np.repeat(np.arange(n), sizes + 2)[:len(code)]
    if len(code) > 2:
        tri = (code[:-2].astype("u8") * np.uint64(0x100000001B3) + code[1:-1]) * np.uint64(0x100000001B3) + code[2:]
        tri = (tri ^ (tri >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)
        ok = (code[:-2] > 0) & (code[2:] > 0) & (code[1:-1] > 0)
        cell = owner[:-2][ok] * BUCKETS + (tri[ok] % np.uint64(BUCKETS)).astype("i8")
        counts = np.sqrt(np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS))
        content[:, :BUCKETS] = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    kinds = (((code >= 65) & (code <= 90)), ((code >= 48) & (code <= 57)), (code == 10), (code == 32),
             (code > 32) & (code < 48) | (code > 57) & (code < 65) | (code > 90) & (code < 97) | (code > 122) & (code < 127))
    shares = [np.bincount(owner[k], minlength=n)[:n] / np.maximum(sizes, 1) for k in kinds]
    lines = np.bincount(owner[code == 10], minlength=n)[:n] + 1
    page[:, 0], page[:, 1], page[:, 2] = np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines)
    for k in range(5):
        page[:, 3 + k] = shares[k]
    for i, t in enumerate(texts):
        words = (t or "").split()
        if words:
            from collections import Counter
            count = Counter(words)
            m = len(words)
            content[i, BUCKETS:] = (len(count) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
                                    max(count.values()) / m, min(20.0, sizes[i] / m) / 20)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features, by full-batch Adam; ``fit`` goes on from the present weights."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float = 0.0

    @classmethod
    def on(cls, x: np.ndarray) -> Logistic:
        scale = x.std(axis=0)
        return cls(x.mean(axis=0), np.where(scale > 1e-6, scale, 1.0).astype("f4"), np.zeros(x.shape[1], "f4"))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        z = (x - self.mean) / self.scale
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype("f4")
        m = v = np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            err = weight * (sigmoid(z @ self.w + self.b) - y)
            g = np.append(z.T @ err / len(y) + L2 * self.w, err.mean())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            self.w, self.b = (self.w - step[:-1]).astype("f4"), float(self.b - step[-1])  # single precision stays so

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression of ``y`` on the columns of ``z`` and a constant, by Newton steps; targets smoothed as Platt's."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, x = np.where(y > 0.5, up, down), np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - target) + ridge * w)
    return w


@dataclass
class Model:
    """The two fitted views, their calibrations ``(slope, offset)``, and the weights that combine the calibrated views."""

    views: list[Logistic]
    calibration: list[np.ndarray]
    combine: np.ndarray
    base: float = 0.5

    def score(self, texts: list, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and page probability of good quality; a null or blank text scores 0."""
        total, first, second = (np.full(len(texts), self.base) for _ in range(3))
        for start, stop in parts(texts) if self.views else ():
            z = self.calibrated(features(texts[start:stop], langs[start:stop], sources[start:stop]))
            first[start:stop], second[start:stop] = sigmoid(z).T
            total[start:stop] = sigmoid(np.column_stack([z, np.ones(len(z))]) @ self.combine)
        blank = np.array([not (t or "").strip() for t in texts], bool)
        return np.where(blank, 0.0, total), first, second

    def calibrated(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.column_stack([np.clip(v.logit(x) * c[0] + c[1], -12, 12) for v, x, c in zip(self.views, views, self.calibration, strict=True)])


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS, handed: int = HANDED) -> Model:
    """Fit on labelled rows (given in random order) and what the views hand each other.

    ``surest(models, given, quota)`` returns for each view the ``(keys, labels,
    features of the other view)`` it hands over: at most ``quota[c]`` rows of class ``c``,
    none whose key is in ``given``, the keys the other view was handed before.
    A quarter of the labelled rows is kept for calibration.  With fewer than
    two rows of a class in either part, every score is the share of good rows (0.5 without any).
    """
    cut = len(y) - len(y) // 4
    if min(*(np.count_nonzero(part == c) for part in (y[:cut], y[cut:]) for c in (0, 1))) < 2:
        return Model([], [], np.zeros(3), float(y.mean()) if len(y) else 0.5)
    own = [[x[:cut]] for x in views]
    labels = [[y[:cut].astype("f4")] for _ in views]
    models = [Logistic.on(x[:cut]) for x in views]
    given = [np.zeros(0, "i8") for _ in models]  # keys of the rows a view has been handed
    share = y[:cut].mean()
    quota = tuple(max(1, int(handed * part)) for part in (1 - share, share))  # both classes in their labelled proportion
    for r in range(rounds + 1):
        for k, m in enumerate(models):
            m.fit(np.concatenate(own[k]), np.concatenate(labels[k]), STEPS if r == 0 else STEPS // 3)
        if r == rounds:
            break
        for k, (keys, good, x) in enumerate(surest(models, given[::-1], quota)):
            other = 1 - k
            given[other] = np.concatenate([given[other], keys])
            own[other].append(x)
            labels[other].append(good.astype("f4"))
    rest = [x[cut:] for x in views]
    held = y[cut:].astype("f8")
    model = Model(models, [_platt(m.logit(x)[:, None], held) for m, x in zip(models, rest, strict=True)], np.zeros(3))
    model.combine = _platt(model.calibrated(tuple(rest)), held, ridge=1e-2)
    return model


WIDTHS = (BUCKETS + 4, SOURCES + LANGS + 8)


def _stack(rows: pd.Series | list, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "f2").reshape(-1, width).astype("f4")


class Held:
    """The surest rows of one class by one view that a task has seen, at most ``quota``, a key once."""

    def __init__(self, quota: int, width: int):
        self.quota = quota
        self.keys, self.sure, self.x = np.zeros(0, "i8"), np.zeros(0, "f8"), np.zeros((0, width), "f2")

    def add(self, keys: np.ndarray, sure: np.ndarray, x: np.ndarray) -> None:
        if len(self.keys) == self.quota:  # what cannot enter is not copied
            enters = sure >= self.sure[-1]
            keys, sure, x = keys[enters], sure[enters], x[enters]
        if not len(keys):
            return
        keys, sure = np.concatenate([self.keys, keys]), np.concatenate([self.sure, sure])
        order = np.lexsort((keys, -sure))
        first = np.unique(keys[order], return_index=True)[1]  # of equal keys the surest
        order = order[np.sort(first)][:self.quota]
        self.keys, self.sure, self.x = keys[order], sure[order], np.concatenate([self.x, x.astype("f2")])[order]


def feature_rows(rows: DataFrame, keep: str) -> DataFrame:
    """``rows (text, lang, source, ...)`` as ``a, b``, both views in half precision, and the columns of the schema ``keep``."""
    names = [c.split()[0] for c in keep.split(", ")]

    def view(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                made = features(*[part.column(c).to_pylist() for c in range(3)])
                views = [pa.array([x.astype("f2").tobytes() for x in view], pa.binary()) for view in made]
                yield pa.RecordBatch.from_arrays([*views, *[part.column(3 + i) for i in range(len(names))]], names=["a", "b", *names])

    return rows.select("text", "lang", "source", *names).mapInArrow(view, f"a binary, b binary, {keep}")


def surest_rows(spare: DataFrame, models: list[Logistic], given: list[np.ndarray], quota: tuple[int, int]):
    """What each view hands over (see ``co_train``): the distributed top-k of all rows of ``spare (key, a, b)``.

    A row qualifies where the view's probability of its class is at least
    ``CONFIDENT``.  Every task keeps its ``quota`` surest rows of a view and class.
    """
    level = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def candidates(batches):
        import pyarrow as pa
        held = {(k, c): Held(quota[c], WIDTHS[1 - k]) for k in (0, 1) for c in (0, 1)}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                rows = batch.slice(at, CHUNK_DOCS)
                keys = rows.column(0).to_numpy(zero_copy_only=False)
                views = [_stack(rows.column(1 + k).to_pylist(), WIDTHS[k]) for k in (0, 1)]
                for k, m in enumerate(models):
                    z = m.logit(views[k])
                    fresh = ~np.isin(keys, given[k])
                    for c in (0, 1):
                        sure = z if c else -z
                        take = np.flatnonzero(fresh & (sure >= level))
                        held[k, c].add(keys[take], sure[take].astype("f8"), views[1 - k][take])
        for (k, c), h in held.items():
            n = len(h.keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, k, "i4")), pa.array(np.full(n, c, "i4")), pa.array(h.keys), pa.array(h.sure), pa.array([r.tobytes() for r in h.x], pa.binary())],
                names=["view", "good", "key", "sure", "x"])

    found = spare.select("key", "a", "b").mapInArrow(candidates, "view int, good int, key long, sure double, x binary")
    most = F.when(F.col("good") == 1, quota[1]).otherwise(quota[0])
    # equal keys meet in one salted group, which is cut before the groups of a view and class meet
    salts = partitions(spare.sparkSession)
    group = [F.col("view"), F.col("good"), F.pmod(F.col("key"), F.lit(salts))]
    once = found.withColumn("copy", F.row_number().over(Window.partitionBy("view", "good", "key").orderBy(F.desc("sure")))).where("copy = 1")
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "key"))
    for by in (group, group[:2]):
        once = once.withColumn("place", place(by)).where((F.col("place") <= max(quota)) & (F.col("place") <= most))
    got = once.select("view", "good", "key", "sure", "x").toPandas().sort_values(["view", "good", "sure", "key"], ascending=[True, False, False, True])
    return [(part["key"].to_numpy("i8"), part["good"].to_numpy(), _stack(part["x"], WIDTHS[1 - k]))
            for k in (0, 1) for part in [got[got["view"] == k]]]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED) -> Model:
    """Fit on ``docs (doc_id, text, lang, source)`` and ``labels (doc_id, quality)``.

    Labels with a null are left out; a document labelled more than once has
    the rounded mean of its labels.  Labelled documents of null text are used
    as empty ones.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    draw = F.xxhash64(F.col("doc_id"), F.lit("label"))
    known = known.orderBy(draw, "doc_id").limit(labelled).select(F.col("doc_id").alias("labelled_id"), "y")
    docs, known = docs.select("doc_id", "text", "lang", "source"), publish(known, "labelled")
    match = F.col("doc_id") == F.col("labelled_id")

    rows = docs.join(F.broadcast(known), match).withColumn("draw", draw)
    rows = feature_rows(rows, "doc_id long, y int, draw long")
    one = rows.groupBy("doc_id", "y", "draw").agg(F.min(F.struct("a", "b")).alias("v"))  # rows of one id count once, summed up in the tasks first
    got = one.select("doc_id", "y", "draw", "v.a", "v.b").toPandas().sort_values(["draw", "doc_id"], kind="stable")
    # the views are computed once; every round reads them
    spare = feature_rows(docs.join(F.broadcast(known), match, "left_anti").withColumn("key", F.xxhash64("text", "lang", "source")), "key long")
    path = scratch(docs.sparkSession, "views")
    spare.write.option("compression", "zstd").parquet(path)
    spare = docs.sparkSession.read.schema(spare.schema).parquet(path)
    return co_train((_stack(got["a"], WIDTHS[0]), _stack(got["b"], WIDTHS[1])), got["y"].to_numpy("f8"),
                    lambda *state: surest_rows(spare, *state), handed=handed)


def score_column(spark, model: Model):
    """``(text, lang, source)`` columns -> a struct ``q, c, p``: the combined, content and page scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("q double, c double, p double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        clean = [[v if isinstance(v, str) else None for v in s] for s in (text, lang, source)]
        q, c, p = shared.value.score(*clean)
        return pd.DataFrame({"q": q, "c": c, "p": p})

    return lambda text="text", lang="lang", source="source": score(F.col(text), F.col(lang).cast("string"), F.col(source).cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the documents whose combined score is under ``at``; columns unchanged."""
    model = fit(docs, labels)
    return docs.where(score_column(docs.sparkSession, model)()["q"] >= at)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is kept (``quality_score >= KEEP_AT``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = docs.select("doc_id", score_column(spark, model)().alias("s"))
    return rows.select("doc_id", F.col("s.q").alias("quality_score"), F.col("s.c").alias("content_score"),
                       F.col("s.p").alias("page_score"), (F.col("s.q") >= KEEP_AT).alias("kept"))
