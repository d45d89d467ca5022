"""The corpus build and evaluation chain as one lazily assembled set of plans.

corpus → global index → percent split → pre-tokenize → vocabulary (train
split) → encode → pack per split → fit next-token model (train) → score
(validation) → metrics.  Each accessor returns a DataFrame; nothing runs until
an action, except collecting the size-capped vocabulary for broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import MASK_TOKEN
from tessera.functions.text import pretokenize
from tessera.operators import blocks as B
from tessera.operators import model as N
from tessera.operators.rowindex import content_hash, distinct_offsets, range_partitions, same_rows, split_percent, with_row_index
from tessera.operators.tokens import add_specials, build_vocab, encode, ones_like
from tessera.session import scratch_path, shuffle_partitions
from tessera.sources.corpus import read_table, select_text
from tessera.sources.packed import read_packed, write_packed


@dataclass(frozen=True)
class CorpusSpec:
    table: str = "documents"
    order_col: str = "doc_id"
    validation_percent: int = 5
    vocab_size: int = 8192
    bpe_merges: int = 50_000
    block_size: int = 128
    model_max_length: int = 1024
    batch_rows: int = 100
    add_k: float = 1.0


SPEC = CorpusSpec()
BLOCK_KEYS = ["batch_id", "block_no"]


class CorpusPlan:
    def __init__(self, spark: SparkSession, sf_dir: str, spec: CorpusSpec = SPEC):
        self.spark, self.sf_dir, self.spec = spark, sf_dir, spec

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def repeats(self) -> bool:
        """Whether an order key (null too) is on several rows."""
        keys = self.table(self.spec.table).groupBy(self.spec.order_col).count()
        return not keys.filter(F.col("count") > 1).isEmpty()

    @property
    def ident(self) -> list[str]:
        """What names a row: the order key, and where keys repeat two hashes of the text.  Rows equal in all are interchangeable."""
        return [self.spec.order_col, "__h1", "__h2"] if self.repeats else [self.spec.order_col]

    @cached_property
    def docs(self) -> DataFrame:
        """What names a row, and its text.  A table of less than a scan split a task is dealt over the tasks first (the scan of a
        small file is one task); a larger one is tokenized where it is read, without a shuffle of text."""
        docs = select_text(self.table(self.spec.table), keep=[self.spec.order_col])
        docs = docs.select(self.spec.order_col, *content_hash("text"), "text") if self.repeats else docs
        tasks = shuffle_partitions(self.spark)
        return docs.repartition(tasks, *self.ident) if range_partitions(docs) <= tasks else docs

    @cached_property
    def index(self) -> DataFrame:
        """(ident…, __off, __m, n_rows): first global index and number of each distinct row.  Text is never sorted: the
        order key alone where it is unique, else key, hashes and number of copies."""
        if self.repeats:
            return distinct_offsets(self.docs.drop("text"), self.ident).withColumnRenamed("__total", "n_rows")
        order = self.table(self.spec.table).select(self.spec.order_col)
        indexed = with_row_index(order, self.spec.order_col, "idx", total_col="n_rows")
        return indexed.withColumnRenamed("idx", "__off").withColumn("__m", F.lit(1).cast("long"))

    def _copies(self, rows: DataFrame) -> DataFrame:
        """Rows of the index to one row for each copy, with its index and split."""
        idx = F.explode(F.sequence("__off", F.col("__off") + F.col("__m") - 1)) if self.repeats else F.col("__off")
        out = rows.withColumn("idx", idx).drop("__m")
        return split_percent(out, self.spec.validation_percent, total_col="n_rows").drop("n_rows")

    @cached_property
    def split(self) -> DataFrame:
        """(ident…, idx, split, split_idx) of every row."""
        return self._copies(self.index).drop("__off")

    @cached_property
    def border(self):
        """The first training row (None: there is none): its ident, and the copies of it before and after the border."""
        rows = self._copies(self.index.withColumn("__first", F.col("__off")).withColumn("__of", F.col("__m")))
        r = rows.filter((F.col("split") == "train") & (F.col("split_idx") == 0)).head()
        return r and ([r[c] for c in self.ident], r["idx"] - r["__first"], r["__of"] - (r["idx"] - r["__first"]))

    def _at_or_after(self, row: list, strictly: bool = False) -> Column:
        """Rows at or after ``row`` in the order of ``ident``, nulls first; a scan takes the order key's part."""
        key, value = F.col(self.ident[0]), row[0]
        same = key.isNull() if value is None else F.coalesce(key == F.lit(value), F.lit(False))
        later = key.isNotNull() if value is None else F.coalesce(key > F.lit(value), F.lit(False))
        if not self.repeats:
            return later if strictly else later | same
        h1, h2 = F.col("__h1"), F.col("__h2")
        second = h2 > row[2] if strictly else h2 >= row[2]
        return later | (same & ((h1 > row[1]) | ((h1 == row[1]) & second)))

    def _split_docs(self) -> DataFrame:
        """Rows with their split.  Copies of the border's row may lie on both sides; they are equal, so only their numbers count."""
        if self.border is None:
            return self.docs.withColumn("split", F.lit("validation"))
        row, before, after = self.border
        split = F.when(self._at_or_after(row), "train").otherwise("validation")
        if not before:
            return self.docs.withColumn("split", split)
        own = self._at_or_after(row) & ~self._at_or_after(row, strictly=True)
        sides = F.concat(F.array_repeat(F.lit("validation"), before), F.array_repeat(F.lit("train"), after))
        return self.docs.filter(~own).withColumn("split", split).unionByName(self.docs.filter(own).limit(1).withColumn("split", F.explode(sides)))

    @cached_property
    def tokens(self) -> DataFrame:
        return self._split_docs().select(*self.ident, "split", pretokenize("text").alias("tokens"))

    @cached_property
    def train_tokens(self) -> DataFrame:
        if self.border is None or self.border[1]:
            return self.tokens.filter(F.col("split") == "train").select("tokens")
        return self.docs.filter(self._at_or_after(self.border[0])).select(pretokenize("text").alias("tokens"))

    @cached_property
    def base_vocab(self) -> DataFrame:
        return build_vocab(self.train_tokens, self.spec.vocab_size)

    @cached_property
    def vocab(self) -> DataFrame:
        """Vocabulary with the mask token appended (T4)."""
        return add_specials(self.base_vocab, [MASK_TOKEN])

    @cached_property
    def vocab_table(self):
        """The size-capped vocabulary, collected once for broadcast (≤ size + 3 rows)."""
        return self.vocab.select("token", "token_id").toArrow()

    @property
    def vocab_rows(self) -> int:
        return self.vocab_table.num_rows

    def token_id(self, token: str) -> int | None:
        toks = self.vocab_table.column("token").to_pylist()
        ids = self.vocab_table.column("token_id").to_pylist()
        return dict(zip(toks, ids)).get(token)

    @cached_property
    def encoded(self) -> DataFrame:
        """(ident…, split, ids) in place: the corpus does not move."""
        keep = [*self.ident, "split"]
        return encode(self.tokens, self.vocab, keep=keep, vocab_table=self.vocab_table)

    @cached_property
    def packed(self) -> DataFrame:
        # attention masks of encoded rows are all ones: pack ids only, rebuild the mask
        return self.packed_ids.withColumn("attention_mask", ones_like("input_ids"))

    @cached_property
    def placed_ids(self) -> DataFrame:
        """Ids with their place: (ident…, input_ids, idx, split, split_idx)."""
        ids = self.encoded.select(*self.ident, "input_ids")
        if self.repeats:  # equal rows move as one
            ids = ids.groupBy(*self.ident).agg(F.first("input_ids").alias("input_ids"))
        return self._copies(same_rows(ids, self.index, self.ident))

    @cached_property
    def packed_ids(self) -> DataFrame:
        bs = B.effective_block(self.spec.block_size, self.spec.model_max_length)
        return B.pack_blocks(self.placed_ids, bs, self.spec.batch_rows, cols=("input_ids",), index_col="split_idx",
                             extra_keys=["split"])

    @cached_property
    def published(self) -> str:
        """Root of the packed ids, written once by split to the shared folder.

        Fitting and scoring read it several times; writing it keeps the
        corpus from being re-tokenized per branch and cuts the lineage.
        Single-use consumers read ``packed`` (the plan) directly.
        """
        root = scratch_path(self.spark, "packed")
        write_packed(self.packed_ids, root, self.spec.table, self.spec.block_size)
        return root

    def blocks(self, split: str) -> DataFrame:
        """One split's blocks; the scan reads that split's files alone."""
        return read_packed(self.spark, self.published, self.spec.table, self.spec.block_size, split).drop("split")

    @cached_property
    def bigram(self) -> DataFrame:
        return N.fit_next_token(self.blocks("train"), id_bound=self.vocab_rows)

    def scored_first(self, n: int) -> DataFrame:
        """Score only the first ``n`` validation blocks (by batch, block): the limit
        goes before scoring, which is per row and independent given the model."""
        first = self.blocks("validation").orderBy(*BLOCK_KEYS).limit(n)
        return N.score_next_token(self.bigram, first, BLOCK_KEYS, self.vocab_rows, self.spec.add_k,
                                  train_blocks=self.blocks("train"), stats_bound=self.vocab_rows)

    @cached_property
    def scored_table(self) -> DataFrame:
        """``scored`` written once, for queries that aggregate it several ways; each reads its own columns."""
        path = scratch_path(self.spark, "scored")
        self.scored.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def scored(self) -> DataFrame:
        return N.score_next_token(self.bigram, self.blocks("validation"), BLOCK_KEYS,
                                  self.vocab_rows, self.spec.add_k,
                                  train_blocks=self.blocks("train"), stats_bound=self.vocab_rows)
