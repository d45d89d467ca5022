"""BPE merge learning over a word-count table (T2b) and encoding with it.

Words are distributed as lists of symbol ids.  A round sums adjacent pairs by
the words' counts (partial sums in the tasks), takes the most frequent pairs,
and cuts every word to its runs, the parts whose neighbours are such pairs.
Equal runs of all words are one row with the sum of their counts; at most
``MAX_RUNS`` of them reach the driver, which merges pair after pair (count
desc, then left, right asc) and recounts only the runs that hold the pair, as
long as no pair left out could come next (``merge_runs``).  The tasks then
apply the round's merges to the words that hold one.  The result is that of
one-by-one learning; a round gives from one to thousands of merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship_package, shuffle_partitions

MAX_RUNS = 150_000    # distinct runs that the driver merges in a round
MAX_PAIRS = 200_000   # pairs that a round looks at, at most


def word_counts(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(word, symbols ARRAY<STRING>, n): distinct pre-tokens split into characters."""
    from tessera.operators.tokens import token_counts
    words = token_counts(tokens, tokens_col).withColumnsRenamed({"token": "word", "freq": "n"})
    return words.select("word", F.filter(F.split("word", ""), lambda c: c != "").alias("symbols"), "n")


def next_merges(top, most: int, more: bool, made: set) -> list:
    """The first pairs of ``top`` (ranked rows) that one-by-one learning merges next, in that order.

    The first always.  A further one if it shares no symbol with those before and
    its count is above the next row's: a pair that a merge brings about is at
    most as frequent as some pair sharing a symbol with it, which ranks lower.
    This needs new symbols, so a merge into one of ``made`` ends the list, as a
    symbol doubled does.  ``more``: rows may follow the last of ``top``."""
    taken, used = [], set()
    for i, p in enumerate(top):
        pair = {p["left"], p["right"]}
        follows = top[i + 1]["count"] if i + 1 < len(top) else (None if more else 0)
        if len(taken) == most or (i and (used & pair or len(pair) == 1 or follows is None or follows == p["count"])):
            break
        taken.append(p)
        used |= pair
        word = p["left"] + p["right"]
        if len(pair) == 1 or word in made:
            break
        made.add(word)
    return taken


def _rows(batch):
    """(symbol ids of all words one after the other, offsets of the words, counts) of an Arrow batch ``syms, n``."""
    import numpy as np
    import pyarrow.compute as pc
    lists = batch.column(0)
    lens = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = np.asarray(pc.list_flatten(lists), dtype=np.int64)
    return flat, np.concatenate([[0], np.cumsum(lens)]), np.asarray(batch.column(1), dtype=np.int64)


def _codes(flat, offs):
    """The code of each symbol and its right neighbour in the word (-1: the last of a word)."""
    import numpy as np
    codes = np.full(len(flat), -1, np.int64)
    codes[:-1] = (flat[:-1] << 32) | flat[1:]
    codes[offs[1:] - 1] = -1
    return codes


def _runs(codes, pairs):
    """Starts and ends of the runs of two symbols and more whose neighbours are ``pairs`` (sorted codes)."""
    import numpy as np
    at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
    linked = np.concatenate([[False], pairs[at] == codes]).astype(np.int8)
    step = np.diff(np.append(linked, 0))  # linked[i + 1]: symbol i goes on to the next
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


def _count_fn(batches):
    """(code, count) of adjacent pairs, summed over the task."""
    import numpy as np
    import pyarrow as pa

    def summed(parts):
        pairs = pa.table({"code": np.concatenate([c for c, _ in parts]), "count": np.concatenate([n for _, n in parts])})
        total = pairs.group_by("code", use_threads=False).aggregate([("count", "sum")])  # by hash: sorting all pairs costs more
        return total.column("code").to_numpy(), total.column("count_sum").to_numpy()
    held = []
    for rb in batches:
        if rb.num_rows == 0:
            continue
        flat, offs, n = _rows(rb)
        codes = _codes(flat, offs)
        there = codes >= 0
        held.append(summed([(codes[there], np.repeat(n, np.diff(offs))[there])]))
        if sum(len(c) for c, _ in held) > 1 << 20:
            held = [summed(held)]
            if len(held[0][0]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["code", "count"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], names=["code", "count"])


def _runs_fn(pairs_bc):
    """(run, n): the words' runs as int32 bytes, summed by batch."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        for rb in batches:
            if rb.num_rows == 0:
                continue
            flat, offs, n = _rows(rb)
            starts, ends = _runs(_codes(flat, offs), pairs_bc.value)
            weight = np.repeat(n, np.diff(offs))[starts].tolist()
            buf, held = flat.astype(np.int32).tobytes(), {}
            for a, b, w in zip((4 * starts).tolist(), (4 * ends).tolist(), weight):
                run = buf[a:b]
                held[run] = held.get(run, 0) + w
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                             names=["run", "n"])
    return fn


def _merge(syms: list, a, b, c) -> list:
    """Every non-overlapping ``a b``, scanning left to right, becomes ``c``."""
    out, k, last = [], 0, len(syms) - 1
    while k <= last:
        if k < last and syms[k] == a and syms[k + 1] == b:
            out.append(c)
            k += 2
        else:
            out.append(syms[k])
            k += 1
    return out


def _replay(syms: list, ranks: dict) -> list:
    """Apply a round's merges one after the other; ``ranks``: pair -> ascending (rank, merged symbol)."""
    done = -1
    while len(syms) > 1:
        best = None
        for pair in zip(syms, syms[1:]):
            for r, c in ranks.get(pair, ()):
                if r > done and (best is None or r < best[0]):
                    best = (r, *pair, c)
        if best is None:
            break
        done = best[0]
        syms = _merge(syms, *best[1:])
    return syms


def _apply_fn(bc):
    """The words after a round's merges; a word of one symbol has no pair to give and goes."""
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        pairs, ranks = bc.value
        memo = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            flat, offs, n = _rows(rb)
            starts, ends = _runs(_codes(flat, offs), pairs)
            buf, stay = flat.astype(np.int32).tobytes(), np.ones(len(flat), bool)
            for a, b in zip(starts.tolist(), ends.tolist()):
                run = buf[4 * a:4 * b]
                if run not in memo:
                    old = flat[a:b].tolist()
                    new = _replay(old, ranks)
                    memo[run] = np.array(new, np.int64) if len(new) < len(old) else None
                new = memo[run]
                if new is not None:
                    flat[a:a + len(new)] = new
                    stay[a + len(new):b] = False
            lens = np.diff(np.concatenate([[0], np.cumsum(stay)])[offs])
            more = lens > 1
            flat = flat[stay & np.repeat(more, np.diff(offs))]
            offs = np.concatenate([[0], np.cumsum(lens[more])])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(n[more])], names=["syms", "n"])
    return fn


def merge_runs(runs: list, names: list, ids: dict, most: int, floor: int, hidden: bool) -> list:
    """Merge ``runs`` [(symbol ids, n)] pair after pair, up to ``most`` times: [(left, right, merged, count)].

    Pairs left out of the runs have a count of at most ``floor``, and so has any
    pair that a merge makes beside one of them, so the merges go on while the
    best count is above it.  This needs new symbols: where pairs are ``hidden``,
    a merge into a symbol known before is the last.  Appends new symbols to ``names`` and ``ids``."""
    import heapq
    counts, where = {}, {}
    for i, (syms, n) in enumerate(runs):
        for pair in zip(syms, syms[1:]):
            counts[pair] = counts.get(pair, 0) + n
            where.setdefault(pair, set()).add(i)
    entry = lambda pair: (-counts[pair], names[pair[0]], names[pair[1]], pair)
    heap = [entry(p) for p, n in counts.items() if n > floor]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < most:
        top = heapq.heappop(heap)
        pair = top[3]
        if counts.get(pair, 0) != -top[0]:
            continue
        name = names[pair[0]] + names[pair[1]]
        known = name in ids
        if not known:
            ids[name] = len(names)
            names.append(name)
        out.append((*pair, ids[name], -top[0]))
        changed = {}
        for i in where.pop(pair):
            old, n = runs[i]
            new = _merge(old, *out[-1][:3])
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                changed[p] = changed.get(p, 0) - n
            for p in zip(new, new[1:]):
                changed[p] = changed.get(p, 0) + n
                if p != pair:
                    where.setdefault(p, set()).add(i)
            runs[i] = (new, n)
        for p, by in changed.items():
            if by:
                counts[p] = counts.get(p, 0) + by
                if counts[p] > floor:
                    heapq.heappush(heap, entry(p))
        if known and hidden:
            break
    return out


def tied_merges(total: DataFrame, best: int, names: list, ids: dict, most: int, size: int) -> list:
    """The next merges [(left, right, merged, count)] among pairs that share the best count, by their symbols' names.

    The tie is ordered in Spark, and ``size`` pairs at most come to the driver.  A merge can bring another pair up to the
    count of the tie only where a tied pair begins with its right symbol or ends with its left one.  So all
    pairs up to the first such one follow each other as they stand; that one is taken if it is the first."""
    spark = total.sparkSession
    symbols = spark.createDataFrame(list(enumerate(names)), "id int, name string")  # the alphabet and the merges so far
    tie = total.filter(F.col("count") == best).select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"))
    named = (tie.join(symbols.toDF("a", "left"), "a").join(symbols.toDF("b", "right"), "b")
             .orderBy("left", "right").limit(min(size, most)))
    starts, ends = tie.select(F.col("a").alias("b"), F.lit(True).alias("on")).distinct(), tie.select(F.col("b").alias("a"), F.lit(True).alias("to")).distinct()
    rows = named.join(starts, "b", "left").join(ends, "a", "left").orderBy("left", "right").collect()
    out = []
    for r in rows:
        linked = bool(r["on"] or r["to"])
        if linked and out:
            break
        word = r["left"] + r["right"]
        known = word in ids
        if not known:
            ids[word] = len(names)
            names.append(word)
        out.append((r["a"], r["b"], ids[word], best))
        if linked or known:
            break
    return out


def learn_bpe(words: DataFrame, n_merges: int, checkpoint_every: int = 10, per_round: int = 4096) -> DataFrame:
    """Learn up to ``n_merges`` merges (fewer: no pair is left).  Returns (rank, left, right, count).

    ``per_round``: pairs that the first round looks at; later rounds take
    more or fewer, as many as give at most ``MAX_RUNS`` distinct runs.  The alphabet, the
    merges and ``MAX_PAIRS`` pairs with their runs are all that the driver holds.  Each
    round's word table is persisted, and checkpointed every ``checkpoint_every`` rounds to cut lineage.
    """
    import numpy as np
    from pyspark import StorageLevel
    spark = words.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    share = spark.sparkContext.broadcast
    words = words.select("symbols", "n").repartition(shuffle_partitions(spark)).checkpoint(eager=True)
    names = sorted(r[0] for r in words.select(F.explode("symbols")).distinct().collect())
    ids = {c: i for i, c in enumerate(names)}
    cur = words.filter(F.size("symbols") > 1).mapInArrow(_ids_fn(share(dict(ids))), _SYMS)
    merges, old, size, r = [], None, max(1, per_round), 0
    tied = False
    while len(merges) < n_merges:
        cur = cur.checkpoint(eager=True) if r and r % checkpoint_every == 0 else cur.persist(StorageLevel.MEMORY_AND_DISK)
        total = cur.mapInArrow(_count_fn, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))
        total = total.persist(StorageLevel.MEMORY_AND_DISK)
        while True:
            top = total.orderBy(F.desc("count")).limit(size + 1).toPandas()
            hidden = len(top) > size
            floor = int(top["count"].iloc[-1]) if hidden else 0
            tied = hidden and floor == top["count"].iloc[0]  # the most frequent pairs are more than were looked at
            if tied:
                break
            top = top[top["count"] > floor]
            if not len(top):
                break
            pairs = np.sort(top["code"].to_numpy())
            runs = (cur.mapInArrow(_runs_fn(share(pairs)), "run binary, n long").groupBy("run")
                    .agg(F.sum("n").alias("n")).limit(MAX_RUNS + 1).toArrow())
            if runs.num_rows <= MAX_RUNS or size == 1:
                break
            size = max(1, size // 4)  # each try reads all words
        left = n_merges - len(merges)
        if tied:
            now = tied_merges(total, floor, names, ids, left, size)
            pairs = np.sort(np.array([a << 32 | b for a, b, _, _ in now], np.int64))
        if old is not None:
            old.unpersist()
        total.unpersist()
        if not len(top):
            break
        if tied:
            pass
        elif runs.num_rows <= MAX_RUNS:
            rows = [(np.frombuffer(s, np.int32).tolist(), n) for s, n in zip(runs.column(0).to_pylist(), runs.column(1).to_pylist())]
            now = merge_runs(rows, names, ids, left, floor, hidden)
        else:  # a tie so wide that its runs are too many: the merges known from the ranking alone
            ranked = sorted(({"left": names[c >> 32], "right": names[c & 0xFFFFFFFF], "count": int(n)}
                             for c, n in zip(top["code"].tolist(), top["count"])), key=lambda p: (-p["count"], p["left"], p["right"]))
            now = []
            for p in next_merges(ranked, left, True, set(ids)):
                name = p["left"] + p["right"]
                if name not in ids:
                    ids[name] = len(names)
                    names.append(name)
                now.append((ids[p["left"]], ids[p["right"]], ids[name], p["count"]))
        if tied or runs.num_rows * 2 <= MAX_RUNS:
            size = min(MAX_PAIRS, size * 2)
        ranks: dict = {}
        for k, (a, b, c, n) in enumerate(now):
            merges.append((len(merges), names[a], names[b], int(n)))
            ranks.setdefault((a, b), []).append((k, c))
        old, r = cur, r + 1
        cur = cur.mapInArrow(_apply_fn(share((pairs, ranks))), _SYMS)
    return spark.createDataFrame(merges, "rank int, left string, right string, count long")


_SYMS = "syms array<int>, n long"


def _ids_fn(ids_bc):
    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        alphabet = pa.array(list(ids_bc.value), pa.string())  # in the order of the ids
        for rb in batches:
            lists = rb.column(0)
            flat = pc.index_in(pc.cast(pc.list_flatten(lists), pa.string()), alphabet)
            lens = pc.fill_null(pc.list_value_length(lists), 0)
            offs = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(lens, pa.int64()))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offs.cast(pa.int32()), flat), rb.column(1)],
                                             names=["syms", "n"])
    return fn


def read_merges(spark, path: str) -> DataFrame:
    """A ``merges.txt`` (optional ``#version`` header, then ``left right`` per line)
    → (rank, left, right); rank follows line order."""
    lines = spark.read.text(path).withColumn("__i", F.monotonically_increasing_id())
    body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.col("value"), " ")
    from tessera.operators.rowindex import with_row_index
    ranked = with_row_index(body.select("__i", parts.getItem(0).alias("left"),
                                        parts.getItem(1).alias("right")), "__i", "rank")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "left", "right")


def _segment(word: str, ranks: dict) -> list[str]:
    """Greedy BPE: merge the lowest-ranked adjacent pair, everywhere, until none is left."""
    syms = list(word)
    while len(syms) > 1:
        best = min(zip(syms, syms[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        merged, k = [], 0
        while k < len(syms):
            if k + 1 < len(syms) and (syms[k], syms[k + 1]) == best:
                merged.append(syms[k] + syms[k + 1])
                k += 2
            else:
                merged.append(syms[k])
                k += 1
        syms = merged
    return syms


def _ranks(merges: DataFrame) -> dict:
    """(left, right) → rank.  As many entries as merges, which the vocabulary size bounds."""
    tbl = merges.orderBy("rank").select("left", "right").toArrow()
    pairs = zip(tbl.column("left").to_pylist(), tbl.column("right").to_pylist())
    return {p: k for k, p in enumerate(dict.fromkeys(pairs))}


def segment_words(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(word) → (word, pieces ARRAY<STRING>) by the merge ranks (broadcast)."""
    spark = words.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(_ranks(merges))

    def fn(batches):
        for pdf in batches:
            yield pdf.assign(pieces=[_segment(w, bc.value) for w in pdf["word"]])
    return words.select("word").mapInPandas(fn, "word string, pieces array<string>")


def bpe_vocab(words: DataFrame, merges: DataFrame, specials=("<unk>", "<|endoftext|>", "<|MASK|>")) -> DataFrame:
    """Sub-word vocabulary: the distinct characters of the words (sorted), then one
    symbol per merge in rank order, then the specials."""
    chars = (words.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("token"))
             .distinct().withColumn("__o", F.lit(0)).withColumn("__r", F.lit(0)))
    merged = merges.select(F.concat("left", "right").alias("token"), F.lit(1).alias("__o"),
                           F.col("rank").alias("__r"))
    sp = spark_specials(words.sparkSession, specials)
    allt = chars.unionByName(merged).unionByName(sp)
    first = Window.partitionBy("token").orderBy("__o", "__r")
    allt = allt.withColumn("__d", F.row_number().over(first)).filter(F.col("__d") == 1)
    w = Window.orderBy("__o", "__r", "token")
    return allt.select("token", (F.row_number().over(w) - 1).cast("int").alias("token_id"),
                       (F.col("__o") == 2).alias("is_special"))


def spark_specials(spark, specials):
    return spark.createDataFrame([(t, 2, i) for i, t in enumerate(specials)], "token string, __o int, __r int")


MEMO_WORDS = 200_000  # segmented words that a task remembers


def _segment_tables(ranks: dict, ids: dict, unk_id) -> tuple:
    """The merges as arrays: (sorted pair codes, their ranks, their merged symbols, symbol of each character, vocabulary id of each symbol).

    -1: a symbol that the vocabulary lacks, where it has no ``<unk>``."""
    import numpy as np
    symbols: dict = {}
    for a, b in ranks:
        for name in (a, b, a + b):
            symbols.setdefault(name, len(symbols))
    codes = np.array([symbols[a] << 32 | symbols[b] for a, b in ranks], np.int64)
    order = np.argsort(codes)
    merged = np.array([symbols[a + b] for a, b in ranks], np.int64)[order]
    none = -1 if unk_id is None else unk_id
    own = np.array([ids.get(name, none) for name in symbols], np.int64)
    return codes[order], np.array(list(ranks.values()), np.int64)[order], merged, {c: i for c, i in symbols.items() if len(c) == 1}, own


def _segment_ids(words: list, tables: tuple, ids: dict, unk_id) -> list:
    """The ids of ``_segment``'s pieces of each word, all words at once: a step merges each word's lowest-ranked pair, and words without one leave."""
    import numpy as np
    codes, ranks, merged, chars, own = tables
    none, never = -1 if unk_id is None else unk_id, np.iinfo(np.int64).max
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points, at = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), return_inverse=True)
    letters = [chr(c) for c in points.tolist()]
    table = np.concatenate([own, np.array([ids.get(c, none) for c in letters], np.int64)])  # characters of no merge come after the symbols
    syms = np.array([chars.get(c, len(own) + i) for i, c in enumerate(letters)], np.int64)[at]
    row, done = np.repeat(np.arange(len(words)), sizes), []
    while len(syms):
        rank, new = np.full(len(syms), never), np.zeros(len(syms), np.int64)
        if len(codes):
            code = syms[:-1] << 32 | syms[1:]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = (codes[place] == code) & (row[:-1] == row[1:])
            rank[:-1][known], new[:-1] = ranks[place[known]], merged[place]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        starts = np.flatnonzero(first)
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(row))))
        ended = best == never
        done.append((row[ended], syms[ended]))
        pick = (rank == best) & ~ended
        begin = pick & ~np.concatenate([[False], pick[:-1]])
        since = np.arange(len(pick)) - np.maximum.accumulate(np.where(begin, np.arange(len(pick)), 0))
        pick &= since % 2 == 0  # of a symbol repeated, every second pair
        syms = np.where(pick, new, syms)
        stay = ~ended & ~np.concatenate([[False], pick[:-1]])
        syms, row = syms[stay], row[stay]
    rows, found = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
    out = table[found[np.argsort(rows, kind="stable")]].tolist()
    if unk_id is None:
        out = [None if i < 0 else i for i in out]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(words)))]).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _encode_fn(tables_bc, ids_bc, unk_id, in_col, out_col):
    def fn(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        tables, ids, memo = tables_bc.value, ids_bc.value, {}
        for rb in batches:
            lists = rb.column(rb.schema.get_field_index(in_col))
            flat = pc.dictionary_encode(pc.list_flatten(lists))   # this slice's pre-tokens only
            words = flat.dictionary.to_pylist()
            new = [w for w in words if w not in memo]
            if len(memo) + len(new) > MEMO_WORDS:
                memo, new = {}, words
            memo.update(zip(new, _segment_ids(new, tables, ids, unk_id)))
            per_word = [memo[w] for w in words]
            table = pa.array([*per_word, [unk_id]], pa.list_(pa.int32()))
            per_tok = pc.take(table, pc.fill_null(flat.indices, len(per_word)))
            lens = np.asarray(pc.list_value_length(per_tok), dtype=np.int64)
            cum = np.concatenate([[0], np.cumsum(lens)])
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            offs = cum[np.concatenate([[0], np.cumsum(sizes)])]
            out = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pc.list_flatten(per_tok),
                                           mask=lists.is_null())
            keep = [i for i, n in enumerate(rb.schema.names) if n != in_col]
            yield pa.RecordBatch.from_arrays([rb.column(i) for i in keep] + [out],
                                             names=[rb.schema.names[i] for i in keep] + [out_col])
    return fn


def encode_bpe(tokens: DataFrame, merges: DataFrame, vocab: DataFrame, keep=(),
               tokens_col: str = "tokens") -> DataFrame:
    """Pre-tokens → sub-word ``input_ids``: any word, by the merges alone, no shuffle.

    Merges and vocabulary are broadcast (both bounded by the vocabulary size);
    the distinct pre-tokens of each Arrow batch are segmented there.  A piece
    that the vocabulary lacks becomes ``<unk>``; a NULL array stays NULL.
    """
    from pyspark.sql import types as T
    spark = tokens.sparkSession
    ship_package(spark)
    ids = {r["token"]: r["token_id"] for r in vocab.select("token", "token_id").collect()}
    share, unk = spark.sparkContext.broadcast, ids.get("<unk>")
    tables, ib = share(_segment_tables(_ranks(merges), ids, unk)), share(ids)
    base = tokens.select(*keep, tokens_col)
    schema = T.StructType([f for f in base.schema.fields if f.name != tokens_col]
                          + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    return base.mapInArrow(_encode_fn(tables, ib, unk, tokens_col, "input_ids"), schema)
