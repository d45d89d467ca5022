"""BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

A sequence of tokens is the BPE encoding of its symbols exactly when every
token is the encoding of its own symbols and every two neighbours are that of
theirs.  So the encoding of each prefix is the encoding of a shorter prefix
plus one last token, and there is exactly one such token.  The transducer
reads symbols left to right and keeps, for each prefix in a window, its last
token and where that starts: a tree of encodings.

Lookahead: a token is at most ``lookahead`` symbols long (computed from the
merge list), so whatever follows, the encoding passes through one of the last
``lookahead`` prefixes.  Tokens on the common path of all of those are stable
and are emitted; the window keeps only what lies after it.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytebpe import ALPHABET, PLAIN, to_symbols, vocabulary
from tessera.llm.common import table

MEMO_WORDS, MEMO_PAIRS = 400_000, 1_000_000
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
BATCH_BYTES = 8 << 20


class Merges:
    """A merge list: its tokens, the encoding of a few symbols by the list's own rule, and the pair test."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.symbols: dict[int, list[str]] = {}
        self.halves: dict[str, tuple[str, str]] = {}  # of a token: the two that its last merge joins
        made = {a + b: i for i, (a, b) in enumerate(pairs)}
        # every part is made by an earlier merge, so a merge of rank r happens when the ranks below r are done
        self.ordered = all(made.get(a, -1) < i and made.get(b, -1) < i for i, (a, b) in enumerate(pairs))
        self.middle: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token[:-len(suffix)] if ends else token
            symbols = list(body)
            if ends:
                symbols[-1] += suffix
            if len(symbols) > 1:
                halves = tuple(self.merge(symbols, 2)) if token in made else ()
                if halves not in self.rank:
                    continue  # no encoding holds it
                self.halves[token] = halves
            self.symbols[i] = symbols
            (self.final if ends else self.middle)[body] = i
        if not suffix:
            self.final = self.middle
        self.lookahead = max((len(s) for s in self.symbols.values()), default=1)
        # the longest token that ends with these three symbols, so shorter searches suffice
        self.longest_middle: dict[str, int] = {}
        self.longest_final: dict[str, int] = {}
        for tokens, longest in ((self.middle, self.longest_middle), (self.final, self.longest_final)):
            for body in tokens:
                longest[body[-3:]] = max(len(body), longest.get(body[-3:], 2))
        self._pairs: dict[int, bool] = {}

    def merge(self, symbols: list[str], until: int = 1) -> list[str]:
        """The rule itself: again and again join the pair of least rank, the leftmost first, until so few are left."""
        s, rank = list(symbols), self.rank.get
        none = len(self.rank)
        ranks = [rank(p, none) for p in zip(s, s[1:])]
        while len(s) > until and (least := min(ranks)) < none:
            i = ranks.index(least)
            s[i:i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), none)
        return s

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left, right`` is the encoding of their symbols."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = "".join(self.symbols[left]), "".join(self.symbols[right])
            known = self._apart(a, b) if self.ordered else self.merge(self.symbols[left] + self.symbols[right]) == [a, b]
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge joins ``a`` and ``b`` across their border, for an ordered list.

        The pieces that meet at the border grow from the last symbol of ``a``
        and the first of ``b``.  Taken backwards: the piece that was made last is
        halved, and a pair that meets must not have been due before that.
        """
        rank, halves, never = self.rank, self.halves, len(self.rank)
        due_a = due_b = never  # ranks of the merges that take the two pieces away from the border
        while True:
            meet = rank.get((a, b), never)
            if meet < due_a and meet <= due_b and meet < never:
                return False
            part_a, part_b = halves.get(a), halves.get(b)
            made_a, made_b = rank[part_a] if part_a else -1, rank[part_b] if part_b else -1
            if part_b and made_b >= made_a:  # of equal ranks the left one was made first
                b, due_b = part_b[0], made_b
            elif part_a:
                a, due_a = part_a[1], made_a
            else:
                return True


def transduce(merges: Merges, symbols: str) -> Iterator[list[int]]:
    """Token ids of one pre-token, in runs that are emitted once stable; the last symbol ends the word."""
    middle, final, reach, fits = merges.middle, merges.final, merges.lookahead, merges.fits
    longest_middle, longest_final = merges.longest_middle, merges.longest_final
    last, start, base, n = [-1], [0], 0, len(symbols)  # of window position p: the last token, and where it starts
    for i in range(1, n + 1):
        w, find = i - base, (final if i == n else middle).get
        near = (longest_final if i == n else longest_middle).get(symbols[i - 3:i], 2) if i > 2 else i
        for j in range(max(0, w - near), w):
            token = find(symbols[base + j:i])
            if token is not None and (last[j] < 0 or fits(last[j], token)):
                last.append(token)
                start.append(j)
                break
        else:
            raise ValueError(f"no token for symbol {symbols[i - 1]!r}")
        if w >= 8 * reach and i < n:
            live = set(range(w - reach + 1, w + 1))
            while len(live) > 1:
                p = max(live)
                live.remove(p)
                live.add(start[p])
            cut = live.pop()
            if cut:
                yield _path(last, start, cut)
                last, start, base = last[cut:], [0] + [p - cut for p in start[cut + 1:]], base + cut
    if n:
        yield _path(last, start, n - base)


def _path(last: list[int], start: list[int], at: int) -> list[int]:
    out = []
    while at:
        out.append(last[at])
        at = start[at]
    return out[::-1]


class _Words(dict):
    """Pre-token -> its ids as little-endian uint32 bytes, by the transducer; short ones are kept, emptied when full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        ids = np.array([t for run in transduce(self.merges, to_symbols(word)) for t in run], "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """Encodes as the tokenizers library does with a file of this shape: special tokens, NFC, one space, lower case, word pattern, bytes, BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for token, i in (model["vocab"] | self.special).items():
            self.pieces[i] = token
        self.decoder = (spec["decoder"] or {}).get("type")
        self.words = _Words(self.merges)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        pattern = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or pattern is None:
            raise ValueError("a tokenizer file of another shape")
        import regex
        self.any_words = regex.compile(pattern.replace("\\s", SPACES))
        self.any_space = re.compile(f"[{SPACES}]+")

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if PLAIN.search(text):
            text = self.any_space.sub(" ", unicodedata.normalize("NFC", text))
            text = "".join(map(str.lower, text)) if not text.isascii() else text.lower()  # no final-sigma rule
            return self.any_words.findall(text)
        return PLAIN_WORDS.findall(text.lower())

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        if any(map(text.__contains__, self.special)):
            for m in self.special_re.finditer(text):
                out += map(self.words.__getitem__, self.split(text[at:m.start()]))
                out.append(np.array([self.special[m[0]]], "<u4").tobytes())
                at = m.end()
        out += map(self.words.__getitem__, self.split(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<u4")


class Decoder:
    """Incremental decoder: feed ids, get text.  Its state is the unfinished character, or whether a separator is due."""

    def __init__(self, tokenizer: Tokenizer):
        self.pieces, self.kind, self.started = tokenizer.pieces, tokenizer.decoder, False
        self.special = set(tokenizer.special)
        self.back = {ord(c): b for b, c in ALPHABET.items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.kind is None:  # a file without a decoder: pieces with a space between
            text = " ".join(map(self.pieces.__getitem__, ids))
            text, self.started = (" " + text if self.started else text), True
            return text
        out = []
        for i in ids:
            piece = self.pieces[i]
            out.append(piece.encode() if piece in self.special else bytes(self.back[ord(c)] for c in piece))
        return self.utf8.decode(b"".join(out))

    def finish(self) -> str:
        return "" if self.kind is None else self.utf8.decode(b"", True)


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One tokenizer a worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """``docs`` (with ``text``) plus ``ids array<int>`` and, if asked, ``decoded``: the text read back from the ids.

    Null text counts as empty: no ids, empty ``decoded``.  Columns of these
    names in ``docs`` are replaced.
    """
    base = docs.drop("ids", "decoded")
    names, at = base.columns, base.columns.index("text")

    def encode(batches):
        import pyarrow as pa
        tok = load(path)

        def out(part, rows, texts):
            flat = np.concatenate(rows).astype("int32") if rows else np.zeros(0, "int32")
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("int32")
            cols = [*part.columns, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))]
            return pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * decoded, names=[*names, "ids"] + ["decoded"] * decoded)

        for batch in batches:
            first, rows, texts, held = 0, [], [], 0
            for k, value in enumerate(batch.column(at)):
                text = value.as_py() or ""
                ids = tok.encode(text)
                rows.append(ids)
                if decoded:
                    d = Decoder(tok)
                    texts.append(d.feed(ids.tolist()) + d.finish())
                held += 8 * len(ids) + 2 * len(text)
                if held >= BATCH_BYTES:
                    yield out(batch.slice(first, k + 1 - first), rows, texts)
                    first, rows, texts, held = k + 1, [], [], 0
            if rows:
                yield out(batch.slice(first), rows, texts)

    from pyspark.sql import types as T
    fields = [*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    return base.mapInArrow(encode, T.StructType(fields))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode_documents(docs, vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
