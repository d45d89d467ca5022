"""Token ids of the tokenizers library, a pre-token at a time with a bounded memo."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Where the standard library's character classes agree with the vocabulary's own patterns.
PLAIN = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]")
GPT2_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
MEMO, RUN_MEMO = 8 << 20, 8 << 20  # bytes of a generation of what is remembered in dictionaries; there are two of each
KNOWN = 40 << 20  # bytes of the runs remembered in arrays
RUN_CHARS = 64  # nothing longer is remembered
ENTRY = 60  # bytes of an entry besides its key and ids
#: A space with white space on both sides may lie inside a pre-token; the first list is its quick test.
BEFORE_SPACE = [c + " " for c in " \t\n\x0b\f\r\x85\xa0"]
BETWEEN = re.compile(r"\s \s")


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


ALPHABET = byte_alphabet()
SPACE = ALPHABET[32]
ENDS = tuple(".,;:!?)")  # a word and one of these are two pre-tokens


def to_symbols(text: str) -> str:
    """UTF-8 bytes of the text, a character of the alphabet each."""
    return text.encode("utf-8", "replace").decode("latin-1").translate(ALPHABET)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


class _Memo(dict):
    """Text -> its ids as little-endian uint32 bytes, in two generations of at most ``room`` bytes each.

    When the younger one is full it takes the elder's place; what is asked for again moves back, so frequent texts
    stay and rare ones go.
    """

    def __init__(self, room: int):
        super().__init__()
        self.room, self.left, self.elder = room, room, {}

    def keep(self, text: str, ids: bytes) -> None:
        if len(text) > RUN_CHARS:
            return
        self.left -= ENTRY + sys.getsizeof(text) + sys.getsizeof(ids)
        if self.left < 0:
            self.elder = dict(self)
            self.clear()
            self.left = self.room - ENTRY - sys.getsizeof(text) - sys.getsizeof(ids)
        self[text] = ids

    def __missing__(self, text: str) -> bytes:
        ids = self.elder.get(text)
        if ids is None:
            ids = self.made(text)
        self.keep(text, ids)
        return ids


class _Pieces(_Memo):
    """Pre-token -> its ids."""

    def __init__(self, tokenizer):
        super().__init__(MEMO)
        self.model = tokenizer.model

    def made(self, piece: str) -> bytes:
        return self.of(to_symbols(piece))

    def of(self, symbols: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(symbols)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


class _Runs(_Memo):
    """Text between two spaces -> the ids of it and the space before it."""

    def __init__(self, pieces: _Pieces):
        super().__init__(RUN_MEMO)
        self.pieces = pieces

    def of(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, GPT2_WORDS.findall(run)))

    def made(self, run: str) -> bytes:
        if run.isalpha():  # one pre-token, remembered here alone; letters of ASCII are their own symbols
            return self.pieces.of(SPACE + run if run.isascii() else to_symbols(" " + run))
        if run[-1:] in ENDS and run[:-1].isalpha():
            return self[run[:-1]] + self.pieces[run[-1]]
        return self.of(" " + run)


def between(text: str) -> bool:
    """Has the text a space with white space on both sides?"""
    return any(map(text.__contains__, BEFORE_SPACE)) and bool(BETWEEN.search(text))


class ByteBpe:
    """``encode(text)`` equals the library's ids for a byte-level BPE file with the usual word pattern.

    A pre-token's ids do not depend on its neighbours, so each is encoded once
    and remembered, within a number of bytes.  A space starts a pre-token unless white space stands on both its sides, so in other texts
    what lies between two spaces is remembered whole.  Texts with special tokens' strings, or characters
    on which regular-expression engines differ, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.mark = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        self.pieces = _Pieces(self.tokenizer)
        self.runs = _Runs(self.pieces)
        self.known = None

    def whole(self, text: str) -> bool:
        """Does the text go to the library whole?"""
        return bool(not self.plain or PLAIN.search(text) or (self.mark in text and self.special.search(text)))

    def encode(self, text: str):
        import numpy as np
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if between(text):
            return np.frombuffer(self.runs.of(text), dtype="<u4")
        first, *rest = text.split(" ")
        return np.frombuffer(b"".join([self.runs.of(first), *map(self.runs.__getitem__, rest)]), dtype="<u4")

    def encode_all(self, texts: list[str]):
        """Ids of all texts one after another, and each text's number of them: ``encode`` with a run looked up once.

        Texts are cut before their spaces and the runs numbered in Arrow; ids of the distinct ones are taken by number.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        heads, rests = [], []  # a text's ids before its first space (all, if it can't be cut), what follows that space
        for text in texts:
            if self.whole(text) or between(text):
                heads.append(self.encode(text).tobytes())
                rests.append(None)
            else:
                first, space, rest = text.partition(" ")
                heads.append(self.runs.of(first))
                rests.append(rest if space else None)
        runs = pc.split_pattern(pa.array(rests, pa.string()), " ")
        counts = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
        runs = runs.flatten().dictionary_encode()
        ids = pa.concat_arrays([self.ids_of(runs.dictionary), lists(heads)])
        after = np.cumsum(counts + 1)  # each text's head, then its runs
        codes = np.empty(int(after[-1]) if len(after) else 0, "int64")
        is_head = np.zeros(len(codes), bool)
        is_head[after - counts - 1] = True
        codes[is_head] = len(runs.dictionary) + np.arange(len(heads))
        codes[~is_head] = runs.indices.to_numpy()
        taken = ids.take(pa.array(codes))
        ends = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), np.diff(ends[np.concatenate([[0], after])])

    def ids_of(self, runs):
        """Ids of distinct runs.  They are remembered, then those used before them, up to ``KNOWN`` bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if self.known is None:
            self.known = pa.array([], pa.string()), lists([])
        words, their = self.known
        at = pc.index_in(runs, value_set=words)
        new = runs.filter(pc.is_null(at))
        made = lists([self.runs.made(run.as_py()) for run in new])
        missed = pc.is_null(at).to_numpy(zero_copy_only=False)
        where = np.where(missed, len(words) + np.cumsum(missed) - 1, pc.fill_null(at, 0).to_numpy())
        ids = pa.concat_arrays([their, made]).take(pa.array(where))
        other = np.ones(len(words), bool)
        other[where[~missed]] = False
        words, their = pa.concat_arrays([runs, words.filter(pa.array(other))]), pa.concat_arrays([ids, their.filter(pa.array(other))])
        size = np.cumsum(pc.binary_length(words).to_numpy() + 4 * pc.list_value_length(their).to_numpy().astype("int64") + 8)
        n = int(np.searchsorted(size, KNOWN, "right"))
        self.known = words.take(pa.array(np.arange(n))), their.take(pa.array(np.arange(n)))  # copies, not views of all
        return ids


def lists(ids: list[bytes]):
    """An Arrow list a piece of little-endian uint32 bytes."""
    import numpy as np
    import pyarrow as pa
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder a worker process and file, with what it remembers."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
