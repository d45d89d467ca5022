"""Numpy kernels for lists of token ids, run by Spark on Arrow batches.

They keep a bounded amount of memory: a batch of lists at a time, and counts that are folded and handed on.
"""

from __future__ import annotations

import numpy as np

FOLD_BYTES = 8 << 20  # codes held before they are folded into counts: folding takes some ten times that
MAX_CODES = 1_000_000  # distinct codes held before they are handed on
GIVEN_CODES = 1 << 18  # codes of a batch that is handed on
RUN_TOKENS = 1 << 18  # tokens of the lists that are worked on at once, about


class CodeCounts:
    """Occurrences of int64 codes in one task: folded at ``FOLD_BYTES``, handed on at ``MAX_CODES`` distinct codes.

    What is handed on are partial counts; a ``groupBy(code).sum`` makes them whole."""

    def __init__(self, fold_bytes: int | None = None, max_codes: int | None = None):
        self.fold_bytes = FOLD_BYTES if fold_bytes is None else fold_bytes
        self.max_codes = MAX_CODES if max_codes is None else max_codes
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.codes = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def add(self, codes: np.ndarray):
        """Takes codes; yields (codes, counts) when there are too many to hold."""
        step = max(1, self.fold_bytes // 8)
        for i in range(0, len(codes), step):
            self.parts.append(codes[i:i + step])
            self.held += self.parts[-1].nbytes
            if self.held >= self.fold_bytes:
                self._fold()
                if len(self.codes) >= self.max_codes:
                    yield from self._give()

    def finish(self):
        self._fold()
        if len(self.codes):
            yield from self._give()

    def _fold(self) -> None:
        if not self.parts:
            return
        import pyarrow as pa
        import pyarrow.compute as pc
        vc = pc.value_counts(pa.chunked_array(self.parts, type=pa.int64()))
        codes, n = (np.asarray(vc.field(f)) for f in ("values", "counts"))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order].astype(np.int64)
        self.parts, self.held = [], 0
        if not len(self.codes):
            self.codes, self.n = codes, n
            return
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        self.n[at[known]] += n[known]
        where = at[~known]
        self.codes, self.n = np.insert(self.codes, where, codes[~known]), np.insert(self.n, where, n[~known])

    def _give(self):
        codes, n = self.codes, self.n
        self.codes, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(codes), GIVEN_CODES):
            yield codes[i:i + GIVEN_CODES], n[i:i + GIVEN_CODES]


def list_runs(column):
    """An Arrow list column in runs of about ``RUN_TOKENS`` values: (first row, offsets from 0, values); a null list is empty."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    n = len(column)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
    else:
        lengths = np.diff(offsets)
    values = column.values
    start = 0
    while start < n:
        total = np.cumsum(lengths[start:])
        stop = start + max(1, int(np.searchsorted(total, RUN_TOKENS, side="right")))
        lo, hi = int(offsets[start]), int(offsets[stop])
        flat = np.asarray(values.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
        own = lengths[start:stop]
        if own.sum() != hi - lo:  # values below null lists
            keep = np.repeat(own > 0, np.diff(offsets[start:stop + 1]))
            flat = flat[keep]
        yield start, np.concatenate([[0], np.cumsum(own)]), flat.astype(np.int64)
        start = stop


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def pair_starts(offsets: np.ndarray) -> np.ndarray:
    """Positions that have a right neighbour in their own row."""
    last = np.zeros(int(offsets[-1]), bool)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = True
    return np.flatnonzero(~last)


def clipped_matches(row_h: np.ndarray, h: np.ndarray, row_r: np.ndarray, r: np.ndarray, rows: int, max_n: int) -> np.ndarray:
    """(rows, max_n): n-grams of each row's hypothesis found in its reference, each at most as often as there.

    An n-gram is numbered by the rank of (its first n - 1 ids' number, its last id) among all n-grams of the
    run, hypotheses and references together, so numbers are exact for any ids."""
    out = np.zeros((rows, max_n), np.int64)
    row, value = np.concatenate([row_h, row_r]), np.concatenate([h, r])
    side = np.repeat([0, 1], [len(h), len(r)])
    _, word = np.unique(value, return_inverse=True)
    width = int(word.max()) + 1 if len(word) else 1
    gram, at = word.astype(np.int64), np.arange(len(word))
    for n in range(1, max_n + 1):
        if n > 1:  # the gram that begins at ``at`` grows by the word n - 1 places on
            end = at + n - 1
            fits = end < len(row)
            fits[fits] = (row[end[fits]] == row[at[fits]]) & (side[end[fits]] == side[at[fits]])
            at, gram = at[fits], gram[fits]
            _, gram = np.unique(gram * width + word[at + n - 1], return_inverse=True)
        if not len(at):
            break
        key = row[at] * (int(gram.max()) + 1) + gram
        _, own = np.unique(key, return_inverse=True)
        size = int(own.max()) + 1
        hyp = np.bincount(own[side[at] == 0], minlength=size)
        ref = np.bincount(own[side[at] == 1], minlength=size)
        of = np.zeros(size, np.int64)
        of[own] = row[at]
        out[:, n - 1] = np.bincount(of, weights=np.minimum(hyp, ref), minlength=rows).astype(np.int64)
    return out
