"""The mapped lookup index: any size, repeats, nulls, both directions."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import tokens as TK


def _open(spark, keys, values):
    name, seed = TK._index_file(spark, keys, values)
    return TK._mapped(name), seed


def test_lookup_finds_every_key_and_no_other(spark):
    keys = pa.array(["a", "b", None, "a", "é", ""])
    table, seed = _open(spark, keys, pa.array([1, 2, 3, 4, 5, 6], pa.int32()))
    got = TK.find_values(table, pa.array(["é", "zz", None, "a", "", "a"]), seed, None).to_pylist()
    assert got == [5, None, None, 1, 6, 1]
    assert TK.find_values(table, pa.array(["q", "b"]), seed, 9).to_pylist() == [9, 2]
    back, _ = _open(spark, pa.array([7, 3, 5, 3], pa.int32()), pa.array(["x", "y", None, "z"]))
    assert TK.find_values(back, pa.array([3, 4, 7, None, 5], pa.int32()), 0, None).to_pylist() == ["y", None, "x", None, None]
    empty, _ = _open(spark, pa.array([], pa.string()), pa.array([], pa.int32()))
    assert TK.find_values(empty, pa.array(["a"]), 0, None).to_pylist() == [None]


def test_colliding_hashes_take_another_seed(spark, monkeypatch):
    real = TK.token_hashes
    monkeypatch.setattr(TK, "token_hashes", lambda t, seed: np.zeros(len(t), np.uint64) if seed == 0 else real(t, seed))
    table, seed = _open(spark, pa.array(["a", "b"]), pa.array([1, 2], pa.int32()))
    assert seed == 1 and TK.find_values(table, pa.array(["b", "a"]), seed, None).to_pylist() == [2, 1]


@pytest.mark.parametrize("n", [4_000_000])
def test_batch_time_does_not_grow_with_the_index(n):
    hashes = lambda m: np.sort(np.random.default_rng(1).integers(0, 2 ** 63, m).astype(np.uint64))
    words = pa.array([f"w{i % 500}" for i in range(20_000)])

    def took(m):
        t = pa.table({"mark": hashes(m), "key": pa.array(["w"] * m), "value": pa.array(np.arange(m), pa.int32())}).combine_chunks()
        best = min(_timed(lambda: TK.find_values(t, words, 0, 0)) for _ in range(5))
        return best
    assert took(n) < 10 * took(n // 1000) + 0.05


def _timed(f):
    t = time.perf_counter()
    f()
    return time.perf_counter() - t
