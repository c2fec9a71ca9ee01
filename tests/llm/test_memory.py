"""Python workers stand beside the JVM in an executor's memory: what an operator takes at once, and what it leaves."""

import ctypes
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontaminate, memory, mixing
from quire.llm import pseudo_likelihood as P


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def anonymous_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_decontamination_works_on_small_slices():
    """slices of 4 MB took some 230 MB beside the batch."""
    words = np.char.add("word", np.random.default_rng(1).integers(0, 9000, 900_000).astype(str))
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    batch = pa.record_batch([pa.array(texts), pa.array([[]] * len(texts), pa.list_(pa.int64()))], ["text", "hits"])
    assert batch.nbytes > 6_000_000
    run = decontaminate._scan([1], [texts[7]], "text", 8, 0.5, 13, 0.5, True)
    assert peak_mb(lambda: sum(1 for _ in run(iter([batch.slice(10)])))) < 120


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_map_tasks_give_memory_back():
    """what a task had freed stayed with its worker, beside the JVM and the next operator."""
    kept = []

    def run(batches):
        arrays = [np.ones(12_000) for _ in range(1500)]  # 96 KB each, from the heap
        kept.append(arrays[-1])  # so that the heap's end stays
        del arrays
        kept.append(anonymous_mb())
        yield from batches

    before = anonymous_mb()
    batch = pa.record_batch([pa.array([1])], ["x"])
    assert list(memory.lean(run)(iter([batch]))) == [batch]
    assert kept[1] - before > 100 and anonymous_mb() - before < 30


def test_goals_start_no_python_workers(spark):
    """a list of rows made a Python RDD, whose workers stay for the rest of the application."""
    totals = spark.createDataFrame([("b", 30), (None, 5), ("a", 10)], "source string, size long")
    goals = mixing._goals(totals, mixing.cyclic_weights(5, 2, 1), 3.0, "string")
    assert "RDD" not in goals._jdf.queryExecution().executedPlan().toString()
    assert [(r._source, r._size, type(r._target)) for r in goals.collect()] == [("a", 10, float), ("b", 30, float), (None, 5, float)]
    none = mixing._goals(totals.where("false"), mixing.cyclic_weights(5, 2, 1), 3.0, "string")
    assert none.collect() == [] and none.schema == goals.schema


def packed(n: int, bits: int = 1) -> pa.Table:
    """Tokens of one bucket as `_emit` packs them, some contexts with many."""
    rng = np.random.default_rng(2)
    contexts = P.W.mix((rng.zipf(1.2, n) % 400_000).astype(np.uint64)) >> np.uint64(bits)
    words = rng.integers(0, 50, n).astype(np.uint32)
    batches = []
    for k in range(0, n, n // 4):
        size = len(words[k : k + n // 4])
        places = np.sort(rng.integers(0, size // 300 + 1, size)).astype(np.uint32)
        batches += P._pack(contexts[k : k + size], words[k : k + size], np.full(size, 10 + k), places, rng.integers(1, 200, size).astype(np.uint8), bits)
    return pa.Table.from_batches(batches)


def test_tokens_meet_in_bounded_memory():
    """the comparison took some 120 bytes a token of a bucket beside the packed ones, all at once."""
    table = packed(1_000_000)
    assert peak_mb(lambda: P._meet(1, 41)(table)) < 60


def test_scores_do_not_depend_on_how_many_tokens_meet_at_a_time(monkeypatch):
    table = packed(20_000)

    def sums():
        rows = P._meet(1, 41)(table).to_pylist()
        return sorted((r["chunk"], r["places"], r["totals"], r["counts"]) for r in rows)

    monkeypatch.setattr(P, "MEET_TOKENS", 1 << 40)
    at_once = sums()
    for some in (10_000, 3, 50):
        monkeypatch.setattr(P, "MEET_TOKENS", some)
        assert sums() == at_once
    contexts, words, chunks, places, logs = map(np.concatenate, zip(*[P._unpacked(r, 1) for r in table.to_pylist()], strict=True))
    same, there = {}, {}
    for c, w in zip(contexts.tolist(), words.tolist(), strict=True):
        same[c, w], there[c] = same.get((c, w), 0) + 1, there.get(c, 0) + 1
    expected = {}
    for c, w, chunk, place, log in zip(*(x.tolist() for x in (contexts, words, chunks, places, logs)), strict=True):
        value = np.round(1e6 * np.log((same[c, w] - 1 + P.PRIOR * np.exp(-P.LOG_STEP * log)) / (there[c] - 1 + P.PRIOR)))
        expected[chunk, place] = expected.get((chunk, place), 0) + int(value)
    got = {}
    for chunk, p, totals, _ in at_once:
        kind = np.int32 if 2 * len(totals) == 4 * len(p) else np.int64
        got |= {(chunk, place): total for place, total in zip(np.frombuffer(p, np.uint16).tolist(), np.frombuffer(totals, kind).tolist(), strict=True)}
    assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) <= 50  # sums of roundings
