"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from quire.llm import substring_dedup
from quire.llm import words as W


def brute(rows, width):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, tokens):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, tokens):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width,bits", [(13, 14), (4, 14), (4, 3)])
def test_matches_brute_force(spark, width, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WINDOWS", 50 * width)  # several buckets
    monkeypatch.setattr(substring_dedup, "EXCHANGE_BITS", bits)  # several exchanges
    monkeypatch.setattr(substring_dedup, "PARTS_PER_BUCKET", 2 if bits == 3 else 64)
    rng = random.Random(width)
    vocab = ["a", "bé", "𝄞", "c.", "\x1c", " x", "dd", "e"]
    passage = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, passage[0]), (4, "x " * 30000)]
    for i in range(5, 160):
        rows.append((i * 7 % 160, rng.choice([" ", "\n", "  \x0b"]).join(rng.choice(passage) for _ in range(rng.randint(0, 3)))))
    rows += [(9, passage[1]), (9, passage[1]), (9, passage[1] + " tail"), (300, passage[2]), (301, passage[2])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, hashes string").repartition(6)
    got = substring_dedup.substring_dedup(df, width=width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, width)
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed and all(b < a for b, a in zip(r.ends, r.starts[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(df).count() == 0


def test_word_hashes_do_not_depend_on_position(monkeypatch):
    import numpy as np

    monkeypatch.setattr(W, "BLOCK", 16)
    text = "one two one three two one verylongwordbeyondtheblock one".encode()
    data = np.frombuffer(text, np.uint8)
    h = W.Words(data, np.array([0, len(data)])).hashes()
    assert len(set(h[[0, 2, 5, 7]])) == 1 and h[1] == h[4] and len(set(h)) == 4


def test_bytes_of_a_chunk_do_not_grow_with_the_buckets():
    import numpy as np

    rng = np.random.default_rng(1)
    n = 2_000_000
    chunk = [(rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 1 << 24, n, np.uint32), np.repeat(np.sort(rng.integers(0, 10**9, 6000)), n // 6000 + 1)[:n])]
    size = lambda bits: sum(b.nbytes for b in substring_dedup._run_batches(chunk, bits))
    few, many = size(4), size(substring_dedup.EXCHANGE_BITS)
    assert many < 1.3 * few, (few, many)


def test_equal_first_hashes_are_told_apart():
    import numpy as np

    e = substring_dedup.Entries(np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 1, 2], np.uint32), np.array([3, 4, 7, 8]))
    assert sorted(e.docs[e.again].tolist()) == [7, 8]
