"""Mixing: targets, quotas, whole and disjoint draws."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing

SCHEMA = "doc_id long, source string, text string, mix string"


def rows():
    rng = np.random.default_rng(3)
    out = [(i, f"s{i % 4}", "w " * int(rng.integers(0, 40)), "x") for i in range(800)]
    return [*out, (None, "s1", "a b", None), (900, None, "é ü", None), (901, None, None, None), (1, "s1", out[1][2], "x"), (902, "long", "word " * 30000, None), (903, "empty", "", None)]


def test_targets_reshare():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210, 3) == [30.0, 120.0, 60.0]
    assert mixing.targets([], [], 0, 3) == [] and mixing.targets([0, 0], [5, 2], 0, 3) == [0, 0]
    got = mixing.targets([1, 1, 1000], [5, 2, 1], 1002, 3)
    assert got == [3, 3, 996]


def slow_targets(sizes, weights, total, most):
    """The contract word for word: whoever is above its bound stops there, the excess goes to the others by weight, again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else left * weights[i] / weight
        free -= set(over or free)
    return out


def test_targets_equal_the_contract_word_for_word():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 30)) ** 2]
        weights = [float((5, 2, 1)[i % 3]) for i in range(len(sizes))]
        assert np.allclose(mixing.targets(sizes, weights, sum(sizes), 3), slow_targets(sizes, weights, sum(sizes), 3))


def test_tree_splits_exactly():
    quotas = np.array([700, 0, 13, 5000])
    cells = mixing.split_blocks(quotas, 13, np.random.default_rng(1))
    assert cells.sum(0).tolist() == quotas.tolist() and np.ptp(cells.sum(1)) <= 4


def test_shards_draw_disjoint_blocks():
    words = np.random.default_rng(4).integers(0, 50, mixing.BLOCKS)
    held = mixing.draw(words, int(words.sum()), 2.4 * words.sum(), 3, 7, 1, "s")
    copies = np.array([len(h) for h in held])
    assert abs((copies * words).sum() - 2.4 * words.sum()) <= 50 and set(copies[words > 0]) == {2, 3} and not copies[words == 0].any()
    dealt = np.bincount([s for h in held for s in h], minlength=7)
    assert np.ptp(dealt) <= 3


def brute_sizes(all_rows):
    """(id, size, size of the source, target) from the texts by a plain loop."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t, _ in all_rows]
    names = sorted({s for _, s, *_ in all_rows if s is not None}) + [None]
    total = {n: sum(k for k, r in zip(size, all_rows) if r[1] == n) for n in names}
    goal = dict(zip(names, slow_targets([total[n] for n in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], sum(size), 3)))
    return sorted((str(r[0]), k, total[r[1]], round(goal[r[1]], 6)) for k, r in zip(size, all_rows))


@pytest.mark.parametrize("bound", [1000, 2])
def test_mix_meets_targets_and_repeats(spark, bound, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    df = spark.createDataFrame(rows(), SCHEMA)
    first, sources = mixing.mix(df.repartition(3), shards=8)
    again, _ = mixing.mix(df.repartition(7, "doc_id"), shards=8)
    pick = lambda d: sorted(map(str, d.select("doc_id", "source", "mix").collect()))
    assert pick(first) == pick(again) and first.count() == len(rows())
    counted = mixing.drawn_counts(df.repartition(5), shards=8).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6)) for r in counted) == brute_sizes(rows())
    planned = first.select("doc_id", F.size("mix.shards").alias("n"), "mix.size").collect()
    assert sorted((str(r.doc_id), r.n, r["size"] * r.n) for r in planned) == sorted((str(r.doc_id), r.copies, r.taken) for r in counted)
    by_goal: dict = {}
    for r in counted:
        assert r.taken <= 3 * r.size
        by_goal[r.target] = by_goal.get(r.target, 0) + r.taken
    assert sum(abs(v - t) > 40 for t, v in by_goal.items()) <= 2  # one long text, and two sources of a word or none
    mixed = mixing.mixed_rows(first)
    assert mixed.columns == ["doc_id", "source", "text", "shard"]
    counts = first.select(F.explode("mix.shards").alias("shard")).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in counts} == {r.shard: r["count"] for r in mixed.groupBy("shard").count().collect()}
    empty, none = mixing.mix(df.limit(0))
    assert empty.count() == 0 and none.count() == 0 and mixing.drawn_counts(df.limit(0)).count() == 0


def test_thousands_of_sources(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('host', id % 2500) AS source", "repeat('word ', 1 + id % 7) AS text")
    got = mixing.drawn_counts(df).collect()
    assert len(got) == 4000 and all(r.copies <= 3 for r in got)
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) < 0.2 * sum(r.size for r in got)
