"""Jaccard join against brute force."""

import random

import pytest

from quire.llm import jaccard
from quire.llm.components import components


def brute(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in near[i]:
            root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), str(least.get(find(i))), len(near[i])) for i in range(n))


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (6, "one two three"), (None, "a null id text with some words in it"), (7, "x " * 20000)]
    i = 10
    shared = " ".join(word() for _ in range(60))
    for size in [1] * 60 + [2] * 20 + [7, 30, 130]:
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy) + (" " + shared if rng.random() < 0.2 else "")))
            i += 1
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 40)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(6)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.jaccard_join(df).collect())
    want = brute(rows)
    assert [g for g in got if g not in want] == [(str(r[0]), str(r[0]), 0) for r in rows if r[0] in (1, 2, 3) and (str(r[0]), str(r[0]), 0) not in want]


def test_leaders_keep_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    rows = corpus()[8:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.jaccard_join(df).collect())
    assert got == brute(rows)
    assert jaccard.jaccard_join(df.limit(0)).count() == 0
    assert jaccard.near_dedup(df).count() == len({c for _, c, _ in got})


@pytest.mark.parametrize("local", [20, 8192])
def test_a_passage_that_many_dissimilar_texts_share_is_split_further(spark, local, monkeypatch):
    """400 texts that share a third of their words beside near copies: no bucket of all of them is compared as a whole."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "PART", 64)
    monkeypatch.setattr(jaccard, "LOCAL", local)
    rng = random.Random(3)
    shared = " ".join(f"legal{i}" for i in range(25))
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        rows += [(2 * i, f"{shared} {' '.join(own)}"), (2 * i + 1, f"{shared} {' '.join(own[:-1])} end")][: 2 if i % 10 == 0 else 1]
    depth = []
    name = "_children" if local < 400 else "_split"
    monkeypatch.setattr(jaccard, name, lambda *t, f=getattr(jaccard, name): depth.append(t) or f(*t))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == brute(rows) and depth


def test_recall_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(5, 5)],
        [(i, i + 1) for i in range(40)],
        [(99, i) for i in range(30)] + [(3, 200), (200, 150), (150, 3)],
        [(random.Random(i).randrange(300), random.Random(i + 1000).randrange(300)) for i in range(170)] * 2,
    ],
)
def test_components_equal_a_union_of_sets(spark, edges):
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(n):
        return n if parent[n] == n else root(parent[n])

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, root(n)) for n in parent)


def test_components_write_few_files(spark):
    """However many partitions the exchanges have."""
    from pathlib import Path

    from quire.llm import components as C
    from quire.llm import store

    store.shared_folder(spark)
    root = Path("/" + spark.sparkContext.getCheckpointDir().split(":", 1)[-1].lstrip("/"))
    before, old = set(root.glob("rdd-*")), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("61", "false"), strict=True):
            spark.conf.set(k, v)
        got = C.components(spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "a long, b long")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in got} == {i: i - i % 10 for i in range(300)}
    made = [len(list(d.glob("part-*"))) for d in set(root.glob("rdd-*")) - before]
    assert made and max(made) <= 4 * spark.sparkContext.defaultParallelism < 61
