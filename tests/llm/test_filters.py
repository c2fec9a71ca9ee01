"""Decontamination and toxicity on planted cases and edge cases."""

import random

import numpy as np
import pyarrow as pa

from quire.llm import decontaminate, toxicity

VOCAB = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 99)) + "x" for _ in range(n))


def test_decontaminate_planted(spark):
    rng = random.Random(2)
    asked = "A train leaves Boston at 40 km per hour and Anna rides 3 hours before she meets Paul near the old bridge"
    again = "a train leaves Denver at 70 miles per hour, and Kate rides 5 days before she meets John near the old bridge."
    broken = "A train leaves Boston at 40 km per hour and Anna rides 3 hours before she meets Anna near the old bridge"
    swapped = asked.replace("Paul", "Anna").replace("old bridge", "old bridge and Boston")
    assert broken in swapped
    items = [(0, asked), (1, prose(rng, 30)), (2, "too short"), (3, None), (4, ""), (None, "null id item of the benchmark with many words"), (1, "one more text under the same id with words enough")]
    docs = [
        (0, f"{prose(rng, 50)}. {asked} {prose(rng, 50)}"), (1, f"{prose(rng, 20)}.\n{again} {prose(rng, 9)}"), (2, f"{prose(rng, 20)}. {broken}. {prose(rng, 9)}"),
        (3, items[1][1].upper().replace(" ", ", ")), (4, " ".join(items[1][1].split()[:9]) + " " + prose(rng, 60)), (5, None), (6, ""), (7, "well, too short?"),
        (8, prose(rng, 40000) + ". " + asked), (9, prose(rng, 300)), (9, prose(rng, 10) + " one more text under the same id with words enough"),
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, hits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 2):
        found = [(r.doc_id, [h.item for h in r.hits], [h.changed for h in r.hits]) for r in decontaminate.contaminated(df, bench, block_items=block).collect()]
        hit = {i: (x, c) for i, x, c in found if x}
        assert hit == {0: ([0], [0]), 1: ([0], [7]), 3: ([1], [0]), 7: ([2], [0]), 8: ([0], [0]), 9: ([1], [0])}
    clean = decontaminate.decontaminate(df.drop("hits"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6, 9] and clean.columns == ["doc_id", "text"]
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def brute_hits(text, items, width=8, least=0.5, run=13, most_slots=0.5):
    """Items of a text by plain loops over all offsets, from the same template words."""
    t = decontaminate.Templates(pa.array([text]))
    n, found = len(t.token), {}
    for item, said in items:
        b = decontaminate.Templates(pa.array([said]))
        m, w = len(b.token), min(width, len(b.token))
        if not m:
            continue
        spots = []  # (offset, place in the item) of all equal windows
        for i in range(n - w + 1):
            for j in range(m - w + 1):
                bare = (t.literal[i : i + w] == b.literal[j : j + w]).all()
                slots = int((b.slot[j : j + w] > 0).sum())
                form = 0 < slots <= most_slots * w and (t.token[i : i + w] == b.token[j : j + w]).all()
                if bare or form:
                    spots.append((i - j, j))
        offsets = sorted({o for o, _ in spots})
        groups, near = [], []
        for o in offsets:
            if near and o > near[-1] + decontaminate.SHIFT:
                groups.append(near)
                near = []
            near.append(o)
        groups += [near] if near else []
        for group in groups:
            for some in [[o] for o in group] + [group]:
                words = {j + k: None for o, j in spots if o in some for k in range(w)}
                pairs = {(int(b.literal[j + k]), int(t.literal[o + j + k])) for o, j in spots if o in some for k in range(w) if b.slot[j + k]}
                longest = max((sum(x + k in words for k in range(m)) if all(x + k in words for k in range(run)) else 0 for x in words), default=0)
                fits = len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
                if fits and (len(words) >= least * m or longest >= run):
                    found[item] = max(found.get(item, 0), len(words))
    return found


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(21)
    word = lambda: rng.choice(VOCAB[:8] + ["Anna", "Paul", "Rome", "3", "40", "km", "hours", "12.5"])
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 20, 36])))) for i in range(12)]
    docs = []
    for i in range(150):
        said = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 0, 1, 3])):  # words put in, left out and changed
            k = rng.randrange(len(said))
            said[k : k + rng.choice([0, 1])] = rng.choice([[], [word()], [word(), word()]])
        docs.append((i, f"{prose(rng, 15)}. {' '.join(said[rng.choice([0, 0, 4]) :])} {prose(rng, 15)} {' '.join(word() for _ in range(12))}"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {h.item: h.covered for h in r.hits} for r in decontaminate.contaminated(df, bench, block_items=5).collect()}
    want = {i: brute_hits(t, items) for i, t in docs}
    assert got == want and 20 < sum(map(bool, want.values())) < 150


def test_repeated_items_and_blocks(spark):
    """Two texts under one id: the same hits wherever a block ends; ties and repeated rows count alike."""
    a, b = "one two three four five six seven eight nine ten", "red blue green black white brown pink grey gold plum"
    bench = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{a} and {b}", None), (1, f"{a} and {b}", None), (2, b, None), (None, a, None)], "doc_id long, text string, item string")
    got = [sorted((str(r.doc_id), [(h.item, h.covered) for h in r.hits]) for r in decontaminate.contaminated(df, bench, block_items=k).collect()) for k in (1, 2, 3, 100)]
    assert got[0] == got[1] == got[2] == got[3] == [("1", [(1, 10), (2, 10)])] * 2 + [("2", [(1, 10), (2, 10)]), ("None", [(1, 10)])]


def graded(rng, n):
    texts, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2, 3])
        words = [rng.choice(VOCAB) for _ in range(40)] + [rng.choice(["nasty", "vile", "awful"]) for _ in range(2 * g)] + (["HORRID!"] if g == 3 else [])
        rng.shuffle(words)
        texts.append(" ".join(words) + f" id{rng.random()}")
        grades.append(g)
    return texts, grades


def test_ordinal_regression_held_out(spark):
    rng = random.Random(4)
    texts, grades = graded(rng, 900)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(5000, None, ""), (5001, "", None), (5002, "nasty " * 50000, None)], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades[:600])] + [(None, 1), (1, None), (99999, 2)], "doc_id long, grade int")
    model = toxicity.toxicity_model(docs, labels, label_col="grade", graded=True)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    error = np.mean([abs(got[i].severity - grades[i]) for i in range(600, 900)])
    assert error < 0.5 and np.mean([got[i].toxic == (grades[i] > 0) for i in range(600, 900)]) > 0.97
    assert len(got) == 903 and not got[5000].toxic and not got[5001].toxic and got[5002].toxic
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    blank = toxicity.toxicity_model(docs, labels.limit(0), label_col="grade")
    assert not any(r.toxic for r in toxicity.score_toxicity(docs, blank).collect())


def test_probabilities_sum_to_one():
    f = toxicity.features(pa.array(["a b", None, "c"]))
    model = toxicity.OrdinalModel(f.vocabulary, np.ones(len(f.vocabulary)), np.array([0.0, 1.0]))
    assert np.allclose(model.probabilities(model.scores(f)).sum(1), 1)


def test_places_in_a_vocabulary():
    rng = np.random.default_rng(3)
    vocabulary = np.unique(rng.integers(0, 2**64, 5000, np.uint64))
    asked = np.concatenate([rng.choice(vocabulary, 3000), rng.integers(0, 2**64, 3000, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    want = np.searchsorted(vocabulary, asked)
    want = np.where(vocabulary[np.minimum(want, len(vocabulary) - 1)] == asked, want, -1)
    assert (toxicity._place(vocabulary, asked) == want).all() and (toxicity._place(vocabulary[:1], asked) >= -1).all()
