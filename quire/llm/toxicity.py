"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from quire.llm import words as W
from quire.llm.memory import lean
from quire.llm.store import prepare

#: Labels that the regression is fitted on at most: of each grade those with the smallest hash of their id.
MAX_TRAIN = 6000
#: Bytes of a word's prefix, a feature of its own.
PREFIX = 6

# bytes of words in lower case (ASCII and Latin-1 letters), punctuation taken as white space
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): the bare lower-case words of all texts and their first ``PREFIX`` bytes, hashed.

    Null texts have none.
    """
    data, bounds = W.text_buffer(column)
    folded = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][upper] += 32
    words = W.Words(folded, bounds)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    stems = W.mix(W.hash_spans(folded, words.starts, np.minimum(words.ends, words.starts + PREFIX)))
    return np.concatenate([words.hashes(), stems]), np.concatenate([row, row])


@dataclass
class Features:
    """Which words of a sorted vocabulary each text has: (slot, row), distinct, in order of row."""

    vocabulary: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    n_rows: int

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Number of the rows in the mask that have each word."""
        return np.bincount(self.slot[mask[self.row]], minlength=len(self.vocabulary))


_index: list = [None, None, 0]


def _place(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted vocabulary, -1 where they are not: the leading bits say where to begin, a few steps find the place."""
    bits = min(26, len(vocabulary).bit_length() + 2)
    if _index[0] is not vocabulary:
        _index[:] = vocabulary, np.searchsorted(vocabulary, np.arange(1 << bits, dtype=W.U64) << W.U64(64 - bits)).astype(np.int32), bits
    at = _index[1][(hashes >> W.U64(64 - bits)).astype(np.int64)]
    place, open_ = np.full(len(hashes), -1), np.arange(len(hashes))
    while len(open_):
        open_ = open_[at[open_] < len(vocabulary)]
        there = vocabulary[at[open_]]
        found = there == hashes[open_]
        place[open_[found]] = at[open_[found]]
        open_ = open_[there < hashes[open_]]
        at[open_] += 1
    return place


def features(column: pa.Array, vocabulary: np.ndarray | None = None) -> Features:
    """Sparse features of texts: the words of a vocabulary, or of their own, that occur in them."""
    hashes, row = word_hashes(column)
    if vocabulary is None:
        vocabulary, slot = np.unique(hashes, return_inverse=True)
    else:
        slot = _place(vocabulary, hashes) if len(vocabulary) else np.full(len(hashes), -1)
        slot, row = slot[slot >= 0], row[slot >= 0]
    size = max(1, len(vocabulary))
    keys = np.unique(row * size + slot)
    return Features(vocabulary, keys % size, keys // size, len(column))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - weights . features); one weight vector for all thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def scores(self, f: Features) -> np.ndarray:
        return np.bincount(f.row, self.weights[f.slot], minlength=f.n_rows)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, (rows, grades)."""
        below = _sigmoid(self.cuts[None, :] - score[:, None])
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _evidence(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Likelihood-ratio statistic of words in a of n and b of m rows, against one common rate."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    rate = (a + b) / (n + m)
    return 2 * (part(a, n * rate) + part(b, m * rate) + part(n - a, n * (1 - rate)) + part(m - b, m * (1 - rate)))


def _trust(f: Features, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, trust) of every word: its evidence against that of the best of as many chance words.

    Trust lies between 0 and 1, is above 0 for every word whose rates differ, and needs no absolute
    count: chance words of a vocabulary of V reach a statistic of some 2 log V.
    """
    n, m = int(toxic.sum()), int((~toxic).sum())
    if not n or not m or not len(f.vocabulary):
        return np.zeros(len(f.vocabulary)), np.zeros(len(f.vocabulary))
    evidence = np.maximum(_evidence(f.counts(toxic), f.counts(~toxic), n, m), 0.0)
    return evidence, evidence / (evidence + 2 * np.log(len(f.vocabulary) + 1))


def fit_ordinal(f: Features, grades: np.ndarray, l2: float = 0.02, steps: int = 600, shares: np.ndarray | None = None) -> OrdinalModel:
    """Fits shared weights and ordered cuts by Adam on the penalised likelihood.

    Cuts are the first one plus positive gaps, so they stay in order. ``grades`` are 0..K-1 with K at
    least 2. Every word of the rows has a weight under the L2 penalty, the stronger the less the word's
    rates in the lowest grade and above differ (``l2`` over the square of its trust); with one grade,
    none has. ``shares``: how many labels each row stands for, 1 by default. Without rows everything
    is taken for grade 0.
    """
    top = max(1, int(grades.max())) if len(grades) else 1
    toxic = grades > 0
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    trust = _trust(f, toxic)[1]
    used = np.flatnonzero(trust > 0)
    slot = np.full(len(f.vocabulary), -1)
    slot[used] = np.arange(len(used))
    keep = slot[f.slot] >= 0
    col, row = slot[f.slot[keep]], f.row[keep]
    scale, size = trust[used], trust[used][col]
    shares = np.ones(len(grades)) if shares is None else shares * (len(grades) / max(1e-12, shares.sum()))
    n = max(1, len(grades))
    share = [(shares[grades <= k].sum() + 0.5) / (n + 1) for k in range(top)]
    first = np.log(share[0] / (1 - share[0]))
    gaps = [np.log(max(1e-3, np.log(b / (1 - b)) - np.log(a / (1 - a)))) for a, b in zip(share, share[1:], strict=False)]
    theta = np.concatenate([np.zeros(len(used)), [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    vocabulary = f.vocabulary[used]
    if not len(grades):
        return OrdinalModel(vocabulary, np.zeros(0), np.array([10.0]))
    if not n_toxic or not n_clean:
        return OrdinalModel(vocabulary, np.zeros(0), np.array([first, *(first + np.cumsum(np.exp(gaps)))]))
    for step in range(1, steps + 1):
        w, cut0, logs = theta[: len(used)], theta[len(used)], theta[len(used) + 1 :]
        cuts = np.concatenate([[cut0], cut0 + np.cumsum(np.exp(logs))])
        score = np.bincount(row, w[col] * size, minlength=len(grades))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = shares * hi * (1 - hi) / p, shares * lo * (1 - lo) / p
        gw = np.bincount(col, (dhi - dlo)[row] * size, minlength=len(used)) + l2 * w
        gc = np.array([-(dhi[grades == k].sum()) + dlo[grades == k + 1].sum() for k in range(top)])
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.concatenate([gw, [gc.sum()], tail[1:] * np.exp(logs)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cut0, logs = theta[len(used)], theta[len(used) + 1 :]
    return OrdinalModel(vocabulary, theta[: len(used)] * scale, np.concatenate([[cut0], cut0 + np.cumsum(np.exp(logs))]))


def _quotas(counts: dict[int, int], most: int) -> dict[int, int]:
    """Rows to take of each grade: equal parts of ``most``, what a rare grade leaves goes to the others."""
    out, left = {}, most
    for i, (grade, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[grade] = min(n, left // (len(counts) - i))
        left -= out[grade]
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as (order, grade, key, words): the key is the smallest window hash, null for short texts."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            words = W.Words(*W.text_buffer(part.column("text")))
            windows = W.window_hashes(words.hashes(), 5) if words.offsets[-1] >= 5 else np.zeros(0, W.U64)
            keys = [int(windows[a : b - 4].min()) - (1 << 63) if b - a >= 5 else None for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
            hashes, row = word_hashes(part.column("text"))
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
            hashes, ends = hashes[new], np.searchsorted(row[new], np.arange(part.num_rows + 1))
            lists = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [part.column("order"), part.column("grade"), pa.array(keys, pa.int64()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["order", "grade", "key", "words"])


def _listed(lists: list[bytes]) -> Features:
    """Features of rows whose words are known as lists of distinct hashes."""
    hashes = np.concatenate([np.frombuffer(x, W.U64) for x in lists]) if lists else np.zeros(0, W.U64)
    vocabulary, slot = np.unique(hashes, return_inverse=True)
    return Features(vocabulary, slot, np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]), len(lists))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str) -> tuple[Features, np.ndarray, np.ndarray]:
    """At most ``MAX_TRAIN`` labelled rows with grades, one of each group with the same rarest word windows.

    The labels are drawn by grade, so that rare grades stay whole; the third result says how many
    labels each row stands for. Near copies of one labelled text would make its accidental words look
    like evidence; texts whose smallest window hash is equal are taken once. Texts stay on the
    executors; the driver gets the hashes of their words.
    """
    none = Features(np.zeros(0, W.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0), np.zeros(0, np.int64), np.zeros(0)
    known = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade"))
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}  # one row per grade
    if not counts:
        return none
    quotas = _quotas(counts, MAX_TRAIN)
    parts = [known.where(F.col("grade") == g).orderBy(F.xxhash64("_id"), "_id").limit(n) for g, n in quotas.items()]
    known = F.broadcast(reduce(DataFrame.unionByName, parts))  # so the texts stay where they are
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(known, "_id")
    rows = rows.select(F.xxhash64(F.xxhash64("_id"), "text").alias("order"), "grade", "text").mapInArrow(lean(_sampled), "order long, grade int, key long, words binary")
    some = rows.orderBy("order", "grade").limit(MAX_TRAIN).toArrow()
    if not some.num_rows:
        return none
    seen, keep = set(), []
    for i, key in enumerate(some.column("key").to_pylist()):
        if key is None or key not in seen:
            seen.add(key)
            keep.append(i)
    some = some.take(pa.array(keep))
    grades = some.column("grade").to_numpy().astype(np.int64)
    return _listed(some.column("words").to_pylist()), grades, np.array([counts[g] / quotas[g] for g in grades.tolist()])


def severity_grades(f: Features, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 (not toxic), 1 and 2 (toxic, by how many telling words a text has).

    A word that occurs more often, as a rate, in toxic texts than in others tells as much as it can be
    trusted not to stand there by chance, from 0 to 1. Toxic texts that hold more than the median of
    those that hold any are grade 2.
    """
    hot = toxic > 0
    a, b = f.counts(hot), f.counts(~hot)
    more = a * max(1, int((~hot).sum())) > b * max(1, int(hot.sum()))
    chance = len(f.vocabulary) * np.exp(-0.5 * _trust(f, hot)[0])
    found = np.bincount(f.row, (more / (1 + chance))[f.slot], minlength=f.n_rows)
    some = found[hot & (found > 0)]
    return np.where(hot, 1 + (found > (np.median(some) if len(some) else 0)), 0).astype(np.int64)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.4) -> DataFrame:
    """Columns of ``docs`` plus ``severity`` (expected grade), ``grade`` (likeliest) and ``toxic``.

    ``toxic``: expected severity at or above ``threshold``. Whole texts are scored; null and empty
    texts have no features and get the base rate of the cuts. Columns of ``docs`` with these names are
    replaced. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    new = {"severity": pa.float64(), "grade": pa.int32(), "toxic": pa.bool_()}
    docs = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col):
                p = model.probabilities(model.scores(features(part.column(text_col), model.vocabulary)))
                severity = p @ np.arange(p.shape[1])
                made = [pa.array(severity, pa.float64()), pa.array(p.argmax(1), pa.int32()), pa.array(severity >= threshold, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *new])

    added = [StructField("severity", DoubleType()), StructField("grade", IntegerType()), StructField("toxic", BooleanType())]
    schema = StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(lean(run), schema)


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", graded: bool = False) -> OrdinalModel:
    """The model fitted on labelled rows; binary labels are first spread over three grades, unless ``graded``."""
    prepare(docs.sparkSession)
    f, marks, shares = training_rows(docs, labels, id_col, text_col, label_col)
    return fit_ordinal(f, marks if graded else severity_grades(f, marks), shares=shares)
