"""Language-model scores: masked pseudo-likelihood of a bidirectional window network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.blas import one_thread
from quire.llm.memory import give_back, lean
from quire.llm.store import prepare, written

#: Bits of hashed words, the network's vocabulary: fewest, and most however large the corpus.
LEAST_BITS, MOST_BITS = 14, 20
#: Word classes, and groups of words in each; every class and group has about the same share of all words.
CLASSES, GROUPS = 32, 32
#: Words seen on either side, and hidden units.
SIDE, HIDDEN = 2, 16
#: Tokens of a gradient step, and its rate.
STEP_TOKENS, RATE = 8192, 0.015
#: Bytes of text that a training shard holds, and shards whose weights one task adds up.
SHARD_BYTES, FAN_IN = 8 << 20, 64
#: Occurrences that the network's own prediction counts for beside those of the corpus.
PRIOR = 1.0
#: Tokens that a task packs at a time, and that a bucket of contexts holds on average.
CHUNK_TOKENS = 2_000_000
#: Tokens of a bucket whose contexts are compared at a time, on average.
MEET_TOKENS = 250_000
#: Bits of a context's hash that one exchange tells apart; finer buckets take a further exchange.
EXCHANGE_BITS = 12
#: Bytes of text per word, on the low side, for the number of buckets.
WORD_BYTES = 6
#: Steps of a log-probability sent in a byte.
LOG_STEP = 0.125


def _ids(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words, their hashes, offsets of the texts)."""
    words = W.Words(*W.text_buffer(column))
    hashes = words.hashes()
    return (hashes >> W.U64(64 - bits)).astype(np.int64), hashes, words.offsets


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in W.slices(batch, "text", W.WIDE):
                counts += np.bincount(_ids(part.column("text"), bits)[0], minlength=1 << bits)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["bucket", "n"])

    return run


def corpus_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of every vocabulary bucket in all texts."""
    rows = docs.mapInArrow(lean(_count(bits)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^MOST_BITS rows
    counts = np.zeros(1 << bits, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def word_groups(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, log-probability within the group) of every bucket, from counts over the corpus.

    Buckets in order of frequency are cut into ``CLASSES`` times ``GROUPS`` groups of about equal mass;
    the most frequent words are groups of their own. A class is ``GROUPS`` neighbouring groups.
    """
    smooth = counts + 0.5
    order = np.argsort(-counts, kind="stable")
    total = CLASSES * GROUPS
    share = np.cumsum(smooth[order]) - smooth[order]
    groups = np.empty(len(counts), np.int64)
    groups[order] = np.minimum(share * total / smooth.sum(), total - 1).astype(np.int64)
    mass = np.bincount(groups, smooth, minlength=total)
    return groups, np.log(smooth / mass[groups])


def _powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of logits, their sums by row); logits of a bounded hidden layer stay far below the bound."""
    e = np.exp(np.minimum(z, 60))
    return e, e @ np.ones(e.shape[1], e.dtype)


@dataclass
class Network:
    """Predicts a word's class, and its group within the class, from the classes of its neighbours.

    Class ``CLASSES`` is a text's edge. The word within its group is left to corpus counts.
    """

    inner: np.ndarray  # (2 SIDE, CLASSES + 1, HIDDEN)
    outer: np.ndarray  # (HIDDEN + 1, CLASSES)
    finer: np.ndarray  # (CLASSES, HIDDEN + 1, GROUPS)

    @classmethod
    def start(cls, shares: np.ndarray) -> Network:
        """``shares``: of all words, by group."""
        rng = np.random.default_rng(7)
        shares = shares.reshape(CLASSES, GROUPS)
        inner = rng.normal(0, 0.3, (2 * SIDE, CLASSES + 1, HIDDEN))
        outer = np.vstack([rng.normal(0, 0.1, (HIDDEN, CLASSES)), np.log(shares.sum(1))[None, :]])
        finer = np.concatenate([rng.normal(0, 0.1, (CLASSES, HIDDEN, GROUPS)), np.log(shares)[:, None, :]], axis=1)
        return cls(*(x.astype(np.float32) for x in (inner, outer, finer)))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.inner, self.outer, self.finer

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.inner[0][context[0]]
        for k in range(1, 2 * SIDE):
            total += self.inner[k][context[k]]
        return np.tanh(total)

    def _by_class(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        classes = target // GROUPS
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(edges)).tolist():
            yield c, order[edges[c] : edges[c + 1]]

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the group of every token, given both sides."""
        h = self.hidden(context)
        e, total = _powers(h @ self.outer[:-1] + self.outer[-1])
        out = np.log(e[np.arange(len(target)), target // GROUPS] / total).astype(np.float64)
        for c, rows in self._by_class(target):
            e, total = _powers(h[rows] @ self.finer[c, :-1] + self.finer[c, -1])
            out[rows] += np.log(e[np.arange(len(rows)), target[rows] % GROUPS] / total)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean gradient of the negative log-likelihood."""
        n = len(target)
        h = self.hidden(context)
        delta, total = _powers(h @ self.outer[:-1] + self.outer[-1])
        delta *= (1 / (total * n))[:, None]
        delta[np.arange(n), target // GROUPS] -= 1 / n
        outer = np.vstack([h.T @ delta, delta.sum(0, keepdims=True)])
        back = delta @ self.outer[:-1].T
        finer = np.zeros_like(self.finer)
        for c, rows in self._by_class(target):
            some = h[rows]
            fine, total = _powers(some @ self.finer[c, :-1] + self.finer[c, -1])
            fine *= (1 / (total * n))[:, None]
            fine[np.arange(len(rows)), target[rows] % GROUPS] -= 1 / n
            finer[c, :-1], finer[c, -1] = some.T @ fine, fine.sum(0)
            back[rows] += fine @ self.finer[c, :-1].T
        back = back * (1 - h * h)
        inner = np.empty_like(self.inner)
        for j, column in enumerate(np.ascontiguousarray(back.T, np.float64)):
            for k in range(2 * SIDE):
                inner[k, :, j] = np.bincount(context[k], column, minlength=CLASSES + 1)
        return inner, outer, finer

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def unpacked(self, data: np.ndarray) -> Network:
        """A network of the same shape with other weights."""
        made, at = [], 0
        for x in self.parts():
            made.append(data[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*made)


def _context(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Classes of the neighbours of every token, (2 SIDE, tokens); the token itself is masked."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(classes)) + SIDE * (row + 1)
    padded = np.full(len(classes) + SIDE * (len(offsets) + 1), CLASSES)
    padded[place] = classes
    return np.stack([padded[place + d] for d in range(-SIDE, SIDE + 1) if d])


TRAINED = "shard int, tokens double, weights binary"


def _train(network: Network, groups: np.ndarray, bits: int):
    """One pass of Adagrad over a shard, from the common start."""

    def train(key, rows):
        made = one_pass(key, rows)
        give_back()
        return made

    def one_pass(key, rows):
        one_thread()
        net, tokens = network.unpacked(network.pack()), 0
        speed = [np.full_like(x, 1e-6) for x in net.parts()]
        rows = rows.sort_by([("order", "ascending"), ("text", "ascending")])
        for batch in rows.select(["text"]).combine_chunks().to_batches():
            for part in W.slices(batch, "text", W.WIDE):
                ids, _, offsets = _ids(part.column("text"), bits)
                target = groups[ids]
                context = _context(target // GROUPS, offsets)
                for i in range(0, len(ids), STEP_TOKENS):
                    grads = net.gradient(context[:, i : i + STEP_TOKENS], target[i : i + STEP_TOKENS])
                    for weights, grad, seen in zip(net.parts(), grads, speed, strict=True):
                        seen += grad * grad
                        weights -= RATE * grad / np.sqrt(seen)
                tokens += len(ids)
        total = net.pack().astype(np.float64) * tokens
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([float(tokens)]), pa.array([total.tobytes()], pa.binary())], names=["shard", "tokens", "weights"])

    return train


def _sum(key, rows):
    rows = rows.sort_by("shard")
    total = sum(np.frombuffer(x, np.float64) for x in rows.column("weights").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(rows.column("tokens").to_pylist())], pa.float64()), pa.array([total.tobytes()], pa.binary())], names=["shard", "tokens", "weights"])


@dataclass
class Model:
    """``parts``: into how many parts the rows are dealt for the contexts of a bucket's words; the last entry is that of edges."""

    network: Network
    groups: np.ndarray
    within: np.ndarray
    parts: np.ndarray
    bits: int


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> Model:
    """Trains on every token of every text.

    Counts of all words give the groups and the probabilities within them; the vocabulary grows with
    the corpus between ``LEAST_BITS`` and ``MOST_BITS`` bits. Rows are dealt into shards by a hash of id
    and text, some ``SHARD_BYTES`` each, and stand there in order of it, so that neither the layout of
    the input nor the cluster changes the result. In each round every shard makes one pass over its
    tokens from the common weights; the results are averaged by tokens in a tree of ``FAN_IN`` at a
    time, in order of shards. Null texts teach nothing. An empty table gives the starting weights.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.xxhash64(F.xxhash64(id_col), text_col).alias("order"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // WORD_BYTES // 64).bit_length()))
    counts = corpus_counts(rows.select("text"), bits)
    groups, within = word_groups(counts)
    shares = np.bincount(groups, counts + 0.5, minlength=CLASSES * GROUPS) + 1e-3
    network = Network.start(shares / shares.sum())
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = rows.select(F.pmod("order", F.lit(shards)).cast("int").alias("shard"), "order", "text")
    for _ in range(rounds):
        trained, n = written(dealt.groupBy("shard").applyInArrow(_train(network, groups, bits), TRAINED), "weights"), shards
        while n > FAN_IN:
            trained, n = trained.withColumn("above", F.floor(F.col("shard") / FAN_IN).cast("int")).groupBy("above").applyInArrow(_sum, TRAINED), -(-n // FAN_IN)
        parts = sorted(trained.collect(), key=lambda r: r.shard)  # FAN_IN rows at most
        tokens = sum(r.tokens for r in parts)
        if tokens:
            network = network.unpacked(sum(np.frombuffer(r.weights, np.float64) for r in parts) / tokens)
    parts = -(-np.append(counts, counts.sum()) // CHUNK_TOKENS)
    return Model(network, groups, within, np.maximum(parts, 1).astype(np.int32), bits)


def token_scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the network's log-probability of every token given both sides, word hashes, offsets of the texts)."""
    ids, hashes, offsets = _ids(column, model.bits)
    target = model.groups[ids]
    context = _context(target // GROUPS, offsets)
    out = np.empty(len(ids))
    for i in range(0, len(ids), STEP_TOKENS):
        out[i : i + STEP_TOKENS] = model.network.log_probability(context[:, i : i + STEP_TOKENS], target[i : i + STEP_TOKENS])
    return out + model.within[ids], hashes, offsets


def _contexts(model: Model, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the two neighbours of every token, whether the context is a frequent one, parts of its tokens of this word); a text's edges are neighbours too.

    A context has no more tokens than its rarer neighbour has occurrences, and no more of a word than the
    word has. It is frequent where its neighbours both have more than ``CHUNK_TOKENS``.
    """
    ids = (hashes >> W.U64(64 - model.bits)).astype(np.int64)
    left, right, near, far = np.roll(hashes, 1), np.roll(hashes, -1), np.roll(ids, 1), np.roll(ids, -1)
    some = offsets[:-1] < offsets[1:]
    starts, ends = offsets[:-1][some], offsets[1:][some] - 1
    left[starts], right[ends] = W.U64(1), W.U64(2)
    near[starts] = far[ends] = len(model.parts) - 1
    parts = np.minimum(model.parts[near], model.parts[far])
    return W.mix(W.mix(left * W.U64(0x9E3779B97F4A7C15) + right)), parts > 1, np.minimum(parts, model.parts[ids])


def _short(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits of hash by which words are told apart between the same neighbours."""
    return (hashes >> W.U64(8)).astype(np.uint32)


def _dealt(contexts: np.ndarray, words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where the tokens of a word in a frequent context meet, by part."""
    return W.mix(W.mix(contexts + words.astype(W.U64) * W.U64(0xC2B2AE3D27D4EB4F)) + part)


def context_hashes(model: Model, hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One hash of the two neighbours of every token, by which tokens meet.

    The tokens of frequent contexts are dealt by word and by ``rows`` (a hash of each row) into as many
    parts as ``_contexts`` says. What such a part does not show, how often the context and the word in
    it occur in all texts, comes from ``_frequent``, so that scores do not depend on the parts.
    """
    contexts, frequent, parts = _contexts(model, hashes, offsets)
    some = np.flatnonzero(frequent)
    contexts[some] = _dealt(contexts[some], _short(hashes[some]), rows[some].view(W.U64) % parts[some].astype(W.U64))
    return contexts


def _tally(model: Model):
    """Occurrences of each word in each frequent context, summed up by some millions of tokens."""

    def close(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, contexts, words, parts, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        columns = [contexts[first].view(np.int64), words[first].astype(np.int64), parts[first].astype(np.int64), np.bincount(at, counts, minlength=len(first)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "word", "parts", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in W.slices(batch, "text", W.WIDE):
                _, hashes, offsets = _ids(part.column("text"), model.bits)
                if not len(hashes):
                    continue
                contexts, frequent, parts = _contexts(model, hashes, offsets)
                contexts, words, parts = contexts[frequent], _short(hashes[frequent]), parts[frequent]
                keys, first, counts = np.unique(_dealt(contexts, words, W.U64(0)), return_index=True, return_counts=True)
                held.append((keys, contexts[first], words[first], parts[first], counts))
                n += len(held[-1][0])
                if n >= CHUNK_TOKENS // 2:
                    yield close(held)
                    held, n = [], 0
        if held:
            yield close(held)

    return run


def _frequent(keyed: DataFrame, model: Model, bits: int) -> DataFrame:
    """Counts of the words in frequent contexts over all texts, packed by bucket like tokens: every part of a word's tokens gets them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, word, parts, same, there = (batch.column(c).to_numpy() for c in ("context", "word", "parts", "same", "there"))
            row = np.repeat(np.arange(len(parts)), parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            meet = _dealt(context.view(W.U64)[row], word[row], part.astype(W.U64))
            order = np.argsort(meet)
            meet, row = meet[order], row[order]
            top = meet >> W.U64(64 - bits) if bits else np.zeros(len(meet), W.U64)
            edges = [*np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])).tolist(), len(top)] if len(top) else []
            out = [(int(top[a]), b"", b"", b"", False, meet[a:b].tobytes(), same[row[a:b]].tobytes(), there[row[a:b]].tobytes(), b"") for a, b in zip(edges, edges[1:], strict=False)]
            yield from _batches(out, TOKENS)

    counts = keyed.select("text").mapInArrow(lean(_tally(model)), "context long, word long, parts long, same long")
    counts = written(counts.groupBy("context", "word").agg(F.max("parts").alias("parts"), F.sum("same").alias("same")), "frequent")
    totals = counts.groupBy("context").agg(F.sum("same").alias("there"))
    return counts.join(totals, "context").mapInArrow(lean(pack), TOKENS)


TOKENS = "bucket long, chunks binary, which binary, places binary, wide boolean, contexts binary, words binary, logs binary, rows binary"
SUMS = "chunk long, places binary, wide boolean, totals binary, counts binary, rows binary"


def _batches(rows: list[tuple], kinds: str) -> Iterator[pa.RecordBatch]:
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in kinds.split(", ")), strict=True)
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows[i : i + 64], strict=True), types, strict=True)], list(names))


def _pack(contexts: np.ndarray, words: np.ndarray, chunks: np.ndarray, places: np.ndarray, logs: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Tokens by bucket of their contexts: context and word (5 and 4 bytes of hash), the chunk (one of all, or each token's) and the place of their text in it, log-probability."""
    top = (contexts >> W.U64(64 - bits) if bits else np.zeros(len(contexts), W.U64)).astype(np.uint16 if bits <= 16 else W.U64)
    order = np.argsort(top, kind="stable")
    top = top[order]
    edges = [*np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])).tolist(), len(top)]
    wide = bool(places.max() > 0xFFFF)
    places = places.astype(np.uint32 if wide else np.uint16)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        at = order[a:b]
        some, which = np.unique(chunks[at], return_inverse=True) if chunks.ndim else (chunks, None)
        rest = (contexts[at] << W.U64(bits)).view(np.uint8).reshape(-1, 8)[:, 3:]
        out.append((int(top[a]), some.tobytes(), which.astype(np.uint16).tobytes() if some.size > 1 else b"", places[at].tobytes(), wide, rest.tobytes(), words[at].tobytes(), logs[at].tobytes(), b""))
        if len(out) == 64:
            yield from _batches(out, TOKENS)
            out = []
    yield from _batches(out, TOKENS)


def _emit(model: Model, bits: int):
    """Chunks of tokens, packed by bucket, and one row per chunk that names its rows.

    A chunk is named by its rows, so that it is the same one where a lost task runs again on the same rows.
    """

    def close(chunk: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        contexts, words, logs = (np.concatenate([c[i] for c in chunk]) for i in range(3))
        rows, counts = np.concatenate([c[3] for c in chunk]), np.concatenate([c[4] for c in chunk])
        chunk.clear()
        give_back()
        name = W.mix(W.mix(rows.view(W.U64)).sum(keepdims=True) + W.U64(len(rows)))
        places = np.repeat(np.arange(len(rows), dtype=np.uint32), counts)
        yield from _pack(contexts, words, name.view(np.int64).reshape(()), places, logs, bits)
        top = int(name[0] >> W.U64(64 - bits)) if bits else 0
        yield from _batches([(top, name.tobytes(), b"", b"", False, b"", b"", b"", rows.tobytes())], TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        chunk, held = [], 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                logs, hashes, offsets = token_scores(model, part.column("text"))
                if not len(logs):
                    continue
                rows, counts = part.column("row").to_numpy(), np.diff(offsets)
                contexts = context_hashes(model, hashes, offsets, np.repeat(rows, counts))
                chunk.append((contexts, _short(hashes), np.clip(-logs / LOG_STEP, 0, 255).round().astype(np.uint8), rows, counts))
                held += len(logs)
                if held >= CHUNK_TOKENS:
                    yield from close(chunk)
                    chunk, held = [], 0
        if chunk:
            yield from close(chunk)

    return run


def mixed_logs(contexts: np.ndarray, words: np.ndarray, logs: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Log-probability of every token from the other tokens between the same neighbours, and from the network.

    (times the word stands there besides + PRIOR p) / (tokens there besides + PRIOR), with p of the network.
    ``known``: (contexts in order, times the word stands there, tokens there) of those whose tokens are not all here.
    """
    pair = np.lexsort((words, contexts))
    c, w = contexts[pair], words[pair]
    new = np.concatenate([[True], c[1:] != c[:-1]])
    there, same = np.empty(len(pair), np.int64), np.empty(len(pair), np.int64)
    for counts, first in ((there, new), (same, new | np.concatenate([[True], w[1:] != w[:-1]]))):
        sizes = np.diff(np.append(np.flatnonzero(first), len(pair)))
        counts[pair] = np.repeat(sizes, sizes)
    if known is not None:
        place = np.minimum(np.searchsorted(known[0], contexts), len(known[0]) - 1)
        found = np.flatnonzero(known[0][place] == contexts)
        same[found], there[found] = known[1][place[found]], known[2][place[found]]
    return np.log((same - 1 + PRIOR * np.exp(logs)) / (there - 1 + PRIOR))


def _tokens(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, logs) of a packed row."""
    words = np.frombuffer(row["words"], np.uint32)
    full = np.zeros((len(words), 8), np.uint8)
    full[:, 3:] = np.frombuffer(row["contexts"], np.uint8).reshape(-1, 5)
    contexts = full.view(W.U64).ravel()
    if bits:
        contexts = contexts >> W.U64(bits) | W.U64(row["bucket"]) << W.U64(64 - bits)
    return contexts, words, np.frombuffer(row["logs"], np.uint8)


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, which of them each token of a packed row is of, places)."""
    places = np.frombuffer(row["places"], np.uint32 if row["wide"] else np.uint16)
    return np.frombuffer(row["chunks"], np.int64), np.frombuffer(row["which"], np.uint16) if len(row["which"]) else np.zeros(len(places), np.uint16), places


def _unpacked(row: dict, bits: int) -> tuple[np.ndarray, ...]:
    """(contexts, words, chunks, places, logs) of a packed row."""
    contexts, words, logs = _tokens(row, bits)
    some, which, places = _texts(row)
    return contexts, words, some[which], places, logs


def _finer(bits: int, more: int):
    """Tokens in order of their buckets, packed anew into finer ones, some at a time."""

    def close(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        yield from _pack(*(np.concatenate(x) for x in zip(*held, strict=True)), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, names = [], 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["rows"]:
                    yield from _batches([(row["bucket"] << (more - bits), *[row[c.split()[0]] for c in TOKENS.split(", ")[1:]])], TOKENS)
                    continue
                held.append(_unpacked(row, bits))
                n += len(held[-1][0])
                names.update(np.unique(held[-1][2]).tolist())
                if n >= CHUNK_TOKENS or len(names) > 50_000:
                    yield from close(held)
                    held, n, names = [], 0, set()
        if held:
            yield from close(held)

    return run


def _sorted(known: list[list[np.ndarray]], kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Counts of frequent contexts in order, by the bits of hash that tokens have kept."""
    if not known[0]:
        return None
    meet, same, there = map(np.concatenate, known)
    meet = meet >> W.U64(64 - kept) << W.U64(64 - kept)
    order = np.argsort(meet)
    return meet[order], same[order], there[order]


def _in_place(table: pa.Table) -> list[dict]:
    """Rows of a table, their binary values not copied."""
    return [
        {c: v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py() for c, v in zip(table.column_names, row, strict=True)}
        for batch in table.to_batches()
        for row in zip(*batch.columns, strict=True)
    ]


def _millionths(packed: list[dict], bits: int, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Log-probabilities of the tokens of all rows, some contexts at a time, so that memory follows ``MEET_TOKENS``."""
    sizes = [len(r["words"]) // 4 for r in packed]
    ends = np.cumsum(sizes).tolist()
    contexts, words, logs = (np.empty(ends[-1], kind) for kind in (W.U64, np.uint32, np.uint8))
    for r, n, z in zip(packed, sizes, ends, strict=True):
        contexts[z - n : z], words[z - n : z], logs[z - n : z] = _tokens(r, bits)
    more = min(8, (ends[-1] // MEET_TOKENS).bit_length())
    part = (contexts >> W.U64(64 - bits - more)).astype(np.uint8) & np.uint8((1 << more) - 1) if more else np.zeros(ends[-1], np.uint8)
    out = np.empty(ends[-1], np.int32)  # a log-probability is some -60 at least
    for k in range(1 << more):
        at = np.flatnonzero(part == k)
        if len(at):
            out[at] = np.round(1e6 * mixed_logs(contexts[at], words[at], -LOG_STEP * logs[at].astype(np.float64), known))
    return out


def _summed(rows: list[dict], bits: int, kept: int) -> pa.Table:
    out = [(int(np.frombuffer(r["chunks"], np.int64)[0]), b"", False, b"", b"", r["rows"].to_pybytes()) for r in rows if len(r["rows"])]
    packed = [r for r in rows if len(r["chunks"]) and not len(r["rows"])]
    frequent = [r for r in rows if not len(r["chunks"])]
    if packed:
        known = [[np.frombuffer(r[c], kind) for r in frequent] for c, kind in (("contexts", W.U64), ("words", np.int64), ("logs", np.int64))]
        values, z = _millionths(packed, bits, _sorted(known, kept)), 0
        for r in packed:
            names, which, places = _texts(r)
            order = np.lexsort((places, which))
            which, places, some = which[order], places[order], values[z : z + len(order)][order]
            z += len(order)
            first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (places[1:] != places[:-1])]))
            totals = np.add.reduceat(some, first, dtype=np.int64)
            counts = np.diff(np.append(first, len(some))).astype(np.uint32)
            which, places = which[first], places[first]
            edges = np.searchsorted(which, np.arange(len(names) + 1)).tolist()
            totals = totals.astype(np.int32 if np.abs(totals).max() < 2**31 else np.int64)
            counts = counts.astype(np.uint8) if counts.max() < 256 else counts
            out += [(int(c), places[a:b].tobytes(), r["wide"], totals[a:b].tobytes(), counts[a:b].tobytes(), b"") for c, a, b in zip(names, edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_batches(_batches(out, SUMS)) if out else pa.table([pa.array([], k) for k in (pa.int64(), pa.binary(), pa.bool_(), *[pa.binary()] * 3)], names=[c.split()[0] for c in SUMS.split(", ")])


def _meet(bits: int, kept: int):
    """Of the tokens of a bucket of contexts, the summed log-probabilities by chunk and place, in millionths (whole numbers add up the same in any order)."""

    def meet(rows):
        out = _summed(_in_place(rows), bits, kept)
        give_back()
        return out

    return meet


ROWS = "row long, millionths long, tokens long"


def _by_row(parts):
    """The rows of a chunk with their sums, and how many tokens these are of."""
    parts = parts.to_pylist()
    named = [np.frombuffer(r["rows"], np.int64) for r in parts if r["rows"]]
    rows = named[0]
    totals, tokens = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for r in parts:
        if not r["rows"]:
            places = np.frombuffer(r["places"], np.uint32 if r["wide"] else np.uint16)
            n = len(places)
            np.add.at(totals, places, np.frombuffer(r["totals"], np.int32 if len(r["totals"]) == 4 * n else np.int64).astype(np.int64))
            np.add.at(tokens, places, np.frombuffer(r["counts"], np.uint8 if len(r["counts"]) == n else np.uint32).astype(np.int64))
    some, at = np.unique(rows, return_inverse=True)
    add = lambda x: np.bincount(at, x, minlength=len(some)).astype(np.int64)
    return pa.table([pa.array(some, pa.int64()), pa.array(add(totals)), pa.array(add(tokens))], names=["row", "millionths", "tokens"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, log_likelihood (summed over the tokens), mean.

    Each token is predicted, itself masked, from both sides: by the network from ``SIDE`` words on
    either side, and by all other tokens of all texts that stand between the same two words, the
    network counting as ``PRIOR`` of them. These occurrences are gathered from the whole corpus in one
    exchange by hash of the two neighbours, packed; very frequent contexts are dealt into parts, which
    get the counts over all texts (see ``context_hashes``). Log-probabilities of the network travel in steps of ``LOG_STEP``, contexts and
    words by 40 (and the bucket's) and 32 bits of hash.

    Null and empty texts have no tokens, 0 as sum and a null mean. Rows with equal id and text have
    equal scores. Whole texts are scored; other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.select(F.xxhash64(F.xxhash64("id"), "text").alias("row"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // WORD_BYTES // CHUNK_TOKENS).bit_length())
    at = min(bits, EXCHANGE_BITS)
    kept = 40 + at
    tokens = keyed.mapInArrow(lean(_emit(model, at)), TOKENS)
    while at < bits:
        more = min(bits, at + EXCHANGE_BITS)
        tokens = tokens.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_finer(at, more)), TOKENS)
        at = more
    if (model.parts > 1).any():
        tokens = tokens.unionByName(_frequent(keyed, model, bits))
    sums = tokens.groupBy("bucket").applyInArrow(_meet(bits, kept), SUMS).groupBy("chunk").applyInArrow(_by_row, ROWS)
    sums = sums.groupBy("row").agg(F.sum("millionths").alias("millionths"), F.sum("tokens").alias("tokens"))
    counted = rows.select("id", F.xxhash64(F.xxhash64("id"), "text").alias("row"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))
    out = counted.join(sums, "row", "left")
    # equal rows have equal sums; each row's part is by tokens
    total = F.coalesce(F.try_divide(F.col("millionths"), F.col("tokens")) * F.col("n_tokens") / 1e6, F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean"))
