"""Substring dedup: repeated word windows, found by Rabin-Karp hashes, merge into removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.store import prepare, written

#: Windows that a map task sorts and packs at a time, and that a bucket holds on average.
CHUNK_WINDOWS = 2_000_000
#: Bits of the hash that one exchange tells apart; finer buckets take a further exchange.
EXCHANGE_BITS = 14
#: Parts of the documents that a bucket deals its repeats to, at most.
PARTS_PER_BUCKET = 64
#: Bytes of text per word, on the low side, for the number of buckets.
WORD_BYTES = 6

RUNS = "bucket long, done boolean, base long, docs binary, doc_bytes int, index binary, index_bytes int, hashes binary, hash_bytes int, checks binary"
PARTS = "part int, salt int, docs binary, counts binary, hashes binary"
REPEATS = "doc long, hashes binary"
#: Bytes of the second hash of a window, which tells windows with equal first hashes apart.
CHECK_BYTES = 3
_CHECK_STEP = 0xA24BAED4963EE407


def _gaps(low: np.ndarray) -> tuple[bytes, int]:
    """Sorted values as gaps, in as few whole bytes each as the largest needs."""
    gaps = np.diff(low, prepend=W.U64(0))
    size = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return gaps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes(), size


def _widened(blob: bytes, size: int) -> np.ndarray:
    """Values of ``size`` bytes each as 64-bit ones."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, size)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :size] = raw
    return full.view(W.U64).ravel()


def _ungap(blob: bytes, size: int) -> np.ndarray:
    return np.cumsum(_widened(blob, size), dtype=W.U64)


class Entries:
    """Windows as (hash, check, document), sorted by hash; ``first`` marks the windows of one text apart."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        if (same & (checks[order][1:] != checks[order][:-1])).any():  # one hash for different windows
            order = np.lexsort((checks, hashes))
        self.hashes, self.checks, self.docs = hashes[order], checks[order], docs[order]
        new = (self.hashes[1:] != self.hashes[:-1]) | (self.checks[1:] != self.checks[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], new]))
        self.least = np.minimum.reduceat(self.docs, self.first)
        self.again = self.docs > np.repeat(self.least, np.diff(np.append(self.first, len(hashes))))


def _run_batches(chunk: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Packs (hash, check, document) of a chunk: one sorted run per bucket, each window with its smallest document.

    A run names only the documents that its own windows start in, as gaps, so that a chunk's bytes do
    not grow with the number of buckets. Larger documents of a window within the chunk are known to
    repeat it; they leave as rows marked done, which any bucket passes on.
    """
    e = Entries(*(np.concatenate(x) for x in zip(*chunk, strict=True)))
    if e.again.any():
        yield from _doc_lists(e.docs[e.again], e.hashes[e.again], bits)
    unique, least = e.hashes[e.first], e.least
    checks = e.checks[e.first].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :CHECK_BYTES]
    tops = unique >> W.U64(64 - bits) if bits else np.zeros(len(unique), W.U64)
    at = np.append(np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1]])), len(unique))
    mask = W.U64((1 << (64 - bits)) - 1)
    rows = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        docs, index = np.unique(least[lo:hi], return_inverse=True)
        names, doc_bytes = _gaps((docs - docs[0]).astype(W.U64))
        index_bytes = max(1, (int(len(docs) - 1).bit_length() + 7) // 8)
        places = index.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :index_bytes].tobytes()
        blob, size = _gaps(unique[lo:hi] & mask)
        rows.append((int(tops[lo]), False, int(docs[0]), names, doc_bytes, places, index_bytes, blob, size, checks[lo:hi].tobytes()))
        if len(rows) == 64:
            yield _runs(rows)
            rows = []
    if rows:
        yield _runs(rows)


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _unpacked(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, documents) of a run."""
    hashes = _ungap(row["hashes"], row["hash_bytes"])
    if bits:
        hashes |= W.U64(row["bucket"]) << W.U64(64 - bits)
    docs = _ungap(row["docs"], row["doc_bytes"]).astype(np.int64) + row["base"]
    return hashes, _widened(row["checks"], CHECK_BYTES).astype(np.uint32), docs[_widened(row["index"], row["index_bytes"]).astype(np.int64)]


def _doc_lists(docs: np.ndarray, hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows marked done: for each document its repeated hashes, in a bucket by document."""
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    ends = np.append(first[1:], len(docs))
    place = W.mix(docs[first].astype(W.U64)) >> W.U64(64 - bits) if bits else np.zeros(len(first), W.U64)
    rows = [(int(p), True, int(docs[a]), b"", 0, b"", 0, np.unique(hashes[a:b]).tobytes(), 8, b"") for p, a, b in zip(place, first, ends, strict=True)]
    for i in range(0, len(rows), 5000):
        yield _runs(rows[i : i + 5000])


def _map_runs(bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for part in W.slices(batch, "text", W.WIDE):
                words = W.Words(*W.text_buffer(part.column("text")))
                starts = W.window_starts(words.offsets, width)
                if not len(starts):
                    continue
                each = words.hashes()
                hashes = W.window_hashes(each, width)[starts]
                checks = (W.window_hashes(each, width, _CHECK_STEP)[starts] >> W.U64(64 - 8 * CHECK_BYTES)).astype(np.uint32)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                chunk.append((hashes, checks, np.repeat(ids, np.maximum(words.counts - width + 1, 0))))
                held += len(starts)
                if held >= CHUNK_WINDOWS:
                    yield from _run_batches(chunk, bits)
                    chunk, held = [], 0
        if chunk:
            yield from _run_batches(chunk, bits)

    return run


def _finer(bits: int, more: int):
    """Runs in order of their buckets, packed anew into finer buckets, a chunk of windows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["done"]:
                    yield _runs([(row["bucket"] << (more - bits), *[row[c.split()[0]] for c in RUNS.split(", ")[1:]])])
                    continue
                chunk.append(_unpacked(row, bits))
                held += len(chunk[-1][0])
                if held >= CHUNK_WINDOWS:
                    yield from _run_batches(chunk, more)
                    chunk, held = [], 0
        if chunk:
            yield from _run_batches(chunk, more)

    return run


def _merge_bucket(bits: int):
    """Of the runs of a bucket, the repeats, dealt into parts by document and packed to a row per part."""
    parts = min(1 << bits, PARTS_PER_BUCKET)

    def merge(key, rows):
        runs, docs, hashes = [], [], []
        for r in rows.to_pylist():
            if r["done"]:
                hashes.append(np.frombuffer(r["hashes"], W.U64))
                docs.append(np.full(len(hashes[-1]), r["base"]))
            else:
                runs.append(_unpacked(r, bits))
        if runs:
            e = Entries(*(np.concatenate(x) for x in zip(*runs, strict=True)))
            docs.append(e.docs[e.again])
            hashes.append(e.hashes[e.again])
        docs, hashes = np.concatenate(docs), np.concatenate(hashes)
        part = (W.mix(docs.astype(W.U64)) % W.U64(parts)).astype(np.int64)
        order = np.lexsort((docs, part))
        docs, hashes, part = docs[order], hashes[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)):
            some, counts = np.unique(docs[edges[p] : edges[p + 1]], return_counts=True)
            out.append((int(p), int(key[0].as_py()) // parts, some.tobytes(), counts.astype(np.uint32).tobytes(), hashes[edges[p] : edges[p + 1]].tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])

    return merge


def _by_document(rows):
    """One row per document of a part: its repeated hashes."""
    rows = rows.to_pylist()
    docs = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows])
    hashes = np.concatenate([np.frombuffer(r["hashes"], W.U64) for r in rows])
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    lists = [hashes[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(docs)), strict=True)]
    return pa.table([pa.array(docs[first], pa.int64()), pa.array(lists, pa.binary())], names=["doc", "hashes"])


def repeated_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc, hashes), a row per document with lists of windows that also start in a document with a smaller id.

    ``docs`` has (id, text). Map tasks hash every window of every text and reduce chunks of them to
    sorted runs with the smallest document per window, so that a passage of many documents sends one
    entry per chunk; runs meet by hash range. Buckets hold some ``CHUNK_WINDOWS`` windows whatever the
    input; where they are more than an exchange tells apart, the runs of coarse buckets are packed into
    finer ones and exchanged again, so that rows stay few and long. Every bucket deals its repeats to a
    fixed number of parts by document; neighbouring buckets meet there, and the lists of a document
    are joined last. Rows without an id take no part.

    A window is told by 64 bits of a polynomial hash over word hashes and ``CHECK_BYTES`` bytes of a
    second one over another base: 88 bits, some 0.2 pairs expected by chance among 10^13 windows.
    """
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // WORD_BYTES // CHUNK_WINDOWS).bit_length())
    known = docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "text")
    at = min(bits, EXCHANGE_BITS)
    runs = known.mapInArrow(_map_runs(at, width), RUNS)
    while at < bits:
        more = min(bits, at + EXCHANGE_BITS)
        runs = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_finer(at, more), RUNS)
        at = more
    parts = runs.groupBy("bucket").applyInArrow(_merge_bucket(bits), PARTS)
    lists = parts.groupBy("part", "salt").applyInArrow(_by_document, REPEATS)
    if bits > PARTS_PER_BUCKET.bit_length() - 1:  # a document has a list per salt
        return written(lists.groupBy("doc").agg(F.collect_list("hashes").alias("hashes")), "repeats")
    return written(lists.select("doc", F.array("hashes").alias("hashes")), "repeats")


def _intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values as [start, end)."""
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


OUT = "n_words long, n_removed long, starts array<int>, ends array<int>, kept string, kept_sha256 string"


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.WIDE):
                yield _cut_part(part, width, with_text)

    return run


def _cut_part(part: pa.RecordBatch, width: int, with_text: bool) -> pa.RecordBatch:
    texts = part.column("text").fill_null("").to_pylist()
    lists = part.column("hashes").to_pylist()
    rows = []
    for text, blobs in zip(texts, lists, strict=True):
        kept = text.encode().split()  # bytes.split() splits at ASCII white space
        n, starts, ends = len(kept), [], []
        if blobs:
            data = np.frombuffer(text.encode(), np.uint8)
            found = W.window_hashes(W.Words(data, np.array([0, len(data)])).hashes(), width)
            hit = np.flatnonzero(np.isin(found, np.frombuffer(b"".join(blobs), W.U64)))
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + width, -1)
            covered = np.cumsum(edge[:-1]) > 0
            a, b = _intervals(covered)
            starts, ends = a.tolist(), b.tolist()
            kept = [kept[i] for i in np.flatnonzero(~covered)]
        joined = b" ".join(kept)
        rows.append((n, n - len(kept), starts, ends, joined.decode() if with_text else None, hashlib.sha256(joined).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
    names = [c.split()[0] for c in OUT.split(", ")]
    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", *names])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, with_text: bool = True) -> DataFrame:
    """One row per input row: what stays once repeated passages are cut.

    A window is ``width`` consecutive words (maximal runs of non-white-space in the ASCII sense) of
    one row's text. Every word covered by a window whose words also start in a row with a smaller id
    goes; windows are judged on the input. Columns: id, n_words, n_removed, starts and ends (maximal
    removed intervals of word indices, end exclusive), kept (the words left, joined by one space;
    null without ``with_text``), kept_sha256. Null and empty texts have no words; texts shorter than
    a window stay whole; rows with a null id stay whole and remove nothing elsewhere; rows that share
    an id do not remove from each other. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = repeated_windows(rows, width)
    joined = rows.join(lists, F.col("id") == F.col("doc"), "left").select("id", "text", "hashes")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(width, with_text), f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
