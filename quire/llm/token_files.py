"""Token-ID output: texts encoded, one wavelet matrix per shard, read back."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import words as W
from quire.llm.memory import lean
from quire.llm.store import cut, new_path, prepare
from quire.llm.wavelet import WaveletMatrix, build

#: Tokens after which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 4_000_000
#: Bytes of text per partition that is encoded by one task.
PART_BYTES = 16 << 20
#: Parts that are summed together before the groups of them are.
GROUP = 1000
#: Shards whose starts are broadcast to them; more are joined.
FEW_SHARDS = 100_000
#: Bytes of text whose pieces are looked up together.
LOOKUP_BYTES = 24 << 20
#: Pieces a worker remembers with their ids; beyond it the half that most lookups met stays.
MEMORY = 800_000
#: Characters of the pieces that the library encodes in one text.
JOINED = 1 << 14
#: Bytes of the longest piece that is remembered.
LONG = 64

SHARDS = "part int, shard int, n_docs long, n_tokens long, payload binary"
# RE2: empty texts, edges and runs of white space, white space but spaces and line breaks, the marks for stops and heads, stops not after a letter or digit
_OTHER = (
    r"^(?:[ \n.,]|\z)|[ \n]\z|  |\n\n| \n|\n |[\t\r\x02-\x04\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[^\p{L}\p{N}][.,](?:[ \n]|\z)"
)
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _simple(texts: pa.Array, added: list[str]) -> pa.BooleanArray:
    """Whether single spaces and line breaks between words, and stops after words, are all there is to cut at, and no added token is there."""
    return pc.invert(pc.match_substring_regex(texts, "|".join([_OTHER, *map(re.escape, added)])))


def _marked(texts: pa.Array) -> pa.Array:
    """Simple texts as lists of pieces: stops are followed by x02, the head of a line preceded by x03, that of the text by x04; a last x03 is none of the text."""
    head, line, none = (pa.scalar(s, pa.large_string()) for s in ("\x04", "\n", ""))
    out = pc.binary_join_element_wise(head, texts, line, none)
    for mark, spaced in ((". ", " .\x02 "), (", ", " ,\x02 "), (".\n", " .\x02\n"), (",\n", " ,\x02\n"), ("\n", " \x03")):
        out = pc.replace_substring(out, mark, spaced)
    return pc.split_pattern(out, " ")


def _within(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of spans, one span after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


class Encoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library.

    Its pre-tokenizer starts a new piece at every space between two non-space characters, takes a line
    break between two such characters as a piece, and a full stop or comma between a letter or digit
    and white space. Texts are cut there and each distinct piece encoded by the library once, as long
    as it is remembered. A text that holds the string of an added token goes whole through the library,
    which takes it for that token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.levels = max(1, (max(vocab.values())).bit_length())
        self.kind = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self.spaced = np.zeros(1 << self.levels, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.line = self._plain("\n")
        self.breaks = np.zeros(1 << self.levels, bool)
        self.breaks[self.line] = len(self.line) == 1
        # remembered pieces, where the ids of each begin in ``flat`` and how many they are, lookups that met it, the last of them
        stops = [self._plain(mark) for mark in ".,"]
        self.pieces = pa.array([".\x02", ",\x02"], pa.large_string())
        self.sizes = np.array(list(map(len, stops)), np.int64)
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.concatenate(stops)
        self.met, self.last, self.lookups = np.zeros(2, np.int64), np.zeros(2, np.int64), 0

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _joined(self, pieces: list[str], lead: str, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each with ``lead`` before it, and their numbers; many are encoded in one text and told apart by the ids in ``leads``."""
        flat, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        ends, j = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), 0
        while j < len(pieces):
            before = int(ends[j - 1]) if j else 0
            i, j = j, max(j + 1, min(j + 500, int(np.searchsorted(ends, before + JOINED, "right"))))
            some = pieces[i:j]
            ids = self._plain(lead + lead.join(some))
            starts = np.flatnonzero(leads[ids])
            if len(starts) == len(some) and starts[0] == 0:
                flat.append(ids)
                sizes.append(np.diff(starts, append=len(ids)))
            else:
                each = [self._plain(lead + p) for p in some]
                flat += each
                sizes.append(np.array(list(map(len, each)), np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        return self.encode_columns([pa.array(texts, pa.large_string())])

    def encode_columns(self, columns: list[pa.Array]) -> list[bytes]:
        """Little-endian ids of each text of all columns (large strings without nulls), whose pieces are looked up together."""
        out: list[bytes] = []
        values: list[pa.Array] = []
        spans: list[tuple[int, int, int]] = []
        at = 0
        for column in columns:
            simple = _simple(column, self.added)
            flags = simple.to_numpy(zero_copy_only=False)
            cut = _marked(column.filter(simple))
            ends = (at + cut.offsets.to_numpy()).tolist()
            spans += zip((len(out) + np.flatnonzero(flags)).tolist(), ends[:-1], [e - 1 for e in ends[1:]], strict=True)
            values.append(cut.values)
            at += len(cut.values)
            first = len(out)
            out += [b""] * len(column)
            rest: list[str] = []
            for i in np.flatnonzero(~flags).tolist():
                head, others = self._by_piece(column[i].as_py())
                out[first + i] = self._plain(head).tobytes() if head else b""
                spans.append((first + i, at + len(rest), at + len(rest) + len(others)))
                rest += others
            values.append(pa.array(rest, pa.large_string()))
            at += len(rest)
        index = self._know(values)
        for i, a, b in spans:
            here = index[a:b]
            out[i] += self.flat[_within(self.begins[here], self.sizes[here])].tobytes()
        return out

    def _by_piece(self, text: str) -> tuple[str, list[str]]:
        """Any other text cut at single spaces alone, if at all: its head and the pieces that follow a space."""
        if any(mark in text for mark in "\x02\x03\x04") or any(token in text for token in self.added):
            return text, []
        head, *rest = _CUT.split(text)
        return head, [p[1:] for p in rest]

    def _know(self, values: list[pa.Array]) -> np.ndarray:
        """The place of each value among the remembered pieces, which the new ones are added to."""
        self._forget()
        known = len(self.pieces)
        found = pa.chunked_array([self.pieces, *values]).dictionary_encode()
        index = np.concatenate([c.indices.to_numpy() for c in found.chunks])[known:]
        self.pieces = found.chunk(found.num_chunks - 1).dictionary
        new = self.pieces.slice(known).to_pylist()
        begins, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        heads = {"\x03": [], "\x04": [], "": []}
        for i, piece in enumerate(new):
            heads[piece[0] if piece[:1] in "\x03\x04" and piece else ""].append(i)
        for mark, places in heads.items():
            pieces = [new[i] for i in places]
            ids, n = self._joined([p[1:] for p in pieces], "\n", self.breaks) if mark else self._joined(pieces, " ", self.spaced)
            skip = len(self.line) if mark == "\x04" else 0
            begins[places], sizes[places] = len(self.flat) + np.cumsum(n) - n + skip, n - skip
            self.flat = np.concatenate([self.flat, ids])
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])
        self.lookups += 1
        now = np.zeros(len(self.pieces), bool)
        now[index] = True
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)]) + now
        self.last = np.where(now, self.lookups, np.concatenate([self.last, np.zeros(len(new), np.int64)]))
        return index

    def _forget(self) -> None:
        """Drops long pieces and, where too many are left, the half met by fewest lookups, of these the longest ago; the two stops stay."""
        keep = pc.binary_length(self.pieces).to_numpy() <= LONG
        if keep.sum() > MEMORY:
            score = np.where(keep, (self.met << 32) + self.last, -1)
            keep = np.zeros(len(keep), bool)
            keep[np.argpartition(score, len(score) - MEMORY // 2)[len(score) - MEMORY // 2 :]] = True
        keep[:2] = True
        if keep.all():
            return
        self.pieces = self.pieces.filter(pa.array(keep))
        begins, self.sizes, self.met, self.last = self.begins[keep], self.sizes[keep], self.met[keep], self.last[keep]
        self.flat = self.flat[_within(begins, self.sizes)]
        self.begins = np.cumsum(self.sizes) - self.sizes


def _payload(levels: int, docs: list, blobs: list[bytes], kind: np.dtype) -> tuple[bytes, int]:
    """A shard's file: number of documents, their ids and lengths, then the wavelet matrix."""
    counts = np.array([len(b) // kind.itemsize for b in blobs], "<u8")
    ids = np.array([-1 if d is None else d for d in docs], "<i8")
    null = np.array([d is None for d in docs], np.uint8)
    ids_all = np.frombuffer(b"".join(blobs), kind)
    return struct.pack("<Q", len(docs)) + ids.tobytes() + null.tobytes() + counts.tobytes() + build(ids_all, levels), len(ids_all)


class Shard:
    """A shard read back: ``docs``, ``counts`` (with end ids) and ``tokens`` (a ``WaveletMatrix``)."""

    def __init__(self, data: bytes) -> None:
        (n,) = struct.unpack_from("<Q", data)
        ids = np.frombuffer(data, "<i8", n, 8)
        null = np.frombuffer(data, np.uint8, n, 8 + 8 * n)
        self.docs = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.tokens = WaveletMatrix(data[8 + 17 * n :])


def _together(batches: Iterator[Iterator[pa.RecordBatch]]) -> Iterator[list[pa.RecordBatch]]:
    """Slices in order, as many at a time as hold ``LOOKUP_BYTES`` of text, one at least."""
    some, held = [], 0
    for piece in chain.from_iterable(batches):
        size = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if some and held + size > LOOKUP_BYTES:
            yield some
            some, held = [], 0
        some.append(piece)
        held += size
    if some:
        yield some


def _encode_parts(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part, shard, docs, blobs, held = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], encoder.kind).tobytes()

        def close() -> pa.RecordBatch:
            payload, n = _payload(encoder.levels, docs, blobs, encoder.kind)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            row = [part, shard, len(docs), n, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        for some in _together(W.slices(b, "text") for b in batches):
            columns = [s.column("text").cast(pa.large_string()).fill_null("") for s in some]
            for doc, ids in zip([i for s in some for i in s.column("id").to_pylist()], encoder.encode_columns(columns), strict=True):
                size = len(ids) // encoder.kind.itemsize + 1
                if docs and held + size > SHARD_TOKENS:
                    yield close()
                    shard, docs, blobs, held = shard + 1, [], [], 0
                docs.append(doc)
                blobs.append(ids + end)
                held += size
        if docs:
            yield close()

    return run


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder, kept over tasks with what it has learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encodes whole texts and writes them to ``folder`` as shards in ascending order of id.

    Each text is followed by ``end_id``; a null text is empty. Rows are dealt by ranges of id and of a
    hash of the text, so that not even one id of all rows makes a single part, and sorted; null ids come
    first, rows that share an id stand in order of that hash, then of text. A shard is one row (part, shard,
    n_docs, n_tokens, payload) of a Parquet table, so that any store Spark writes to will do and a lost
    task leaves nothing behind; shards in order of (part, shard) hold the documents in order.
    ``tokenizer``: path of a tokenizer file on every executor. Other columns are ignored; an empty
    table writes no shard.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("key", F.xxhash64("text"))
    dealt = rows.repartitionByRange(max(1, -(-size // PART_BYTES)), "id", "key").sortWithinPartitions("id", "key", "text").select("id", "text")
    dealt.mapInArrow(lean(_encode_parts(tokenizer, end_id)), SHARDS).write.parquet(folder)


TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(docs_folder: DataFrame) -> DataFrame:
    """Every document of written shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    The crc is over the decoded ids as little-endian unsigned 32-bit integers.
    """
    sums = cut(docs_folder.select("part", "shard", "n_tokens"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # parts in order are summed in two levels: within groups of GROUP parts, then over the groups, one row for 1000 parts
    group = F.floor(F.col("part") / GROUP).alias("group")
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", group, "n")
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("group_start"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")).join(groups, "group")
    shards = sums.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    starts = shards.select("part", "shard", (F.col("group_start") + F.col("part_start") + F.col("shard_start")).alias("start"))
    if sums.limit(FEW_SHARDS + 1).count() <= FEW_SHARDS:  # some 30 bytes each
        starts = F.broadcast(starts)
    return docs_folder.join(starts, ["part", "shard"]).select("start", "payload").mapInArrow(lean(_decode), TOKENS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            shard = Shard(payload.as_py())
            ids = shard.tokens.decode()
            ends = np.cumsum(shard.counts)
            begins = ends - shard.counts
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(shard.docs, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TOKENS.split(", ")])


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes shards (see ``write_shards``) to ``folder``, by default a new one in the shared folder, and reads them back."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    write_shards(docs, tokenizer, folder, **options)
    return read_shards(spark.read.schema(SHARDS).parquet(folder))
