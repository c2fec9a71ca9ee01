"""Benchmark decontamination by template windows with typed placeholders and a slot check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.memory import lean
from quire.llm.store import prepare

#: Unit words, in lower case.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles g kg mg lb lbs oz ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp kb mb gb tb hz khz mhz ghz w kw mw v kv kwh mph kph degrees"
).split()

#: Words put in or left out between two parts of a passage that still count together.
SHIFT = 8

NUMBER, NAME, UNIT = 1, 2, 3
# classes of a word's bytes: digits, punctuation of numbers, letters and all else
_DIGIT, _POINT, _LETTER, _JUNK = 1, 2, 4, 0
_CLASS = np.full(256, _LETTER, np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _CLASS[_c] = _JUNK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\"'()[]{}|*#-\n"]] = True
_TOKENS = W.mix(np.array([0, 11, 12, 13], W.U64) * W.U64(0xD6E8FEB86659FD93))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(W.Words(data, np.array([0, len(data)])).hashes())


_UNIT_HASHES = _unit_hashes()


class Templates:
    """Words of a batch of texts as template tokens.

    Words lose their punctuation and case; words without letters or digits disappear. ``slot`` is 0
    for ordinary words, else the type of the placeholder: a number (digits), a unit (after a number)
    or a name (a capital inside a sentence). ``literal`` hashes the bare word, ``token`` the word or
    its placeholder.
    """

    def __init__(self, column: pa.Array) -> None:
        data, bounds = W.text_buffer(column)
        raw = W.Words(data, bounds)
        kind = _CLASS[data]
        folded = _FOLD[data]
        capital = (data >= ord("A")) & (data <= ord("Z"))
        if len(data) > 1:
            latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            folded[1:][latin] += 32
            capital[:-1] |= latin
        # bare words: the bytes of each word without punctuation, packed one after another
        keep = np.flatnonzero(kind != _JUNK)
        starts, ends = np.searchsorted(keep, raw.starts), np.searchsorted(keep, raw.ends)
        some = ends > starts
        row = np.repeat(np.arange(len(raw.counts)), raw.counts)
        self.row = row[some]
        starts, ends = starts[some], ends[some]
        self.literal = W.hash_spans(folded[keep], starts, ends)
        digits = np.concatenate([[0], np.cumsum(kind[keep] == _DIGIT)])
        n_digits = digits[ends] - digits[starts]
        number = n_digits == ends - starts
        first_capital = capital[keep][starts] if len(starts) else np.zeros(0, bool)
        # a sentence starts with the text, after a word that ends with a mark and after a line break
        raw_start, raw_end = raw.starts[some], raw.ends[some]
        opens = np.ones(len(raw_start), bool)
        if len(raw_start) > 1:
            opens[1:] = _ENDS[data[raw_end[:-1] - 1]] | (self.row[1:] != self.row[:-1])
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            opens[1:] |= lines[raw_start[1:]] > lines[raw_end[:-1]]
        place = np.searchsorted(_UNIT_HASHES, self.literal)
        unit = _UNIT_HASHES[np.minimum(place, len(_UNIT_HASHES) - 1)] == self.literal
        after = np.zeros(len(starts), bool)
        after[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        self.slot = np.where(number, NUMBER, np.where(unit & after, UNIT, np.where(first_capital & ~opens, NAME, 0))).astype(np.int8)
        self.token = np.where(self.slot > 0, _TOKENS[self.slot], self.literal)
        self.offsets = np.searchsorted(self.row, np.arange(len(raw.counts) + 1))


class Benchmark:
    """Window index of a block of benchmark items."""

    def __init__(self, ids: list, texts: list, width: int, most_slots: float) -> None:
        t = Templates(pa.array(texts, pa.string()))
        self.ids, self.width = ids, width
        self.lengths = np.diff(t.offsets)
        self.slot, self.literal, self.item = t.slot, t.literal, t.row
        self.base = t.offsets[:-1]
        hashes, starts = [], []
        for w in sorted({min(width, int(n)) for n in self.lengths if n}):
            whole = W.window_starts(t.offsets, w)
            if w < width:  # items shorter than a window are one window themselves
                whole = whole[self.lengths[t.row[whole]] == w]
            hashes.append(W.window_hashes(t.literal, w)[whole] ^ W.U64(w))
            slots = np.concatenate([[0], np.cumsum(t.slot > 0)])
            some = slots[whole + w] - slots[whole]
            form = whole[(some > 0) & (some <= most_slots * w)]
            hashes.append(W.window_hashes(t.token, w)[form] ^ W.U64(w))
            starts += [whole, form]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, W.U64)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts = hashes[order], starts[order]
        self.widths = sorted({min(width, int(n)) for n in self.lengths if n})
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> W.U64(42)).astype(np.int64)] = True


def _matches(t: Templates, b: Benchmark, least: float, run: int, literal: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, covered words, words of the item, changed slots) of every item that a text holds."""
    at, entry, bare = [], [], []
    for w in b.widths:
        starts = W.window_starts(t.offsets, w)
        if not len(starts):
            continue
        slots = np.concatenate([[0], np.cumsum(t.slot > 0)])
        form = starts[slots[starts + w] > slots[starts]]  # windows without slots are the same either way
        found = np.concatenate([W.window_hashes(t.literal, w)[starts], W.window_hashes(t.token, w)[form]]) ^ W.U64(w)
        n_bare, starts = len(starts), np.concatenate([starts, form])
        maybe = np.flatnonzero(b.filter[(found >> W.U64(42)).astype(np.int64)])
        lo = np.searchsorted(b.hashes, found[maybe], "left")
        n = np.searchsorted(b.hashes, found[maybe], "right") - lo
        at.append(np.repeat(starts[maybe], n))
        bare.append(np.repeat(maybe < n_bare, n))
        entry.append(np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(int(n.sum())))
    if not at or not sum(map(len, at)):
        return
    at, there, bare = np.concatenate(at), b.starts[np.concatenate(entry)], np.concatenate(bare)
    item, row = b.item[there], t.row[at]
    shift = at - there
    order = np.lexsort((at, shift, item, row))
    at, there, item, row, shift, bare = at[order], there[order], item[order], row[order], shift[order], bare[order]
    pair = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    new = pair | np.concatenate([[True], shift[1:] != shift[:-1]])
    first = np.append(np.flatnonzero(new), len(at))
    near = pair | np.concatenate([[True], shift[1:] > shift[:-1] + SHIFT])  # passages of one item that words were put into or left out of
    for a, z in zip(np.flatnonzero(near).tolist(), [*np.flatnonzero(near)[1:].tolist(), len(at)], strict=True):
        inside = first[(first >= a) & (first < z)].tolist()
        best = None
        for lo, hi in [*zip(inside, [*inside[1:], z], strict=True), *([(a, z)] if len(inside) > 1 else [])]:
            found = _passage(t, b, int(item[a]), there[lo:hi], shift[lo:hi], bare[lo:hi], least, run, literal)
            best = max(best, found) if best and found else best or found
        if best:
            yield int(row[a]), int(item[a]), best[0], int(b.lengths[item[a]]), -best[1]


def _passage(t: Templates, b: Benchmark, item: int, there: np.ndarray, shift: np.ndarray, bare: np.ndarray, least: float, run: int, literal: bool) -> tuple[int, int] | None:
    """(covered words of the item, minus its changed slots) where windows at some offsets make up enough of it."""
    length, base = int(b.lengths[item]), int(b.base[item])
    width = min(b.width, length)
    covered = _covered(there - base, width, length)
    if not _enough(covered, length, least, run):
        return None
    mine = (there[:, None] + np.arange(width)).ravel()
    theirs = mine + np.repeat(shift, width)
    slots = b.slot[mine] > 0
    x, y = b.literal[mine][slots], t.literal[theirs][slots]
    pairs = np.unique(np.stack([x, y]), axis=1) if len(x) else np.zeros((2, 0), W.U64)
    # a value of the item must always stand for one value of the text, and the other way round
    if pairs.shape[1] != len(np.unique(x)) or pairs.shape[1] != len(np.unique(y)):
        said = _covered(there[bare] - base, width, length) if literal else covered[:0]
        return (len(said), 0) if _enough(said, length, least, run) else None  # enough without any placeholder
    return len(covered), -len(np.unique(mine[slots][x != y]))


def _covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Words of an item that lie in windows with these starts."""
    mark = np.zeros(length + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + width, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _enough(covered: np.ndarray, length: int, least: float, run: int) -> bool:
    return len(covered) > 0 and (len(covered) >= least * length or (len(covered) >= run and _longest(covered) >= run))


def _longest(covered: np.ndarray) -> int:
    cuts = np.flatnonzero(np.diff(covered) > 1)
    edges = np.concatenate([[-1], cuts, [len(covered) - 1]])
    return int(np.diff(edges).max())


HITS = "row long, item long, covered int, item_words int, changed int"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of ``block_items`` items, in order of their ids."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull())
    ids, texts = [], []
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        if len(ids) == block_items:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 8, least: float = 0.5, run: int = 13, most_slots: float = 0.5, block_items: int = 20_000, literal: bool = False,
) -> DataFrame:
    """Columns of ``docs`` plus ``hits``: array of (item, covered, item_words, changed), by item.

    Texts become templates: bare lower-case words, with placeholders for numbers, units after
    numbers, and names (capitals inside a sentence). Windows of ``width`` template words, at most
    ``most_slots`` of them placeholders, are looked up among the benchmark's by hash, and so are the
    windows of bare words; an item shorter than a window is one window. Windows of one item at one
    offset form a passage, and so do those at offsets up to ``SHIFT`` words apart from one to the next
    (words put in or left out); it counts if it covers ``least`` of the item's words or ``run`` consecutive ones, and if its slots are consistent:
    each value of the item stands for one value of the text throughout, and the reverse, so that
    questions with other numbers or names are caught (``changed`` counts replaced slots) and chance
    matches are not. With ``literal`` a passage whose slots are not consistent still counts where its
    windows of bare words alone cover enough. The best passage per item is given.

    The benchmark goes to the executors in blocks of ``block_items`` items, one pass over the texts
    for each block, so any benchmark fits. Null texts and ids of the benchmark are left out; null and
    empty texts of ``docs`` have no hits; item texts without words match nothing; items that
    share an id give one hit, the best, whichever blocks they fall into. An empty table gives an empty result; a column ``hits`` of ``docs`` is
    replaced.
    """
    prepare(docs.sparkSession)
    hit = f"struct<item:{benchmark.schema[item_col].dataType.simpleString()},covered:int,item_words:int,changed:int>"
    out = docs.drop("hits").withColumn("hits", F.array().cast(f"array<{hit}>"))
    for ids, texts in _blocks(benchmark, item_col, item_text_col, block_items):
        out = out.mapInArrow(lean(_scan(ids, texts, text_col, width, least, run, most_slots, literal)), out.schema)
    return out


def _scan(ids: list, texts: list, text_col: str, width: int, least: float, run: int, most_slots: float, literal: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Benchmark(ids, texts, width, most_slots)
        for batch in batches:
            for part in W.slices(batch, text_col):
                best: dict[tuple[int, int], tuple] = {}
                for row, item, covered, words, changed in _matches(Templates(part.column(text_col)), index, least, run, literal):
                    best[row, ids[item]] = max(best.get((row, ids[item]), (0, 0, 0)), (covered, words, -changed))
                at = part.schema.get_field_index("hits")
                if best:
                    hits = [{h["item"]: h for h in row} for row in part.column(at).to_pylist()]
                    for (row, item), (covered, words, changed) in best.items():
                        old = hits[row].get(item)
                        if old is None or (covered, words, changed) > (old["covered"], old["item_words"], -old["changed"]):
                            hits[row][item] = {"item": item, "covered": covered, "item_words": words, "changed": -changed}
                    made = [[row[i] for i in sorted(row)] for row in hits]
                    part = part.set_column(at, part.schema.field(at), pa.array(made, part.schema.field(at).type))
                yield part

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; options as for ``contaminated``."""
    return contaminated(docs, benchmark, **options).where(F.size("hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
