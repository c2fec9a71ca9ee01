"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut, prepare

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks into which each source is dealt; quotas are whole blocks.
BLOCKS = 1024
#: Bytes of text for an output shard where their number is not stated.
SHARD_BYTES = 128 << 20
#: Bytes of text per word, for the number of partitions.
WORD_BYTES = 6
#: Sources whose plans are small enough to go to every task (some 10 KB each).
BROADCAST_SOURCES = 1000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared.

    Sources hit their bound in order of size over weight, so one pass over them in that order finds
    which ones do.
    """
    out, weight, left = [0.0] * len(sizes), float(sum(weights)), float(total)
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: most * sizes[i] / weights[i])
    for n, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * weight:
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def fill_blocks(words: np.ndarray, order: np.ndarray, goal: float) -> np.ndarray:
    """Blocks, in permuted order, whose words fit into the goal; mask over blocks.

    A block that no longer fits is passed over, so what is missing in the end is less than the
    smallest block passed over; that block is added where this comes nearer to the goal.
    """
    taken, left = np.zeros(len(words), bool), goal
    for b in order:
        if 0 < words[b] <= left:
            taken[b] = True
            left -= words[b]
    rest = [b for b in order if not taken[b] and words[b] > 0]
    if rest and (least := min(rest, key=lambda b: words[b])) is not None and words[least] - left < left:
        taken[least] = True
    return taken


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "little")


def split_blocks(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each stratum for each shard, (shards, strata), by the splitting tree.

    ``units`` are the block quotas of the strata. Each node of the tree splits its quotas between its
    two halves of the shards by one multivariate hypergeometric draw, so that the halves' sums are as
    the numbers of their shards; columns sum up to the quotas exactly.
    """
    if shards == 1:
        return units[None, :]
    left, total = shards // 2, int(units.sum())
    half = rng.multivariate_hypergeometric(units, total * left // shards, method="marginals")
    return np.vstack([split_blocks(half, left, rng), split_blocks(units - half, shards - left, rng)])


def draw(words: np.ndarray, size: int, goal: float, most: float, shards: int, seed: int, name: object) -> list[list[int]]:
    """What a mix takes of one source: for each block the shards of its copies.

    The source's quotas are strata: its whole passes over all blocks with words, and the blocks of the
    last, partial pass. The tree parts the quotas among the shards; then every shard draws its blocks
    of a stratum as the next ones of the stratum's own permutation, so that the draws are disjoint.
    """
    rng = np.random.default_rng(_seed(seed, "draw", name))
    whole = int(min(goal // size, most)) if size else 0
    part = fill_blocks(words, rng.permutation(BLOCKS), goal - whole * size) if whole < most and size else np.zeros(BLOCKS, bool)
    strata = [np.flatnonzero(words > 0)] * whole + [np.flatnonzero(part)]
    cells = split_blocks(np.array([len(s) for s in strata], np.int64), shards, rng)
    held: list[list[int]] = [[] for _ in range(BLOCKS)]
    for stratum, blocks in enumerate(strata):
        drawn, at = rng.permutation(blocks), 0
        for shard in range(shards):
            for b in drawn[at : at + cells[shard, stratum]]:
                held[b].append(shard)
            at += cells[shard, stratum]
    return held


def cyclic_weights(*cycle: float):
    """Weights that repeat over the sources in order."""
    return lambda n: [float(cycle[i % len(cycle)]) for i in range(n)]


def block_of(key: Column, seed: int) -> Column:
    """Block of a row within its source, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BLOCKS)).cast("int")


def _plans(seed: int, most: float, shards: int):
    """Per source one row of totals to one row with the shards of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = np.zeros(BLOCKS, np.int64)
                words[r["blocks"]] = r["words"]
                rows.append(draw(words, r["_size"], r["_target"], most, shards, seed, r["name"]))
            made = pa.array(rows, pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_source", "_size", "_target")] + [made], ["_source", "_size", "_target", "_shards"])

    return run


def _goals(totals: DataFrame, weights, most: float, kind: str) -> DataFrame:
    """(source, size, target): the targets of all sources, from one row of each (name, size) on the driver."""
    rows = totals.select(F.col("source").alias("_source"), F.col("size").alias("_size")).toArrow()  # a name and a number for each source
    names = rows.column("_source").to_pylist()
    rows = rows.take(pa.array(sorted(range(len(names)), key=lambda i: (names[i] is None, [ord(c) for c in str(names[i])] if names[i] is not None else [])), pa.int64()))
    sizes = rows.column("_size").to_pylist()
    goals = targets(sizes, weights(len(sizes)), sum(sizes), most)
    rows = rows.append_column("_target", pa.array([float(g) for g in goals], pa.float64()))
    return totals.sparkSession.createDataFrame(rows, f"_source {kind}, _size long, _target double")  # as Arrow: a list of rows starts Python workers of another kind, which stay


def mix(
    docs: DataFrame, weights=None, most: float = 3.0, shards: int | None = None, seed: int = 11,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): every row with what the mix takes of it, and the sources with their targets.

    ``rows`` has the columns of ``docs`` plus ``mix`` (struct of size, source_size, target, and
    shards: the output shard of each copy taken, empty for rows left out). Size is the number of
    words. A source's target is its share by weight of all words, not above ``most`` times its size.
    Whole passes over a source take every block once; the last, partial pass takes whole blocks of
    its permuted order that fill the rest of the target; the splitting tree parts these block quotas
    among the shards (see ``draw``). No row is taken more than ``ceil(most)`` times. Rows of a source
    are dealt into blocks by a hash of id and text, so repeated rows share a block; a null id, source
    or text is a value like any other (a null text has size 0); rows of size 0 go with their block where
    it has words, else they stay out. An empty table gives an empty mix. The same input, parameters and
    seed give the same mix, however the rows are partitioned. A column ``mix`` of ``docs`` is replaced.
    ``shards``: by default as many as hold ``SHARD_BYTES`` of text each.

    ``weights``: function of the number of sources, which stand in code-point order, null last, to
    their weights. The driver holds a name, a size and a target for each source; blocks are filled and
    parted in Spark, a source at a time. Plans are broadcast for ``BROADCAST_SOURCES`` sources at most;
    more are joined, rows and plans both split by source and block.
    """
    prepare(docs.sparkSession)
    docs, weights = docs.drop("mix"), weights or cyclic_weights(5, 2, 1)
    key = F.struct(F.col(id_col), F.xxhash64(text_col))
    info = F.struct(F.col(source_col).alias("source"), block_of(key, seed).alias("block"), word_count(F.col(text_col)).alias("size"), F.octet_length(text_col).alias("bytes"))
    blocks = docs.select(info.alias("i")).groupBy("i.source", "i.block").agg(F.sum("i.size").alias("words"), F.sum("i.bytes").alias("bytes"))
    totals = cut(blocks.groupBy("source").agg(F.sum("words").alias("size"), F.sum("bytes").alias("bytes"), F.collect_list("block").alias("blocks"), F.collect_list("words").alias("words")))
    shards = shards or max(1, -(-(totals.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    kind = docs.schema[source_col].dataType.simpleString()
    goals = cut(_goals(totals, weights, most, kind))
    named = totals.join(goals, totals["source"].eqNullSafe(goals["_source"])).select("_source", "_size", "_target", "blocks", "words", F.col("_source").cast("string").alias("name"))
    plans = cut(named.mapInArrow(_plans(seed, most, shards), f"_source {kind}, _size long, _target double, _shards array<array<int>>"))
    joined = docs.select(F.struct("*").alias("row"), info.alias("info"))
    same = F.col("info.source").eqNullSafe(F.col("_source"))
    if goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = joined.join(F.broadcast(plans), same).withColumn("_at", F.element_at("_shards", F.col("info.block") + 1))
    else:  # by source and block, so that a hot source is split
        cells = plans.select("_source", "_size", "_target", F.posexplode("_shards").alias("_block", "_at"))
        joined = joined.join(cells, same & (F.col("info.block") == F.col("_block")))
    out = F.struct(F.col("info.size").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_at").alias("shards"))
    sources = goals.select(F.col("_source").alias("source"), F.col("_size").alias("source_size"), F.col("_target").alias("target"))
    return joined.select("row.*", out.alias("mix")), sources


def mixed_rows(rows: DataFrame, seed: int = 11, keys: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The mix itself: a row per copy, dealt to its shard and shuffled there.

    ``rows`` as ``mix`` gives them; any columns beside ``mix`` and ``keys`` go along. Rows are dealt by
    range of shard and of a hash of copy and keys, so that a shard is some neighbouring partitions,
    whatever its size; within them rows stand in the order of that hash. The result has the columns of
    ``rows`` but for ``mix``, and ``shard``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "mix"]).alias("row")
    taken = rows.select(row, F.posexplode("mix.shards").alias("copy", "shard"))
    taken = taken.withColumn("order", F.xxhash64(F.lit(seed), "shard", "copy", *[f"row.{k}" for k in keys]))
    size = WORD_BYTES * (rows.agg(F.sum(F.col("mix.size") * F.size("mix.shards"))).first()[0] or 0)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    return taken.repartitionByRange(parts, "shard", "order").sortWithinPartitions("shard", "order").select("row.*", "shard")


def drawn_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies, taken (words of all copies).

    ``copies`` counts the rows that ``mixed_rows`` has dealt out, here without their texts. Repeated rows
    share a block and so have the same copies.
    """
    rows, _ = mix(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), id_col="id", source_col="source", text_col="text", **options)
    rows = cut(rows.select("id", F.xxhash64("text").alias("key"), "mix"))
    what = ["id", "key", "size", "source_size", "target"]
    fields = [F.col("mix.size").alias("size"), F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target")]
    there = rows.select("id", "key", *fields, F.lit(1).alias("there"), F.lit(0).alias("copies"))
    dealt = mixed_rows(rows.select("id", "key", *fields, "mix"), keys=("id", "key")).select(*what, F.lit(0).alias("there"), F.lit(1).alias("copies"))
    each = there.unionByName(dealt).groupBy(*what).agg(F.sum("there").alias("there"), F.sum("copies").alias("copies"))
    each = each.withColumn("copies", (F.col("copies") / F.col("there")).cast("long")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "there")))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
