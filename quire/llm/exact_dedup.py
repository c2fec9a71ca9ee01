"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut

#: ASCII white space, deleted before texts are compared.
BLANKS = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _merge(runs: DataFrame) -> DataFrame:
    """One run per (run, digest): the best member and the number of members."""
    return runs.groupBy("run", "digest", "check").agg(F.min("best").alias("best"), F.sum("members").alias("members"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, groups) of equal texts.

    Texts are equal when identical after deleting ASCII white space; null is the empty text.
    ``rows`` has (id, digest, check), one row per input row; ``groups`` has (digest, check, keep_id,
    group_size). Of equal texts the one with the most code points in the original stays, then the
    smallest id; a null id comes last. Repeated rows count each. An empty table gives empty tables;
    other columns of ``docs`` are ignored.

    Each input partition forms a run of its digests with their best candidate. In every round
    ``fan_in`` neighbouring runs exchange their entries by digest and merge, keeping the smallest
    verified candidate, until one run (spread over all partitions by digest) is left. A group of
    copies sends one entry per run, whatever its size. ``check`` (length and a second, independent
    hash of the normalised text) verifies that equal digests stand for equal texts.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), normalised(text).alias("norm"))
    rows = cut(
        rows.select(
            "id", "chars",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.struct(F.length("norm").alias("length"), F.xxhash64("norm").alias("hash")).alias("check"),
            F.spark_partition_id().alias("run"),
        )
    )
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id"))
    runs = _merge(rows.select("run", "digest", "check", best.alias("best"), F.lit(1).cast("long").alias("members")))
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(n_runs, fan_in)))):
        runs = _merge(runs.withColumn("run", F.floor(F.col("run") / fan_in)))
    groups = runs.select("digest", "check", F.col("best.id").alias("keep_id"), F.col("members").alias("group_size"))
    return rows.select("id", "digest", "check"), groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (see ``exact_groups``).

    Of repeated rows with the kept id and the same text, all are marked kept. The rows of one large
    group meet their single group entry in a join that adaptive execution splits.
    """
    rows, groups = exact_groups(docs, id_col, text_col, fan_in)
    joined = rows.join(groups, ["digest", "check"])
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
