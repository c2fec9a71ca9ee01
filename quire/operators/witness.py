"""Operators that reconcile witnesses: containment, alignment, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import text_skeleton


def _runs(n: int):
    """Hashes of all runs of ``n`` tokens of the array column ``_t``."""
    return F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice("_t", i, F.lit(n))))


def contains_run(hay: DataFrame, needles: DataFrame, hay_col: str, needle_col: str, hay_id: str, width: int = 4) -> DataFrame:
    """(columns of ``needles``, hay_id) of the pairs where a hay's padded skeleton holds a needle's as a run of tokens.

    Candidates come from an equi-join on the hash of the needle's first tokens (``width`` of them, or all
    of a shorter one) against the runs of that many tokens of the hay. Only ids and hashes are exploded;
    runs that begin no needle go at once, and texts meet their candidates last, once each. An empty
    needle matches nothing; rows of ``hay`` without an id take no part.
    """
    probe = needles.withColumn("_t", F.split(F.trim(needle_col), " ")).where(F.length(F.trim(needle_col)) > 0)
    probe = probe.withColumn("_n", F.least(F.size("_t"), F.lit(width)))
    probe = probe.withColumn("_key", F.xxhash64("_n", F.slice("_t", 1, F.col("_n")))).drop("_t", "_n")
    none = F.array().cast("array<bigint>")
    runs = F.concat(*[F.when(F.size("_t") >= n, _runs(n)).otherwise(none) for n in range(1, width + 1)])
    keyed = hay.select(F.col(hay_id), F.split(F.trim(hay_col), " ").alias("_t")).select(hay_id, F.explode(F.array_distinct(runs)).alias("_key"))
    pairs = keyed.join(probe, "_key").drop("_key").distinct()
    texts = hay.select(F.col(hay_id), F.col(hay_col).alias("_hay"))
    return pairs.join(texts, hay_id).where(F.contains("_hay", needle_col)).drop("_hay")


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer pairing on a key: (key, n_left, n_right, status matched, left_only or right_only)."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    status = F.when(F.col("n_left").isNull(), "right_only").when(F.col("n_right").isNull(), "left_only").otherwise("matched")
    joined = a.join(b, key, "full_outer").withColumn("status", status)
    return joined.select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), "status")


def reconcile(rows: DataFrame, number: str, witness: str, place: str, text: str, rank: str) -> DataFrame:
    """Verdict per number: single, confirmed (one skeleton) or disputed; the witness of best rank; the texts by witness.

    A number that one witness repeats keeps its last text by ``place``. Texts are compared by their
    skeletons. One witness is never agreement. Columns: number, witnesses, versions, best (the witness
    of least rank, of equal ones the first by name), best_rank, status, texts (map).
    """
    last = rows.groupBy(number, witness).agg(F.max_by(F.struct(F.col(text).alias("text"), F.col(rank).alias("rank")), F.struct(place, text)).alias("_last"))
    one = last.select(number, witness, "_last.text", "_last.rank").withColumn("_skeleton", F.sha2(text_skeleton(F.col("text")), 256))
    out = one.groupBy(number).agg(
        F.count("*").alias("witnesses"), F.count_distinct("_skeleton").alias("versions"), F.min(F.struct("rank", witness)).alias("_best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(witness, "text")))).alias("texts"),
    )
    status = F.when(F.col("witnesses") == 1, "single").when(F.col("versions") == 1, "confirmed").otherwise("disputed")
    return out.select(number, "witnesses", "versions", F.col(f"_best.{witness}").alias("best"), F.col("_best.rank").alias("best_rank"), status.alias("status"), "texts")


def independent_witnesses(rows: DataFrame, key: str, provider: str) -> DataFrame:
    """Editions and distinct providers per key: copies from one provider are one witness."""
    return rows.groupBy(key).agg(F.count("*").alias("editions"), F.count_distinct(provider).alias("witnesses"))
