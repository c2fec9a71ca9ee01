"""One-hop link groups in transmission order, and censuses of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CATEGORY = "(uncategorized)"


def category_rank(category: Column, order: list[str]) -> Column:
    """Place of a category in an order; unknown ones come after all, by name."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in order]), category), F.lit(0)), F.lit(len(order) + 1))


def chain(links: DataFrame, order: list[str]) -> DataFrame:
    """Links (category, work, ref, ord) grouped by category and work.

    Blank refs are dropped, blank categories named; each ref counts once, at its first place. Result:
    (category, rank, work, refs in first-seen order).
    """
    known = links.where(F.coalesce(F.col("ref"), F.lit("")) != "")
    category = F.when(F.coalesce(F.col("category"), F.lit("")) == "", NO_CATEGORY).otherwise(F.col("category"))
    first = known.withColumn("category", category).groupBy("category", "work", "ref").agg(F.min("ord").alias("ord"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"])
    out = first.groupBy("category", "work").agg(refs.alias("refs"))
    return out.withColumn("rank", category_rank(F.col("category"), order))


def census(cells: DataFrame, work: str, chapter: str, size: str) -> DataFrame:
    """Per work: chapters, populated anchors (size above 0) and the total of sizes."""
    return cells.groupBy(work).agg(
        F.count_distinct(chapter).alias("chapters"),
        F.count_if(F.col(size) > 0).alias("populated"),
        F.sum(size).cast("long").alias("total"),
    )
