"""Editions of a passage: which ones are read, how they differ, and what is printed of them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from quire.functions import hebrew
from quire.functions import text as T

#: Editions of a passage that are read at most, and those that are compared.
MOST_READ, MOST_COMPARED = 12, 8
# Marks of an abbreviation, and the kinds of a difference
ABBREVIATION_MARKS = "[׳״'\"]"
INTERPOLATION, ABBREVIATION, SUBSTANTIVE = "interpolation", "abbreviation", "substantive"


def flatten_segments(texts: DataFrame, ref: str, payload: str, depth: int) -> DataFrame:
    """(ref, anchor, position, text): the leaves of a nested array ``depth`` levels deep, in order.

    The anchor is the path of 1-based places joined by colons; blank leaves are left out after cleaning.
    """
    rows = texts.select(F.col(ref).alias("ref"), F.array().cast("array<int>").alias("path"), F.col(payload).alias("node"))
    for _ in range(depth):
        rows = rows.select("ref", "path", F.posexplode("node").alias("at", "node")).select("ref", F.concat("path", F.array(F.col("at") + 1)).alias("path"), "node")
    clean = rows.withColumn("text", T.clean_html(F.col("node"))).where(F.col("text") != "")
    return clean.select("ref", F.array_join(F.col("path").cast("array<string>"), ":").alias("anchor"), F.col("path").alias("position"), "text")


def joined_segments(segments: DataFrame) -> DataFrame:
    """(ref, joined): the texts of each ref in order, joined by one space, empty ones skipped."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("position", "text"))))
    return segments.groupBy("ref").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("joined"))


def chosen_editions(editions: DataFrame, version: str = "all", most: int = MOST_READ) -> DataFrame:
    """Editions of each ref by a version's grammar, with ``place`` from 1 and ``left_out``, how many the cap leaves out.

    ``editions`` has (ref, title, language, is_source, is_primary, priority). ``all`` takes them all,
    ``source`` and ``primary`` those so marked, ``language`` those of a language, ``language|title`` one
    of its editions by title. Sources come first, then primary ones, then by falling priority, then title.
    """
    language, _, title = version.partition("|")
    known = {"all": F.lit(True), "source": F.col("is_source"), "primary": F.col("is_primary")}
    wanted = known.get(version, F.lower("language") == language.lower())
    if title:
        wanted = wanted & (F.col("title") == title)
    order = Window.partitionBy("ref").orderBy(F.desc("is_source"), F.desc("is_primary"), F.desc("priority"), "title")
    ranked = editions.where(wanted).withColumn("place", F.row_number().over(order)).withColumn("left_out", F.greatest(F.count("*").over(Window.partitionBy("ref")) - most, F.lit(0)))
    return ranked.where(F.col("place") <= most)


def in_language(rows: DataFrame, language: str, prefix: bool = True) -> DataFrame:
    """Editions whose stated or actual language begins with, or holds, a language's name."""
    names = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("language", "actual_language")]
    return rows.where((names[0].startswith(language.lower()) | names[1].startswith(language.lower())) if prefix else (names[0].contains(language.lower()) | names[1].contains(language.lower())))


def hebrew_words(text: Column, blank: bool = True) -> Column:
    """Words that hold Hebrew, as printed and as skeleton; without ``blank`` those of points alone go."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: hebrew.has_hebrew(w))
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), hebrew.skeleton(w).alias("skeleton")))
    return pairs if blank else F.filter(pairs, lambda p: p["skeleton"] != "")


_SPAN = StructType([StructField(n, IntegerType()) for n in ("left_from", "left_to", "right_from", "right_to")])


@F.pandas_udf(ArrayType(_SPAN))
def changed_spans(left: pd.Series, right: pd.Series) -> pd.Series:
    """Where two word lists differ, by the longest matching blocks (frequent words of long lists are passed over)."""
    out = []
    for a, b in zip(left, right, strict=True):
        blocks = difflib.SequenceMatcher(None, list(a), list(b)).get_opcodes()
        out.append([dict(left_from=i, left_to=j, right_from=k, right_to=m) for kind, i, j, k, m in blocks if kind != "equal"])
    return pd.Series(out)


def abbreviates(short: Column, whole: Column) -> Column:
    """Whether one side carries a mark of abbreviation and the other begins with its first letter."""
    head = F.left(hebrew.skeleton(short), F.lit(1))
    return (short != "") & (whole != "") & short.rlike(ABBREVIATION_MARKS) & (head != "") & hebrew.skeleton(whole).startswith(head)


def difference_kind(left: Column, right: Column) -> Column:
    return F.when((left == "") | (right == ""), INTERPOLATION).when(abbreviates(left, right) | abbreviates(right, left), ABBREVIATION).otherwise(SUBSTANTIVE)


def compare_editions(editions: DataFrame, language: str = "he", words=hebrew_words) -> DataFrame:
    """Every edition of a ref against its first one: (ref, left_edition, right_edition, position, kind, left, right).

    ``editions`` has (ref, place, title, language, actual_language, text). Texts are compared by the
    skeletons of their words; what differs is given as printed, ``position`` in the first edition's
    words. A ref with one edition in the language gives no rows. ``words``: function of a text to an
    array of (word, skeleton).
    """
    some = in_language(editions, language).select("ref", "place", "title", words(F.col("text")).alias("words"))
    first = Window.partitionBy("ref").orderBy("place", "title").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = some.withColumn("base", F.first("words").over(first)).withColumn("left_edition", F.first("title").over(first))
    paired = paired.withColumn("nth", F.row_number().over(Window.partitionBy("ref").orderBy("place", "title"))).where("nth > 1")
    spans = paired.withColumn("span", F.explode(changed_spans(F.col("base.skeleton"), F.col("words.skeleton"))))
    said = lambda of, side: F.array_join(F.slice(F.col(f"{of}.word"), F.col(f"span.{side}_from") + 1, F.col(f"span.{side}_to") - F.col(f"span.{side}_from")), " ")
    rows = spans.select("ref", "left_edition", F.col("title").alias("right_edition"), F.col("span.left_from").alias("position"), said("base", "left").alias("left"), said("words", "right").alias("right"))
    return rows.withColumn("kind", difference_kind(F.col("left"), F.col("right")))


def apparatus(editions: DataFrame, language: str = "he") -> DataFrame:
    """A row per edition of the language: (ref, place, title, provider, vocalization)."""
    return in_language(editions, language).select("ref", "place", "title", T.provider(F.col("source")).alias("provider"), hebrew.vocalization(F.col("text")).alias("vocalization"))


def witnesses(editions: DataFrame) -> DataFrame:
    """(ref, editions, providers in first-seen order, independent): copies from one provider are one witness."""
    rows = editions.select("ref", "place", T.provider(F.col("source")).alias("provider"))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "provider"))), lambda x: x["provider"]))
    return rows.groupBy("ref").agg(F.count("*").alias("editions"), listed.alias("providers")).withColumn("independent", F.size("providers"))


def tallies(differences: DataFrame) -> DataFrame:
    """Differences of each ref by kind."""
    return differences.groupBy("ref", "kind").agg(F.count("*").alias("n"))


def translated(segments: DataFrame, translation: DataFrame) -> DataFrame:
    """Segments (ref, anchor, position, text) with the translation of the same anchor, the last one where it repeats; null where there is none."""
    one = translation.groupBy("ref", "anchor").agg(F.max_by("text", "position").alias("translation"))
    return segments.join(one, ["ref", "anchor"], "left")


def sides(editions: DataFrame) -> DataFrame:
    """(ref, hebrew, english): the first edition's text of each side."""
    said = lambda lang: F.min_by(F.when(F.col("language").startswith(lang), F.col("text")), F.when(F.col("language").startswith(lang), F.col("place")))
    return editions.groupBy("ref").agg(said("he").alias("hebrew"), said("en").alias("english"))
