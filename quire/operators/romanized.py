"""Romanization of whole tables: each distinct word once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import hebrew
from quire.functions.arrays import let
from quire.functions.romanizer import romanize_word
from quire.functions.schemes import SCHEMES


def romanize_texts(texts: DataFrame, id_col: str, text_col: str, scheme: str = "sbl-general", literal: bool = False, established: bool = False) -> DataFrame:
    """(id, text, flags): as ``romanizer.romanize`` for every text, each distinct word worked out once.

    Runs are exploded, distinct words romanized, and joined back by word; adaptive execution sends the
    words to the runs where they are few, and splits a word that a large part of the runs share. Ids are
    unique; a null text has a null row.
    """
    chosen = SCHEMES[scheme]
    runs = texts.select(F.col(id_col).alias("id"), F.posexplode_outer(hebrew.runs(hebrew.normalized(F.col(text_col)))).alias("at", "run")).select("id", "at", "run.*")
    word = let(romanize_word(F.col("text"), F.col("trailing") != "", chosen, literal, established), lambda w: w)
    words = runs.where("kind = 'hebrew'").select("text", "trailing").distinct().repartition("text").select("text", "trailing", word.alias("word"))
    named = words.select(F.col("text").alias("_text"), F.col("trailing").alias("_trailing"), "word")
    joined = runs.join(named, (F.col("kind") == "hebrew") & (F.col("text") == F.col("_text")) & (F.col("trailing") == F.col("_trailing")), "left")
    said = F.when(F.col("kind") == "hebrew", F.concat("word.text", F.when(F.col("trailing") != "", "-").otherwise(""))).otherwise(hebrew.strip_punctuation(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("at", said.alias("said"), F.coalesce("word.flags", F.array().cast("array<string>")).alias("flags"))))
    out = joined.groupBy("id").agg(parts.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    empty = texts.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("null"))
    return out.join(empty, "id").select(F.col("id").alias(id_col), F.when(~F.col("null"), whole).alias("text"), F.flatten(F.transform("parts", lambda p: p["flags"])).alias("flags"))
