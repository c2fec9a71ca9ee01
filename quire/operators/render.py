"""Readings as Markdown, with the romanization's flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.romanizer import romanize

# Characters that file names do not take, and what stands for them
UNSAFE = (("/", "-"), (":", "."), ("\\", "-"), ("?", ""), ("*", ""), ("<", ""), (">", ""), ("|", "-"), ('"', "'"))
NO_SCHEME_USED = "[scheme-unused] a tier-1 quotation has no romanization line, so the scheme had no effect here"


def _lines(*lines: Column) -> Column:
    """Lines joined; null ones are left out."""
    return F.concat_ws("\n", *lines)


def _given(value: Column) -> Column:
    return F.nullif(F.coalesce(value, F.lit("")), F.lit(""))


def _needed(text: Column, ref: Column) -> Column:
    return F.coalesce(_given(text), F.raise_error(F.concat(F.lit("no Hebrew found for "), ref)).cast("string"))


def block(ref: Column, text: Column, edition: Column, english: Column, english_edition: Column) -> Column:
    """A long quotation: text, translation and where they come from."""
    other = F.when(_given(english_edition).isNotNull() & ~english_edition.eqNullSafe(edition), F.concat(F.lit("; translation, "), english_edition)).otherwise("")
    cited = F.concat(F.lit("> "), ref, F.coalesce(F.concat(F.lit(", "), _given(edition)), F.lit("")), other)
    return _lines(F.concat(F.lit("> "), _needed(text, ref)), F.lit(">"), F.concat(F.lit("> "), _given(english)), F.when(_given(english).isNotNull(), ">"), cited)


def teaching(ref: Column, text: Column, edition: Column, english: Column, scheme: str) -> Column:
    """struct<text, flags>: text, romanization and translation stacked."""
    r = romanize(text, scheme)
    said = F.when(F.trim(r["text"]) != "", F.concat(F.lit("*"), r["text"], F.lit("*")))
    footer = F.concat(ref, F.coalesce(F.concat(F.lit(" ("), _given(edition), F.lit(")")), F.lit("")), F.lit(f". Romanization: {scheme}."))
    return F.struct(_lines(_needed(text, ref), said, _given(english), F.lit(""), footer).alias("text"), r["flags"].alias("flags"))


def interlinear(ref: Column, text: Column, edition: Column, scheme: str) -> Column:
    """A line per word with its romanization."""
    def line(w: Column) -> Column:
        r = romanize(w, scheme)["text"]
        return F.concat(F.lit("> "), w, F.when(F.trim(r) != "", F.concat(F.lit(" — *"), r, F.lit("*"))).otherwise(""))

    words = F.filter(F.split(_needed(text, ref), r"(?U)\s+"), lambda w: w != "")
    footer = F.concat(ref, F.coalesce(F.concat(F.lit(" ("), _given(edition), F.lit(")")), F.lit("")))
    return _lines(F.array_join(F.transform(words, line), "\n"), F.lit(""), footer)


def inline(text: Column, translation: Column, scheme: str) -> Column:
    """A phrase for the middle of a sentence; an empty one is an error."""
    r = romanize(text, scheme)["text"]
    gloss = F.when(F.trim(r) != "", F.concat(F.lit("*"), r, F.lit("*"), F.coalesce(F.concat(F.lit(", "), _given(translation)), F.lit("")))).otherwise(F.coalesce(translation, F.lit("")))
    return F.concat(F.coalesce(_given(F.trim(text)), F.raise_error(F.lit("no text to gloss")).cast("string")).substr(F.lit(1), F.lit(0)), text, F.lit(" ("), gloss, F.lit(")"))


def file_name(ref: Column, extension: str = ".md") -> Column:
    for bad, good in UNSAFE:
        ref = F.replace(ref, F.lit(bad), F.lit(good))
    return F.concat(F.trim(F.regexp_replace(ref, r"(?U)\s+", " ")), F.lit(extension))


def study_files(segments: DataFrame, editions: DataFrame, scheme: str) -> DataFrame:
    """(ref, name, text, flags): a file per reading: heading, every segment with romanization and translation, and the editions.

    ``segments`` has (ref, anchor, position, text, translation), ``editions`` (ref, place, title, provider).
    """
    r = romanize(F.col("text"), scheme)
    said = F.when(F.trim(r["text"]) != "", F.concat(F.lit("\n*"), r["text"], F.lit("*")))
    part = _lines(F.concat(F.lit("**"), F.col("anchor"), F.lit("**\n")), F.col("text"), said, F.concat(F.lit("\n"), _given(F.col("translation"))), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("position", part.alias("part"), r["flags"].alias("flags"))))
    files = segments.groupBy("ref").agg(ordered.alias("parts"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "provider"))), lambda e: F.concat(F.lit("- "), e["title"], F.lit(", "), e["provider"]))
    where = editions.groupBy("ref").agg(F.array_join(listed, "\n").alias("editions"))
    text = F.concat(F.lit("# "), F.col("ref"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), F.lit("\n## Editions\n\n"), F.coalesce("editions", F.lit("")), F.lit("\n"))
    return files.join(where, "ref", "left").select("ref", file_name(F.col("ref")).alias("name"), text.alias("text"), F.flatten(F.transform("parts", lambda p: p["flags"])).alias("flags"))


def write_files(files: DataFrame, folder: str) -> None:
    """Files by name below a folder, one text each, on any store that Spark writes to."""
    files.select("text", F.col("name").alias("file")).write.partitionBy("file").text(folder)


def json_document(row: Column) -> Column:
    """A row as one JSON document."""
    return F.to_json(row, {"ignoreNullFields": "false"})
