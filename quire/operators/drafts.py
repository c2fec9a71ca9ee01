"""Verification of drafts: are the passages that a draft quotes in the places it cites?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import hebrew
from quire.functions.arrays import let
from quire.operators.editions import hebrew_words

#: Words that a Hebrew run has at least to be checked.
LEAST_WORDS = 3


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def hebrew_runs(paragraph: Column, least: int = LEAST_WORDS) -> Column:
    """Longest stretches of words that each hold Hebrew, of ``least`` words and more."""
    words = F.filter(F.split(paragraph, r"(?U)\s+"), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(hebrew.has_hebrew(w), w).otherwise("\n")), " ")
    runs = F.transform(F.split(marked, r"\s*\n\s*"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: F.size(F.filter(F.split(r, " "), lambda w: w != "")) >= least)


def padded(words: Column) -> Column:
    """Skeletons joined and framed by spaces, so that a run of words is a substring."""
    return F.concat(F.lit(" "), F.array_join(words["skeleton"], " "), F.lit(" "))


def contains_run(source: Column, quotation: Column) -> Column:
    """Whether a quotation's words stand one after another in a source, points and punctuation aside."""
    needle = hebrew_words(quotation, blank=False)
    return (F.size(needle) > 0) & F.contains(padded(hebrew_words(source, blank=False)), padded(needle))


def diagnose(source: Column, quotation: Column) -> Column:
    """struct<matched, draft_word, edition_word>: the longest beginning of the quotation that the source has, and where they part.

    Of places with equally long beginnings the first counts.
    """

    def found(both: Column) -> Column:
        needle, hay = both["needle"], both["hay"]

        def length(start: Column) -> Column:
            rest = F.slice(hay, start + 1, F.size(needle))
            step = lambda a, pair: F.when(a["on"] & F.coalesce(pair["same"], F.lit(False)), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on")))
            pairs = F.zip_with(needle, rest, lambda x, y: F.struct((x["skeleton"] == y["skeleton"]).alias("same")))
            return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda a: a["n"])

        # only places where the quotation's first word stands can match anything
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hay) - 1, F.lit(0))), lambda i: F.get(hay, i)["skeleton"] == needle[0]["skeleton"])
        lengths = F.transform(starts, lambda i: F.struct(length(i).alias("n"), (-i).alias("back")))
        return F.coalesce(F.when(F.size(needle) > 0, F.array_max(lengths)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("back")))

    def told(both: Column) -> Column:
        return let(
            found(both),
            lambda best: F.struct(
                F.array_join(F.transform(F.slice(both["needle"], 1, best["n"]), lambda w: w["word"]), " ").alias("matched"),
                F.coalesce(F.get(both["needle"], best["n"])["word"], F.lit("")).alias("draft_word"),
                F.when(best["n"] > 0, F.coalesce(F.get(both["hay"], best["n"] - best["back"])["word"], F.lit(""))).otherwise("").alias("edition_word"),
            ),
        )

    return let(F.struct(hebrew_words(quotation, blank=False).alias("needle"), hebrew_words(source, blank=False).alias("hay")), told)


def cited_nearby(drafts: DataFrame, citations: DataFrame) -> DataFrame:
    """(draft, paragraph, text, refs): paragraphs with the refs of citations whose matched text stands in them, in order, once each.

    ``drafts`` has (draft, text), ``citations`` (draft, place, matched, refs); a citation without text or
    refs belongs nowhere. Citations meet the paragraphs of their own draft only.
    """
    parts = drafts.select("draft", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    known = citations.where((F.coalesce("matched", F.lit("")) != "") & (F.size("refs") > 0)).select("draft", "place", "matched", "refs")
    met = parts.join(known, "draft").where(F.contains("text", "matched")).groupBy("draft", "paragraph")
    listed = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "refs"))), lambda x: x["refs"])))
    return parts.join(met.agg(listed.alias("refs")), ["draft", "paragraph"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def verify(drafts: DataFrame, citations: DataFrame, passages: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """A row per Hebrew run of a draft: (draft, paragraph, run, quotation, status, found_in, checked_against, divergence).

    A run is checked against the passages (ref, text) cited in its own paragraph: the first that holds
    it is ``found_in``. A run without citation is ``unchecked``, one that no passage holds ``not found``,
    with the divergence (ref, matched, draft_word, edition_word) from the passage that matches the most
    of its words, the first of equal ones.
    """
    near = cited_nearby(drafts, citations)
    runs = near.select("draft", "paragraph", "refs", F.posexplode(hebrew_runs(F.col("text"), least)).alias("run", "quotation"))
    tried = runs.select("draft", "paragraph", "run", "quotation", F.posexplode("refs").alias("place", "ref"))
    tried = tried.join(passages.select("ref", F.col("text").alias("passage")), "ref", "left").withColumn("passage", F.coalesce("passage", F.lit("")))
    tried = tried.withColumn("hit", contains_run(F.col("passage"), F.col("quotation"))).withColumn("why", F.when(~F.col("hit"), diagnose(F.col("passage"), F.col("quotation"))))
    words = F.size(F.filter(F.split("why.matched", " "), lambda w: w != ""))
    miss = F.struct("ref", "why.matched", "why.draft_word", "why.edition_word")
    told = tried.groupBy("draft", "paragraph", "run").agg(
        F.min_by(F.when(F.col("hit"), F.col("ref")), F.when(F.col("hit"), F.col("place"))).alias("found_in"),
        F.max_by(miss, F.struct(words, -F.col("place"))).alias("divergence"),
    )
    out = runs.join(told, ["draft", "paragraph", "run"], "left")
    status = F.when(F.col("found_in").isNotNull(), "found").when(F.size("refs") > 0, "not found").otherwise("unchecked")
    return out.select("draft", "paragraph", "run", "quotation", status.alias("status"), "found_in", F.col("refs").alias("checked_against"), F.when(status == "not found", F.col("divergence")).alias("divergence"))


def clean_reports(verified: DataFrame, citations: DataFrame) -> DataFrame:
    """(draft, ok): every citation resolved and every run found."""
    found = verified.groupBy("draft").agg(F.bool_and(F.col("status") == "found").alias("found"))
    resolved = citations.groupBy("draft").agg(F.bool_and(F.size("refs") > 0).alias("resolved"))
    joined = found.join(resolved, "draft", "full_outer")
    return joined.select("draft", (F.coalesce("found", F.lit(True)) & F.coalesce("resolved", F.lit(True))).alias("ok"))
