"""Statutes: delivered texts as sections with their headings, pairs of witnesses, amendments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

# How a section opens, what a heading in the margin looks like, furniture of converters, a line with a marginal entry
OPENING = r"^[ \t]*(?:§[ \t]*)?(\d{1,3}[A-Za-z]{0,2})\.[ \t]+(?=\S)"
HEADING = r"^[ \t]*([A-Z][A-Za-z’'()\- ]{2,48})[ \t]*$"
NOISE = r"(?i)^\s*(?:pd4ml.*|Chapter\s+[A-Z][a-z]+\s*[:：].*|Article\s+[A-Z][a-z]+\s*[:：].*)\s*$"
MARGIN = r"^([^\s][^\s]{0,2}[A-Za-z0-9'’()\-.,/ ]{0,27}?)\s{3,}(?=\S)"
#: Body lines of a page in two columns are indented by this much; shares of lines with a marginal entry and of indented ones.
LEAST_INDENT, MARGIN_SHARE, INDENT_SHARE, LEAST_LINES = 8, 0.08, 0.2, 6
SECTION_TEMPLATE = r"\{\{ח:סעיף\|([^|}]+)\|([^|}]*)([^}]*)\}\}"
AMENDED = "תיקון"


def strip_noise(line: Column) -> Column:
    """A line of converter's furniture as an empty one."""
    return F.when(line.rlike(NOISE), "").otherwise(line)


def running_key(line: Column) -> Column:
    """What tells a running head, loosely: the first 18 letters in lower case; null for lines that cannot be one.

    A head has 8 to 100 characters and at least 8 letters, four fifths of them capitals; it does not
    end like an unfinished sentence and does not open a section.
    """
    bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    head = F.length(bare).between(8, 100) & ~bare.rlike("[;:,]$") & (F.length(letters) >= 8) & (capitals >= F.length(letters) * 0.8) & ~bare.rlike(OPENING)
    return F.when(head, F.lower(F.left(letters, F.lit(18))))


def lines(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, line): lines of each text; page breaks and carriage returns end a line."""
    plain = F.regexp_replace(F.col(text), "\r\n|\r|\f", "\n")
    return texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(plain, "\n")).alias("n", "line"))


def running_heads(rows: DataFrame, least: int = 2) -> DataFrame:
    """(doc, key, times): heads that a text repeats; ``rows`` has (doc, line)."""
    keyed = rows.select("doc", running_key(F.col("line")).alias("key")).where(F.col("key").isNotNull())
    return keyed.groupBy("doc", "key").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def without_running_heads(rows: DataFrame, least: int = 2) -> DataFrame:
    """(doc, n, line, dropped): repeated heads as empty lines, what stood there in ``dropped``."""
    keyed = rows.withColumn("key", running_key(F.col("line")))
    heads = running_heads(rows, least).select("doc", "key", F.lit(True).alias("repeats"))
    marked = keyed.join(heads, ["doc", "key"], "left")
    return marked.select("doc", "n", F.when(F.col("repeats"), "").otherwise(F.col("line")).alias("line"), F.when(F.col("repeats"), F.trim("line")).alias("dropped"))


def margin_columns(rows: DataFrame) -> DataFrame:
    """(doc, margin): the width of the marginal column; null for pages in one column."""
    line = F.rtrim(F.col("line"))
    some = rows.where(F.trim("line") != "").select("doc", F.length(F.regexp_extract(line, MARGIN, 1)).alias("width"), (F.length(line) - F.length(F.ltrim(line))).alias("indent"))
    found = some.groupBy("doc").agg(
        F.count("*").alias("n"), F.count_if(F.col("width") > 0).alias("entries"), F.count_if(F.col("indent") >= LEAST_INDENT).alias("indented"), F.max("width").alias("widest")
    )
    two = (F.col("n") >= LEAST_LINES) & (F.col("entries") >= F.col("n") * MARGIN_SHARE) & (F.col("indented") >= F.col("n") * INDENT_SHARE) & (F.col("widest") > 0)
    return found.select("doc", F.when(two, F.col("widest")).alias("margin"))


def split_columns(line: Column, margin: Column) -> tuple[Column, Column]:
    """(marginal entry, body) of a line, parted where its own gap is; without a margin all is body."""
    entry = F.regexp_extract(line, MARGIN, 1)
    gap = F.length(F.regexp_extract(line, MARGIN, 0))
    bare = F.rtrim(line)
    beside = (entry != "") & (F.length(entry) <= margin)
    alone = (bare != "") & ~line.startswith(" ") & (F.length(bare) <= margin)
    left = F.when(margin.isNull(), "").when(beside, F.trim(entry)).when(alone, bare).otherwise("")
    right = F.when(margin.isNull(), line).when(beside, F.substr(line, gap + 1, F.length(line))).when(alone, "").otherwise(bare)
    return left, right


def join_marginal(pieces: Column) -> Column:
    """A heading that wraps down its column: a hyphen at an end joins, any other end takes a space."""
    return F.regexp_replace(F.regexp_replace(F.array_join(pieces, "\n"), "-\n", ""), "\n", " ")


def parse_sections(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, place, number, text, marginal, rejoined, sha256): the numbered sections of delivered texts.

    Furniture and repeated heads go; columns are parted; a section runs from its opening to the next
    one. Its heading stands in the margin from its opening line on, else alone on that line, else after
    its body, but never takes the only text of a section. Words broken at line ends are joined and
    listed. What stands before the first opening is left out.
    """
    rows = without_running_heads(lines(texts, doc, text).withColumn("line", strip_noise(F.col("line")))).select("doc", "n", "line")
    rows = rows.join(margin_columns(rows), "doc", "left")
    left, right = split_columns(F.col("line"), F.col("margin"))
    rows = rows.select("doc", "n", left.alias("entry"), right.alias("body")).withColumn("number", F.regexp_extract("body", OPENING, 1))
    order = Window.partitionBy("doc").orderBy("n")
    rows = rows.withColumn("place", F.count_if(F.col("number") != "").over(order)).where(F.col("place") > 0)
    inside = Window.partitionBy("doc", "place").orderBy("n")
    rows = rows.withColumn("heads", F.count_if(F.col("entry") == "").over(inside) == 0)
    body = F.when(F.col("number") != "", F.regexp_replace("body", OPENING, "")).otherwise(F.col("body"))
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))), lambda x: x["v"])
    sections = rows.groupBy("doc", "place").agg(
        F.max("number").alias("number"), in_order(body).alias("lines"), F.filter(in_order(F.when(F.col("heads"), F.col("entry"))), lambda x: x.isNotNull()).alias("entries")
    )
    filled = lambda some: F.exists(some, lambda x: F.trim(x) != "")
    leads = (F.size("lines") > 1) & filled(F.expr("slice(lines, 2, size(lines))")) & F.col("lines")[0].rlike(HEADING)
    sections = sections.withColumn("leading", F.when(leads, F.trim(F.regexp_extract(F.col("lines")[0], HEADING, 1))).otherwise("")).withColumn("lines", F.when(leads, F.expr("slice(lines, 2, size(lines))")).otherwise(F.col("lines")))
    # the last line that is no heading ends the body; where all are headings, the first one is the body
    said = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.trim(p["x"]) != "")
    core = F.coalesce(F.array_max(F.transform(F.filter(said, lambda p: ~p["x"].rlike(HEADING)), lambda p: p["i"])), F.array_min(F.transform(said, lambda p: p["i"])), F.lit(-1))
    sections = sections.withColumn("core", core).withColumn("after", F.filter(F.expr("slice(lines, core + 2, size(lines))"), lambda x: F.trim(x) != ""))
    sections = sections.withColumn("body", F.array_join(F.expr("slice(lines, 1, core + 1)"), "\n"))
    margin = F.regexp_replace(join_marginal(F.col("entries")), "[.,\\s]+$", "")
    trailing = F.when(F.size("after") > 0, F.trim(F.col("after")[0])).otherwise("")
    marginal = F.when(margin != "", margin).when(F.col("leading") != "", F.col("leading")).otherwise(trailing)
    tidied = T.tidy(T.dehyphenate(F.col("body")))
    return sections.select("doc", "place", "number", tidied.alias("text"), marginal.alias("marginal"), T.rejoined(F.col("body")).alias("rejoined"), F.sha2(T.text_skeleton(tidied), 256).alias("sha256"))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Section numbers of two texts joined on their normal form, never on their place: (doc, status, number, rank).

    ``left`` has (doc, place, number), ``right`` (doc, number). ``matched`` and ``left_only`` keep the left
    text's order and its repeated numbers; ``right_only`` numbers come once, in numeric order.
    """
    ours = left.select("doc", "place", T.section_number(F.col("number")).alias("number"))
    theirs = right.select("doc", T.section_number(F.col("number")).alias("number")).distinct()
    matched = ours.join(theirs.withColumn("there", F.lit(True)), ["doc", "number"], "left")
    status = F.when(F.col("there"), "matched").otherwise("left_only")
    kept = matched.select("doc", status.alias("status"), "number", F.struct(F.col("place").cast("long").alias("a"), F.lit("").alias("b")).alias("key"))
    first, rest = T.section_order(F.col("number"))
    extra = theirs.join(ours.select("doc", "number").distinct(), ["doc", "number"], "left_anti")
    extra = extra.select("doc", F.lit("right_only").alias("status"), "number", F.struct(first.cast("long").alias("a"), rest.alias("b")).alias("key"))
    ranked = kept.unionByName(extra).withColumn("rank", F.row_number().over(Window.partitionBy("doc", "status").orderBy("key")))
    return ranked.select("doc", "status", "number", "rank")


def amended_sections(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, number, note): sections that a consolidated text marks as amended; of a repeated number the last note."""
    found = F.regexp_extract_all(F.col(text), F.lit(SECTION_TEMPLATE), 0)
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(found).alias("n", "t"))
    rows = rows.select("doc", "n", F.trim(F.regexp_extract("t", SECTION_TEMPLATE, 1)).alias("number"), F.regexp_extract("t", SECTION_TEMPLATE, 3).alias("rest")).where(F.col("rest").contains(AMENDED))
    note = F.regexp_replace("rest", r"^[| ]+|[| ]+$", "")
    return rows.groupBy("doc", "number").agg(F.max_by(F.trim(note), "n").alias("note"))


def unamended(sections: DataFrame, amended: DataFrame) -> DataFrame:
    """Sections (doc, number) without an amendment: those that an older translation may stand beside."""
    return sections.join(amended.select("doc", "number"), ["doc", "number"], "left_anti")
