"""Tables written in Markdown: front matter, tables under headings, rule tables, pairings, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import hebrew

# Keys that a scheme's front matter may state
KEYS = (
    "name title default script doubles never_double article_doubles hyphenate_prefixes join_and_capitalize_prefixes always_mark_alef shva_na tsere_male hireq_male "
    "segol_male patah_male holam_male shuruq qamats_he suffix_3ms maqaf mark_final_he source_gaps source"
).split()


class TableError(ValueError):
    """A file that does not hold what it must."""


def scalar(text: str) -> str | bool | list[str]:
    """A value of front matter: quoted or plain text, true or false, or a flat list."""
    text = text.strip()
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("[") and text.endswith("]"):
        return [str(scalar(x)) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def front_matter(text: str, keys: list[str] = KEYS) -> tuple[dict, list[str]]:
    """(values, lines of the body). A key that is unknown or stated twice is an error, and so is an open block."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        raise TableError("no front matter")
    values: dict = {}
    for at, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return values, lines[at + 1 :]
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        key = key.strip()
        if not colon or key not in keys:
            raise TableError(f"unknown line {line.strip()!r}")
        if key in values:
            raise TableError(f"{key!r} is stated twice")
        values[key] = scalar(value)
    raise TableError("front matter without an end")


def table_after(lines: list[str], heading: str) -> list[list[str]]:
    """Rows of the first table under a heading, without its head; no heading or no table is an error."""
    inside, rows = False, []
    for line in lines:
        if line.startswith("## "):
            if rows:
                break
            inside = line[3:].strip() == heading
        elif inside and line.strip().startswith("|"):
            rows.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif inside and rows:
            break
    body = [r for r in rows[1:] if set("".join(r)) - set("-: ")]
    if not body:
        raise TableError(f"no table under {heading!r}")
    return body


def read_forms(rows: list[list[str]], form_at: int = 0, value_at: int = -1) -> dict[str, str]:
    """Form -> value; a form with two values is an error, an empty sign stands for nothing."""
    out: dict[str, str] = {}
    for row in rows:
        form, value = row[form_at].replace("◌", ""), "" if row[value_at] == "∅" else row[value_at]
        if out.setdefault(form, value) != value:
            raise TableError(f"{form!r} has the values {out[form]!r} and {value!r}")
    return out


def load_scheme(text: str) -> dict:
    """A scheme file: its rules, consonants (forms are told by their own characters), vowels and sequences."""
    rules, lines = front_matter(text)
    if "name" not in rules:
        raise TableError("a scheme needs a name")
    optional = lambda heading: read_forms(table_after(lines, heading)) if f"## {heading}" in [x.strip() for x in lines] else {}
    return {"rules": rules, "consonants": read_forms(table_after(lines, "Consonants")), "vowels": optional("Vowels"), "sequences": optional("Letter combinations")}


def rule_rows(texts: DataFrame, text: str = "value") -> DataFrame:
    """(cells): rows of all Markdown tables of a text, in order, without rulers."""
    lines = texts.select(F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).select("n", F.trim("line").alias("line"))
    rows = lines.where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^[|\-: ]+$"))
    return rows.select("n", F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def rule_table(texts: DataFrame, text: str = "value") -> DataFrame:
    """(skeleton, value): a rule table by the consonants of its first column, head left out."""
    rows = rule_rows(texts, text).where(hebrew.has_hebrew(F.col("cells")[0]))
    return rows.select(hebrew.skeleton(F.col("cells")[0]).alias("skeleton"), F.col("cells")[1].alias("value")).distinct()


def pairings(texts: DataFrame, text: str = "value") -> DataFrame:
    """(n, prefix, companion, why): works that are opened together."""
    rows = rule_rows(texts, text).where((F.size("cells") >= 3) & (F.lower(F.col("cells")[0]) != "when studying"))
    return rows.select("n", F.col("cells")[0].alias("prefix"), F.col("cells")[1].alias("companion"), F.col("cells")[2].alias("why"))


def companions(works: DataFrame, pairs: DataFrame) -> DataFrame:
    """Works (title) with the pairings whose prefix they begin with."""
    return works.join(F.broadcast(pairs), F.col("title").startswith(F.col("prefix"))).select(*[F.col(f"`{c}`") for c in works.columns], "companion", "why")


def companion_refs(links: DataFrame, paired: DataFrame) -> DataFrame:
    """(key, companion, refs): links of a work to its companion, each ref once, in order."""
    met = links.join(paired.select("key", "companion"), "key").where(F.col("index_title").startswith(F.col("companion")) & (F.coalesce("ref", F.lit("")) != ""))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]))
    return met.groupBy("key", "companion").agg(listed.alias("refs"))


def manifest(texts: DataFrame, text: str = "value") -> DataFrame:
    """(name, sha256): files and digests that a manifest states."""
    rows = rule_rows(texts, text).select(F.col("cells")[0].alias("name"), F.element_at("cells", -1).alias("sha256"))
    return rows.where(F.col("sha256").rlike("^[0-9a-f]{64}$"))


def verified(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status): whether each file (name, content) is there and has its digest."""
    held = files.select("name", F.sha2("content", 256).alias("digest"))
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("sha256"), "ok").otherwise("changed")
    return manifest_rows.join(held, "name", "left").select("name", status.alias("status"))


def authority_rank(tier: Column, ladder: list[str]) -> Column:
    """Place of a tier in a ladder from 0; unknown ones come after all."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ladder)), tier), F.lit(0)) - 1, F.lit(len(ladder)))


def sources_for(statutes: DataFrame, sources: DataFrame, ladder: list[str], series: str) -> DataFrame:
    """Translation sources (key, authority) worth trying for each statute (slug, citation), best first; a statute without a citation has none in the series."""
    rows = statutes.crossJoin(F.broadcast(sources)).where((F.col("key") != series) | (F.coalesce("citation", F.lit("")) != ""))
    return rows.select("slug", "key", "authority", authority_rank(F.col("authority"), ladder).cast("int").alias("rank")).orderBy("slug", "rank", "key")
