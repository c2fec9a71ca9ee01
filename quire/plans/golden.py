"""Queries over authored rows: what must come out is spelled out as VALUES, by hand.

Such an oracle restates an expected answer and does not compute it anew; operators that the tables can
exercise have a query in ``catalog`` as well.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.functions import hebrew, latin, register, romanizer
from quire.functions.arrays import first_occurrences
from quire.operators import drafts, editions, graph, render, romanized, statutes
from quire.plans.registry import Registry, table
from quire.sources import requests, services, tables
from quire.streaming import limits

REGISTRY = Registry()


def values(rows: list[tuple], columns: str) -> str:
    """An oracle of rows; columns are given as "name TYPE, ..."."""
    cell = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    listed = ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)
    quoted = [f'"{n}"' for n in names]
    casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(quoted, kinds, strict=True))
    return f"SELECT {casts} FROM (VALUES {listed}) AS g({', '.join(quoted)})"


ROMANIZED = [
    ("sbl-general", "הַמֶּלֶךְ", "ha-melekh", ""), ("bgn-pcgn", "הַמֶּלֶךְ", "haMmelekh", ""), ("sbl-academic", "תּוֹרָה", "tôrâ", "established-form"), ("ala-lc", "תּוֹרָה", "torah", "established-form"),
    ("encyclopaedia-judaica-general", "תּוֹרָה", "torah", "established-form"), ("encyclopaedia-judaica-scientific", "שָׁלוֹם", "šålom", ""), ("sbl-general", "כָּל־הָאָרֶץ", "kol-ha-’arets", ""),
    ("sbl-general", "The word שָׁלוֹם means peace.", "The word shalom means peace.", ""), ("sbl-general", "שָׁרְצוּ", "sharetsu", "qamats-may-be-short,sheva-after-qamats"), ("sbl-general", "וַיְדַבֵּר", "vaydabber", ""),
    ("sbl-general", "", "", ""), ("sbl-general", "חָכְמָה", "ḥokhmah", ""), ("sbl-general", "רוּחַ", "ruaḥ", ""), ("sbl-general", "יָדָיו", "yadayw", ""), ("ala-lc", "טוֹב", "ṭov", ""),
    ("yivo", "אַ גוטן טאָג", "a gutn tog", ""), ("yivo", "ייִדיש", "yidish", ""), ("yivo", "בֿרוך", "vrukh", ""), ("yivo", "שבת", "shbs", "established-form,unpointed"), ("ala-lc-yiddish", "אין", "in", ""),
    ("yivo", "חָכְמָה", "khkhmh", "script-mismatch,unpointed"), ("sbl-general", "שלום", "shlvm", "unpointed,shin-undotted"), ("sbl-general", "יְהוָה", "HaShem", ""),
    ("encyclopaedia-judaica-general", "חֳלִי", "ḥli", "source-gap"), ("encyclopaedia-judaica-general", "כָּל", "kal", "distinction-not-in-scheme"),
]


@REGISTRY.add("romanize_schemes", values([(i, s, latin_, flags) for i, (s, _, latin_, flags) in enumerate(ROMANIZED)], "id INTEGER, scheme VARCHAR, latin VARCHAR, flags VARCHAR"))
def romanize_schemes(spark, sf_dir):
    """Authored words under all eight schemes, with the flags raised."""
    out = None
    for scheme in sorted({row[0] for row in ROMANIZED}):
        rows = spark.createDataFrame([(i, t) for i, (s, t, *_) in enumerate(ROMANIZED) if s == scheme], "id int, t string").withColumn("r", romanizer.romanize(F.col("t"), scheme))
        rows = rows.select("id", F.lit(scheme).alias("scheme"), F.col("r.text").alias("latin"), F.array_join("r.flags", ",").alias("flags"))
        out = rows if out is None else out.unionByName(rows)
    return out


POINTED = [("בְּרֵאשִׁית", "bereshit"), ("בָּרָא", "bara"), ("מֶלֶךְ", "melekh"), ("נֶפֶשׁ", "nefesh"), ("חָכְמָה", "ḥokhmah"), ("רוּחַ", "ruaḥ"), ("שְׁמַע", "shema‘"), ("וַיְדַבֵּר", "vaydabber")]


@REGISTRY.add(
    "romanize_documents",
    "WITH w(k, v) AS (VALUES "
    + ", ".join(f"({i}, '{v}')" for i, (_, v) in enumerate(POINTED))
    + r"""), t AS (SELECT doc_id, unnest(generate_series(1, length(text) - length(replace(text, ' ', '')) + 1)) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, string_agg(v, ' ' ORDER BY n) AS latin FROM t JOIN w ON (doc_id + n) % 8 = k GROUP BY doc_id""",
)
def romanize_documents(spark, sf_dir):
    """Pointed texts as long as the documents: each word of a document (between single spaces) stands for one of eight Hebrew words."""
    count = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    words = F.array(*[F.lit(w) for w, _ in POINTED])
    said = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda n: F.get(words, F.pmod(F.col("doc_id") + n, F.lit(len(POINTED))).cast("int"))), " ")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", said.alias("t"))
    return romanized.romanize_texts(docs, "doc_id", "t").select("doc_id", F.col("text").alias("latin"))


CHARACTERS = [("א", True, False, False, False, False), ("ם", True, True, False, False, False), ("ָ", False, False, True, True, False), ("֖", False, False, True, False, True), ("ּ", False, False, True, False, False), ("a", False, False, False, False, False)]


@REGISTRY.add("character_predicates", values(CHARACTERS, "c VARCHAR, letter BOOLEAN, final BOOLEAN, point BOOLEAN, vowel BOOLEAN, accent BOOLEAN"))
def character_predicates(spark, sf_dir):
    c = F.col("c")
    rows = spark.createDataFrame([(x[0],) for x in CHARACTERS], "c string")
    return rows.select("c", hebrew.is_letter(c).alias("letter"), hebrew.is_final(c).alias("final"), hebrew.is_point(c).alias("point"), hebrew.is_vowel(c).alias("vowel"), hebrew.is_accent(c).alias("accent"))


WORDS = [("שָׁלוֹם", True, 2, False, "שָׁלוֹם"), ("abc", False, 0, False, "abc"), ("שׁוּב", True, 1, False, "שׁוּב"), ("הָֽאָרֶץ", True, 3, True, "הָֽאָרֶץ"), ("שׁוֹ", True, 1, False, "שׁוֹ"), ("־", False, 0, False, "־")]


@REGISTRY.add("word_shapes", values(WORDS, "w VARCHAR, hebrew BOOLEAN, syllables INTEGER, meteg BOOLEAN, normal VARCHAR"))
def word_shapes(spark, sf_dir):
    """Whole words, syllables, meteg, and presentation forms as letters and points."""
    w = F.col("w")
    rows = spark.createDataFrame([(x[0],) for x in WORDS], "w string")
    n = hebrew.normalized(w)
    return rows.select("w", hebrew.is_hebrew_word(n).alias("hebrew"), hebrew.syllables(n).alias("syllables"), hebrew.has_meteg(w).alias("meteg"), n.alias("normal"))


REVERSED = [
    ("shalom", "sbl-general", "שׁלם", ""), ("torah", "sbl-general", "טרה", "'t' could be ט or ת"), ("bar", "sbl-academic", "בר", ""),
    ("dzhaz", "yivo", "דזשאַז", ""), ("x", "ala-lc", "", "'x' matches nothing in ala-lc"),
]


@REGISTRY.add("reverse_candidates", values([(i, s, letters, notes) for i, (_, s, letters, notes) in enumerate(REVERSED)], "id INTEGER, scheme VARCHAR, letters VARCHAR, ambiguities VARCHAR"))
def reverse_candidates(spark, sf_dir):
    """Hebrew spellings of romanized words, with what the scheme leaves open."""
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, *_) in enumerate(REVERSED)], "id int, t string, want string")
    found = latin.reverse_candidates(rows, "t").where("scheme = want")
    return found.select("id", "scheme", "letters", F.array_join("ambiguities", "; ").alias("ambiguities"))


def _detect_sql() -> str:
    """Scores by counting replaced characters, schemes without a letter of the text below all others."""
    rare, can = latin.rarity(), latin.producible()
    parts = []
    for name, some in latin.signatures().items():
        score = " + ".join(f"((length(t) - length(replace(t, '{v.lower()}', ''))) // {len(v)}) / {rare[v]}" for v in some)
        letters = "".join(c for c in can[name] if c.isalpha())
        parts.append(f"SELECT doc_id, '{name}' AS scheme, round({score}, 3) AS score, regexp_replace(t, '[^\\p{{L}}]|[{letters}]', '', 'g') <> '' AS no FROM d")
    union = " UNION ALL ".join(parts)
    return f"""
    WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS ({union}),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, score DESC, scheme) AS rank FROM s WHERE score > 0)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, scheme, score FROM r WHERE rank <= 3
    """


@REGISTRY.add("detect_scheme", _detect_sql())
def detect_scheme(spark, sf_dir):
    """The three likeliest schemes of every document."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", F.posexplode(latin.detect(F.col("text"))).alias("at", "g"))
    return rows.select("doc_id", (F.col("at") + 1).alias("rank"), "g.scheme", "g.score")


ROUND_TRIP = "בְּרֵאשִׁית בָּרָא אֱלֹהִים צֶדֶק וְחָכְמָה טוֹב"


@REGISTRY.add("detect_round_trip", values([(s, s) for s in ("sbl-academic", "ala-lc", "bgn-pcgn", "encyclopaedia-judaica-scientific")], "scheme VARCHAR, detected VARCHAR"))
def detect_round_trip(spark, sf_dir):
    """A phrase romanized under schemes with signs of their own is recognised."""
    out = None
    for scheme in ("sbl-academic", "ala-lc", "bgn-pcgn", "encyclopaedia-judaica-scientific"):
        rows = spark.createDataFrame([(ROUND_TRIP,)], "t string").select(F.lit(scheme).alias("scheme"), romanizer.romanize(F.col("t"), scheme)["text"].alias("latin"))
        rows = rows.select("scheme", latin.detect(F.col("latin"))[0]["scheme"].alias("detected"))
        out = rows if out is None else out.unionByName(rows)
    return out


@REGISTRY.add("register_evidence", values([(1, "ashkenazi", "Shabbos, halach, Sukkos"), (2, "sephardi", "Shabbat, ḥokhm, ḥ"), (3, "undetermined", "")], "id INTEGER, register VARCHAR, evidence VARCHAR"))
def register_evidence(spark, sf_dir):
    t = F.col("t")
    a, s = register.scores(t)
    rows = spark.createDataFrame([(1, "On Shabbos the halacha of Sukkos"), (2, "Shabbat ḥokhma ḥ"), (3, None)], "id int, t string")
    return rows.select("id", register.register(a, s).alias("register"), F.array_join(register.evidence(t), ", ").alias("evidence"))


# ---- editions and drafts

EDITIONS = [
    ("Gen 1", 1, "A", "he", None, "https://www.one.org/x", "בְּרֵאשִׁית בָּרָא אֱלֹהִים אֵת הַשָּׁמַיִם"), ("Gen 1", 2, "B", "he", None, "https://one.org/y", "בראשית ברא אלקים את השמים"),
    ("Gen 1", 3, "C", "en", "hebrew", "print", "בראשית ברא א׳ את השמים ואת הארץ"), ("Gen 1", 4, "D", "en", None, "", "In the beginning"), ("Gen 2", 1, "A", "he", None, None, "ויכלו"),
]
EDITION_SCHEMA = "ref string, place int, title string, language string, actual_language string, source string, text string"


@REGISTRY.add(
    "compare_editions",
    values(
        [("Gen 1", "A", "B", 2, "substantive", "אֱלֹהִים", "אלקים"), ("Gen 1", "A", "C", 2, "abbreviation", "אֱלֹהִים", "א׳"), ("Gen 1", "A", "C", 5, "interpolation", "", "ואת הארץ")],
        "ref VARCHAR, left_edition VARCHAR, right_edition VARCHAR, position INTEGER, kind VARCHAR, left VARCHAR, right VARCHAR",
    ),
)
def compare_editions(spark, sf_dir):
    """Every Hebrew edition against the first, points aside."""
    return editions.compare_editions(spark.createDataFrame(EDITIONS, EDITION_SCHEMA))


@REGISTRY.add("edition_witnesses", values([("Gen 1", 4, "one.org, print, (none stated)", 3), ("Gen 2", 1, "(none stated)", 1)], "ref VARCHAR, editions BIGINT, providers VARCHAR, independent INTEGER"))
def edition_witnesses(spark, sf_dir):
    return editions.witnesses(spark.createDataFrame(EDITIONS, EDITION_SCHEMA)).withColumn("providers", F.array_join("providers", ", "))


@REGISTRY.add("edition_apparatus", values([("Gen 1", "A", "one.org", "pointed"), ("Gen 1", "B", "one.org", "bare"), ("Gen 1", "C", "print", "bare"), ("Gen 2", "A", "(none stated)", "bare")], "ref VARCHAR, title VARCHAR, provider VARCHAR, vocalization VARCHAR"))
def edition_apparatus(spark, sf_dir):
    return editions.apparatus(spark.createDataFrame(EDITIONS, EDITION_SCHEMA)).drop("place")


@REGISTRY.add("difference_tallies", values([("Gen 1", "abbreviation", 1), ("Gen 1", "interpolation", 1), ("Gen 1", "substantive", 1)], "ref VARCHAR, kind VARCHAR, n BIGINT"))
def difference_tallies(spark, sf_dir):
    return editions.tallies(editions.compare_editions(spark.createDataFrame(EDITIONS, EDITION_SCHEMA)))


@REGISTRY.add(
    "chosen_editions",
    """
    WITH e AS (SELECT p_brand AS ref, p_name AS title, p_size > 25 AS is_source, p_partkey % 2 = 0 AS is_primary, p_size AS priority, p_partkey FROM part),
         r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY is_source DESC, is_primary DESC, priority DESC, title, p_partkey) AS place, count(*) OVER (PARTITION BY ref) AS n FROM e)
    SELECT ref, CAST(place AS INTEGER) AS place, priority, greatest(n - 12, 0) AS left_out FROM r WHERE place <= 12
    """,
)
def chosen_editions(spark, sf_dir):
    """Editions of each work by source, primary, priority and title; twelve at most."""
    part = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    rows = part.select(F.col("p_brand").alias("ref"), title.alias("title"), F.lit("en").alias("language"), (F.col("p_size") > 25).alias("is_source"), (F.col("p_partkey") % 2 == 0).alias("is_primary"), F.col("p_size").alias("priority"))
    return editions.chosen_editions(rows).select("ref", "place", "priority", "left_out")


@REGISTRY.add(
    "segments_flatten",
    """
    SELECT CAST(conv_id AS VARCHAR) AS ref, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) || ':1' AS anchor, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text
    FROM conversations WHERE text IS NOT NULL QUALIFY trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND NOT contains(text, '<') AND NOT contains(text, '&')
    """,
)
def segments_flatten(spark, sf_dir):
    """Turns of a conversation as a nested text of two levels, flattened to anchors."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.array(x["text"])).alias("t"))
    flat = editions.flatten_segments(rows.withColumn("ref", F.col("conv_id").cast("string")), "ref", "t", 2)
    marked = rows.select(F.col("conv_id").cast("string").alias("ref"), F.posexplode("t").alias("i", "raw")).where(~F.col("raw")[0].contains("<") & ~F.col("raw")[0].contains("&"))
    return flat.join(marked.select("ref", F.concat((F.col("i") + 1).cast("string"), F.lit(":1")).alias("anchor")), ["ref", "anchor"]).select("ref", "anchor", "text")


@REGISTRY.add("jagged_text", values([("a", "1:1", "one"), ("a", "1:3", "three x"), ("a", "2:1", "four")], "ref VARCHAR, anchor VARCHAR, text VARCHAR"))
def jagged_text(spark, sf_dir):
    rows = spark.createDataFrame([("a", [["one", " ", "th<b>ree</b>&nbsp;x"], ["four", None], []])], "ref string, t array<array<string>>")
    return editions.flatten_segments(rows, "ref", "t", 2).select("ref", "anchor", "text")


@REGISTRY.add(
    "translated_segments",
    "SELECT l.o_orderkey AS ref, l.l_linenumber AS anchor, (SELECT max(n.n_name) FROM nation n WHERE n.n_nationkey = l.l_linenumber * 3) AS translation FROM (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 500) l",
)
def translated_segments(spark, sf_dir):
    """Segments with the translation of the same anchor, null where there is none."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 500").select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("anchor"))
    names = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select((F.col("n_nationkey") / 3).cast("long").alias("anchor"), F.col("n_name").alias("text"), F.lit(0).alias("position"))
    both = rows.select("ref", "anchor").join(names, "anchor").select("ref", F.col("anchor").cast("int").alias("anchor"), "text", "position").distinct()
    return editions.translated(rows, both).select("ref", "anchor", "translation")


@REGISTRY.add(
    "diagnose_best",
    values([(1, "בראשית ברא", "אלקים", "אֱלֹהִים"), (2, "", "עשו", "")], "id INTEGER, matched VARCHAR, draft_word VARCHAR, edition_word VARCHAR"),
)
def diagnose_best(spark, sf_dir):
    """The longest beginning of a quotation that a passage has, and where they part."""
    rows = spark.createDataFrame([(1, "ברא בראשית בָּרָא אֱלֹהִים בראשית לא", "בראשית ברא אלקים"), (2, "בראשית", "עשו בן")], "id int, source string, said string")
    return rows.select("id", drafts.diagnose(F.col("source"), F.col("said")).alias("d")).select("id", "d.*")


DRAFT = "As Gen 1 says: בראשית ברא אלהים את\n\nBut Gen 1 and Gen 2 have ויכלו השמים והארץ here, not\nבראשית ברא שטן ועוד\n\nאין כאן מקור כלל\n\nTwo words only: שני מילים"
CITED = [(1, 0, "Gen 1", ["Gen 1"]), (1, 1, "Gen 2", ["Gen 2"]), (1, 2, "Gen 9", []), (1, 3, "", ["x"])]
PASSAGES = [("Gen 1", "בְּרֵאשִׁית בָּרָא אֱלֹהִים אֵת הַשָּׁמַיִם"), ("Gen 2", "וַיְכֻלּוּ הַשָּׁמַיִם וְהָאָרֶץ וְכָל־צְבָאָם")]


def _draft_tables(spark):
    return spark.createDataFrame([(1, DRAFT)], "draft int, text string"), spark.createDataFrame(CITED, "draft int, place int, matched string, refs array<string>"), spark.createDataFrame(PASSAGES, "ref string, text string")


@REGISTRY.add(
    "verify_draft",
    values(
        [(0, 0, "בראשית ברא אלהים את", "found", "Gen 1", "Gen 1", None, None), (1, 0, "ויכלו השמים והארץ", "found", "Gen 2", "Gen 1, Gen 2", None, None), (1, 1, "בראשית ברא שטן ועוד", "not found", None, "Gen 1, Gen 2", "בראשית ברא", "שטן"), (2, 0, "אין כאן מקור כלל", "unchecked", None, "", None, None)],
        "paragraph INTEGER, run INTEGER, quotation VARCHAR, status VARCHAR, found_in VARCHAR, checked_against VARCHAR, matched VARCHAR, draft_word VARCHAR",
    ),
)
def verify_draft(spark, sf_dir):
    """Every Hebrew run of a draft against the passages cited in its paragraph."""
    out = drafts.verify(*_draft_tables(spark))
    return out.select("paragraph", "run", "quotation", "status", "found_in", F.array_join("checked_against", ", ").alias("checked_against"), "divergence.matched", "divergence.draft_word")


@REGISTRY.add("draft_reports", values([(1, False)], "draft INTEGER, ok BOOLEAN"))
def draft_reports(spark, sf_dir):
    texts, cited, passages = _draft_tables(spark)
    return drafts.clean_reports(drafts.verify(texts, cited, passages), cited)


@REGISTRY.add(
    "paragraph_citations",
    r"""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM documents WHERE doc_id < 400),
         c AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(['the', 'und', 'les']) AS word FROM documents WHERE doc_id < 400))
    SELECT p.doc_id AS draft, count(*) AS met FROM p JOIN c ON p.doc_id = c.doc_id AND contains(p.raw, c.word) WHERE trim(p.raw, E' \t\n\r') <> '' GROUP BY 1
    """,
)
def paragraph_citations(spark, sf_dir):
    """Citations meet the paragraphs that hold their matched text."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 400").select(F.col("doc_id").alias("draft"), F.regexp_replace("text", "\n(?!\n)(?<!\n\n)", "\n").alias("text"))
    words = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(w).alias("matched"), F.array(F.lit(w)).alias("refs")) for i, w in enumerate(["the", "und", "les"])])
    cited = docs.select("draft", F.explode(words).alias("c")).select("draft", "c.*")
    near = drafts.cited_nearby(docs, cited)
    return near.groupBy("draft").agg(F.sum(F.size("refs")).alias("met")).where("met > 0")


# ---- statutes

STATUTE = (
    "pd4ml evaluation copy\nChapter One: General\nISRAEL GAZETTE VOLUME ONE\n1. (a) In this law the regu-\nlation holds.\nDefinitions\n\n§ 2. Time of delivery\nGoods are due\nat once.\n"
    "\fISRAEL GAZETTE VOLUME ONE\n12A. Conditions on enforcement\n\n\n3. First line:\n\nsecond para-\ngraph Non-\nArab law.\n"
)
COLUMNS = (
    "Remedies of      2. Where a contract has been broken, the injured\ninjured          party is entitled to claim its enforcement or to\nparty.           rescind the contract.\n                 (b) The second subsection is here.\n"
    "Enforce-         3. The injured party, if any, is entitled to enforce-\nment             ment of the contract, unless\n                 one of these holds.\n"
)
SECTIONS = [
    ("a", 1, "1", "(a) In this law the regulation holds.", "Definitions", "regulation"), ("a", 2, "2", "Goods are due at once.", "Time of delivery", ""), ("a", 3, "12A", "Conditions on enforcement", "", ""),
    ("a", 4, "3", "First line:\n\nsecond paragraph Non- Arab law.", "", "paragraph"),
    ("b", 1, "2", "Where a contract has been broken, the injured party is entitled to claim its enforcement or to rescind the contract. (b) The second subsection is here.", "Remedies of injured party", ""),
    ("b", 2, "3", "The injured party, if any, is entitled to enforcement of the contract, unless one of these holds.", "Enforcement", "enforcement"),
]


@REGISTRY.add("section_parse", values(SECTIONS, "doc VARCHAR, place BIGINT, number VARCHAR, text VARCHAR, marginal VARCHAR, rejoined VARCHAR"))
def section_parse(spark, sf_dir):
    """Delivered statutes as sections: furniture and heads gone, columns parted, headings from the margin, the opening line or after the body."""
    out = statutes.parse_sections(spark.createDataFrame([("a", STATUTE), ("b", COLUMNS)], "doc string, text string"))
    return out.select("doc", "place", "number", "text", "marginal", F.array_join("rejoined", ",").alias("rejoined"))


@REGISTRY.add("margin_columns", values([("a", None), ("b", 11)], "doc VARCHAR, margin INTEGER"))
def margin_columns(spark, sf_dir):
    return statutes.margin_columns(statutes.lines(spark.createDataFrame([("a", STATUTE), ("b", COLUMNS)], "doc string, text string"), "doc", "text"))


@REGISTRY.add("amended_sections", values([("x", "11", "תיקון: תשפ״ד"), ("x", "3", "תיקון: תש״ם")], "doc VARCHAR, number VARCHAR, note VARCHAR"))
def amended_sections(spark, sf_dir):
    wiki = "{{ח:סעיף|1|שם}} {{ח:סעיף| 11 |פיצויים|תיקון: תשפ״ד}} {{ח:סעיף|3|א|תיקון: תשל״ג}} {{ח:סעיף|3|א||תיקון: תש״ם}}"
    return statutes.amended_sections(spark.createDataFrame([("x", wiki)], "doc string, text string"))


# ---- services and tables

def _payload(spark, *rows):
    return spark.createDataFrame([(k, json.dumps(p, ensure_ascii=False)) for k, p in rows], "key string, payload string")


@REGISTRY.add(
    "anchor_payloads",
    values([("w", "Work", 3, "1:1", 2), ("w", "Work", 3, "1:3", 5), ("w", "Work", 3, "3", 7), ("v", "(untitled)", 0, None, None)], "key VARCHAR, title VARCHAR, chapters INTEGER, anchor VARCHAR, segments INTEGER"),
)
def anchor_payloads(spark, sf_dir):
    """Where works hold text, from sparse and gridded counts."""
    rows = _payload(spark, ("w", {"title": "Work", "chapters": [[2, 0, 5], 0, 7]}), ("v", {"chapters": None}))
    return services.census(rows).select("key", "title", "chapters", F.explode_outer("anchors").alias("a")).select("key", "title", "chapters", "a.*")


LINKS = [
    {"ref": "R 1", "category": "Commentary", "index_title": "Rashi", "collectiveTitle": {"en": "Rashi on Torah"}}, {"ref": "M 1", "category": "Midrash", "index_title": "Rabbah"},
    {"ref": "R 1", "category": "Commentary", "index_title": "Rashi", "collectiveTitle": {"en": "Rashi on Torah"}}, {"ref": "R 2", "category": "Commentary", "index_title": "Rashi", "collectiveTitle": {"en": "Rashi on Torah"}},
    {"ref": "", "category": "Midrash"}, {"ref": "Z", "category": ""}, {"ref": "G 1:2", "category": "Guides", "index_title": "Guide for All"},
]


@REGISTRY.add(
    "chain_links",
    values([("Midrash", "Rabbah", 1, "M 1"), ("Commentary", "Rashi on Torah", 2, "R 1,R 2"), ("(uncategorized)", "Z", 3, "Z"), ("Guides", "Guide for All", 3, "G 1:2")], "category VARCHAR, work VARCHAR, rank BIGINT, refs VARCHAR"),
)
def chain_links(spark, sf_dir):
    out = graph.chain(services.links(_payload(spark, ("g", LINKS))), ["Midrash", "Commentary"])
    return out.select("category", "work", F.col("rank").cast("long").alias("rank"), F.array_join("refs", ",").alias("refs"))


@REGISTRY.add("links_related", values([("Commentary", 3), ("Midrash", 2), ("", 1), ("Guides", 1)], "category VARCHAR, n BIGINT"))
def links_related(spark, sf_dir):
    return services.related_counts(_payload(spark, ("g", LINKS))).select("category", "n")


@REGISTRY.add("links_report", values([("", "Z", 1), ("Commentary", "Rashi on Torah", 3), ("Guides", "Guide for All", 1), ("Midrash", "(unnamed)", 1), ("Midrash", "Rabbah", 1)], "category VARCHAR, work VARCHAR, n BIGINT"))
def links_report(spark, sf_dir):
    return services.links_report(_payload(spark, ("g", LINKS))).select("category", "work", "n")


PAIRS = "Text\n\n| When studying | Also open | Why |\n|---|---|---|\n| Code | Guide | one author |\n| Code, Deeds | Survey | sources |\n"


@REGISTRY.add("companion_links", values([("g", "Guide", "G 1:2")], "key VARCHAR, companion VARCHAR, refs VARCHAR"))
def companion_links(spark, sf_dir):
    """Links of a work to the works that are opened with it."""
    pairs = tables.pairings(spark.createDataFrame([(PAIRS,)], "value string"))
    works = spark.createDataFrame([("g", "Code, Deeds"), ("h", "Other")], "key string, title string")
    found = tables.companion_refs(services.links(_payload(spark, ("g", LINKS))), tables.companions(works, pairs))
    return found.withColumn("refs", F.array_join("refs", ","))


@REGISTRY.add("suggested_names", values([("gen", "Genesis,Genesis Rabbah,gene")], "key VARCHAR, suggestions VARCHAR"))
def suggested_names(spark, sf_dir):
    answer = {"completion_objects": [{"type": "topic", "key": "t"}, {"type": "REF", "key": "Genesis"}, {"type": "ref", "key": "", "title": "Genesis Rabbah"}], "completions": ["Genesis", "gene"]}
    return services.suggestions(_payload(spark, ("gen", answer))).select("key", F.array_join("suggestions", ",").alias("suggestions"))


@REGISTRY.add("resolved_citations", values([("Gen 1", "Genesis 1", True), ("nonsense", None, False), ("unknown", None, False)], "key VARCHAR, ref VARCHAR, resolved BOOLEAN"))
def resolved_citations(spark, sf_dir):
    asked = spark.createDataFrame([("Gen 1",), ("nonsense",), ("unknown",)], "key string")
    return services.resolved(asked, _payload(spark, ("Gen 1", {"is_ref": True, "normalized": "Genesis 1"}), ("nonsense", {"is_ref": False})))


@REGISTRY.add("recordings", values([("g", "Gen 1", "u1", "unknown", "", 1.5, "unknown"), ("g", "g", "u2", "S", "CC0", None, "S, CC0")], "key VARCHAR, ref VARCHAR, url VARCHAR, source VARCHAR, license VARCHAR, duration DOUBLE, attribution VARCHAR"))
def recordings(spark, sf_dir):
    media = [{"media_url": "u1", "anchorRef": "Gen 1", "start_time": "2", "end_time": 3.5}, {"url": "u2", "source": "S", "license": "CC0", "start_time": "x", "end_time": "4"}, {"source": "none"}]
    return services.recordings(_payload(spark, ("g", media)))


@REGISTRY.add("passage_boundaries", values([("Shab 2a:1", "Shab 2a:1-5"), ("Shab 2b:1", None), ("Shab 3a", None)], "key VARCHAR, passage VARCHAR"))
def passage_boundaries(spark, sf_dir):
    return services.boundary(_payload(spark, ("Shab 2a:1", {"Shab 2a:1": "Shab 2a:1-5"}), ("Shab 2b:1", {"Shab 2b:1": "Shab 2b:1"}), ("Shab 3a", {"other": "x"})))


@REGISTRY.add("topics_named", values([("jus", 1, "justice", "Justice"), ("jus", 2, "jus", "jus")], "key VARCHAR, rank INTEGER, slug VARCHAR, title VARCHAR"))
def topics_named(spark, sf_dir):
    objects = [{"type": "ref", "key": "r"}, {"type": "Topic", "key": "justice", "title": "Justice"}, {"type": "topic", "key": "jus"}, {"type": "topic", "key": "late"}]
    return services.topics_named(_payload(spark, ("jus", {"completion_objects": objects})), 2).select("key", "rank", "slug", "title")


@REGISTRY.add("topic_passages", values([("a", "R1,R2"), ("b", "S1"), ("c", "")], "key VARCHAR, refs VARCHAR"))
def topic_passages(spark, sf_dir):
    newer = {"refs": {"about": {"refs": [{"ref": "R1"}, {"ref": "R1"}, {"ref": ""}, {"ref": "R2"}, {"ref": "R3"}]}}, "sources": [{"ref": "S"}]}
    rows = _payload(spark, ("a", newer), ("b", {"sources": [{"ref": "S1"}]}), ("c", {}))
    return services.topic_sources(rows, 2).select("key", F.array_join("refs", ",").alias("refs"))


@REGISTRY.add("lexicon_entries", values([("melekh", 0, "melekh", "BDB", "king|ruler"), ("melekh", 1, "mlk", "", "to rule")], "key VARCHAR, place INTEGER, headword VARCHAR, lexicon VARCHAR, senses VARCHAR"))
def lexicon_entries(spark, sf_dir):
    entries = [{"parent_lexicon": "BDB", "content": {"senses": [{"definition": "<i>king</i>"}, {"definition": " "}, {"definition": "ruler"}], "definition": "unused"}}, {"headword": "mlk", "content": {"definition": "to rule"}}]
    return services.lexicon(_payload(spark, ("melekh", entries))).withColumn("senses", F.array_join("senses", "|"))


DAY = {"items": [{"title": "Berakhot 2", "category": "dafyomi"}, {"title": "Parashat Noach", "category": "parashat", "hebrew": "נח"}, {"title": "Rosh Chodesh", "category": "roshchodesh", "date": "2024-01-11"}]}


@REGISTRY.add("day_items", values([("d", 0, "study", "Berakhot 2"), ("d", 1, "reading", "Noach"), ("d", 2, "event", "Rosh Chodesh")], "key VARCHAR, place INTEGER, kind VARCHAR, title VARCHAR"))
def day_items(spark, sf_dir):
    return services.day_items(_payload(spark, ("d", DAY))).select("key", "place", "kind", "title")


@REGISTRY.add("leyning_parts", values([("x", "Noach", "fullkriyah", "1", "Genesis 6:9-6:22"), ("x", "Noach", "fullkriyah", "2", "Genesis 7:1-7:16"), ("x", "Noach", "triennial", "1", "Genesis 6:9-6:16")], "key VARCHAR, name VARCHAR, kind VARCHAR, number VARCHAR, ref VARCHAR"))
def leyning_parts(spark, sf_dir):
    part = lambda b, e: {"k": "Genesis", "b": b, "e": e}
    item = {"parsha": "Noach", "fullkriyah": {"2": part("7:1", "7:16"), "1": part("6:9", "6:22")}, "triennial": {"1": part("6:9", "6:16")}}
    return services.leyning(_payload(spark, ("x", {"items": [item]}), ("y", {"items": []}))).select("key", "name", "kind", "number", "ref")


@REGISTRY.add("laws_found", values([(2, "חוק החוזים", "1973-01-01"), (5, "חוק החוזים (תרופות)", "1970-12-31")], "law_id BIGINT, name VARCHAR, published VARCHAR"))
def laws_found(spark, sf_dir):
    rows = [{"IsraelLawID": 5, "Name": "חוק החוזים (תרופות)", "PublicationDate": "1970-12-31T00:00:00"}, {"IsraelLawID": 2, "Name": "חוק החוזים", "PublicationDate": "1973-01-01T00:00:00"}, {"IsraelLawID": 9, "Name": "other"}]
    return services.laws(_payload(spark, ("q", {"value": rows})), "החוזים")


@REGISTRY.add("kept_answers", values([("a", True), ("b", False), ("c", False), ("d", False)], "key VARCHAR, hit BOOLEAN"))
def kept_answers(spark, sf_dir):
    """Kept answers are a hit while they live, are whole, and report no failure."""
    rows = [("a", "2024-01-01 00:00:00", '{"x": 1}'), ("b", "2023-12-30 00:00:00", "{}"), ("c", "2024-01-01 00:00:00", '{"error": "down"}'), ("d", "2024-01-01 00:00:00", '{"x":')]
    kept = spark.createDataFrame(rows, "key string, at string, payload string").withColumn("written", F.col("at").cast("timestamp"))
    hits = requests.usable(kept, F.lit("2024-01-01 12:00:00")).select("key", F.lit(True).alias("hit"))
    return kept.select("key").join(hits, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


@REGISTRY.add("cache_keys", "SELECT url, left(sha256(url), 32) AS get_key, left(sha256(url || '::' || html), 32) AS post_key FROM pages")
def cache_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return pages.select("url", requests.cache_key(F.col("url")).alias("get_key"), requests.cache_key(F.col("url"), F.col("html")).alias("post_key"))


@REGISTRY.add("service_limits", values([("library", 20, 1), ("calendar", 80, 10), ("statutes", 10, 1), ("register", 5, 1)], "service VARCHAR, requests INTEGER, seconds INTEGER"))
def service_limits(spark, sf_dir):
    return requests.limit_table(spark)


@REGISTRY.add("polled_tasks", values([("a", "done", 2), ("b", None, None)], "task VARCHAR, payload VARCHAR, polls INTEGER"))
def polled_tasks(spark, sf_dir):
    rows = [("a", 1, "PENDING", None), ("a", 2, "SUCCESS", "done"), ("a", 3, "SUCCESS", "later"), ("b", 16, "SUCCESS", "too late"), ("b", 1, "PENDING", None)]
    return requests.polled(spark.createDataFrame(rows, "task string, poll int, state string, payload string"))


LADDER = ["enacted", "authorized", "commissioned", "unattributed"]


@REGISTRY.add("translation_sources", values([("old", "lsi", 1), ("old", "web", 3), ("old", "odd", 4), ("new", "web", 3), ("new", "odd", 4)], "slug VARCHAR, key VARCHAR, rank INTEGER"))
def translation_sources(spark, sf_dir):
    """Sources worth trying for a statute, best tier first; a series only for statutes that it reaches."""
    laws = spark.createDataFrame([("old", "25 L. 11"), ("new", "")], "slug string, citation string")
    sources = spark.createDataFrame([("web", "unattributed"), ("lsi", "authorized"), ("odd", "nonsense")], "key string, authority string")
    return tables.sources_for(laws, sources, LADDER, "lsi").drop("authority")


@REGISTRY.add("rule_rows", values([("כל", "kol"), ("חכמה", "ḥokhmah")], "skeleton VARCHAR, value VARCHAR"))
def rule_rows(spark, sf_dir):
    text = "## The list\n| Word | Reading |\n|---|---|\n| כָּל | kol |\n| כָּל־ | kol |\n| חָכְמָה | ḥokhmah |\n"
    return tables.rule_table(spark.createDataFrame([(text,)], "value string"))


@REGISTRY.add("manifest_check", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 THEN 'changed' ELSE 'ok' END AS status FROM nation")
def manifest_check(spark, sf_dir):
    """Files against the digests that a manifest states."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    lines = nations.select(F.concat(F.lit("| "), "name", F.lit(" | x | "), F.sha2("name", 256), F.lit(" |")).alias("line")).agg(F.array_join(F.collect_list("line"), "\n").alias("value"))
    files = nations.where("n_nationkey % 5 <> 0").select("name", F.when(F.col("n_nationkey") % 5 == 1, F.lit("changed")).otherwise(F.col("name")).cast("binary").alias("content"))
    return tables.verified(tables.manifest(lines), files)


# ---- renderers

@REGISTRY.add(
    "rendered_readings",
    values(
        [
            ("block", "> שָׁלוֹם\n>\n> peace\n>\n> Gen 1, A; translation, B"), ("teaching", "שָׁלוֹם\n*shalom*\npeace\n\nGen 1 (A). Romanization: sbl-general."), ("interlinear", "> שָׁלוֹם — *shalom*\n\nGen 1 (A)"),
            ("inline", "שָׁלוֹם (*shalom*, peace)"), ("file", "Gen 1.1-2.md"),
        ],
        "kind VARCHAR, text VARCHAR",
    ),
)
def rendered_readings(spark, sf_dir):
    """A reading in every tier."""
    rows = spark.createDataFrame([("Gen 1", "שָׁלוֹם", "A", "peace", "B")], "ref string, t string, edition string, english string, other string")
    ref, t, edition, english, other = (F.col(c) for c in rows.columns)
    kinds = {
        "block": render.block(ref, t, edition, english, other), "teaching": render.teaching(ref, t, edition, english, "sbl-general")["text"], "interlinear": render.interlinear(ref, t, edition, "sbl-general"),
        "inline": render.inline(t, english, "sbl-general"), "file": render.file_name(F.concat(ref, F.lit(":1/2?"))),
    }
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in kinds.items()])).alias("r")).select("r.*")


@REGISTRY.add("study_files", values([("Gen 1", "Gen 1.md", "# Gen 1\n\n**1**\n\nשָׁלוֹם\n\n*shalom*\n\npeace\n\n**2**\n\nרַב\n\n*rav*\n\n## Editions\n\n- A, one.org\n", 0)], "ref VARCHAR, name VARCHAR, text VARCHAR, flags INTEGER"))
def study_files(spark, sf_dir):
    segments = spark.createDataFrame([("Gen 1", "2", [2], "רַב", None), ("Gen 1", "1", [1], "שָׁלוֹם", "peace")], "ref string, anchor string, position array<int>, text string, translation string")
    where = spark.createDataFrame([("Gen 1", 1, "A", "one.org")], "ref string, place int, title string, provider string")
    return render.study_files(segments, where, "sbl-general").withColumn("flags", F.size("flags"))


# ---- sets, sorts and limits

@REGISTRY.add(
    "missing_letters",
    "SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(p_name, '[^a-z]', '', 'g'), ''), lambda c: NOT contains('abcdefghij', c)))), 'string_agg', '') AS missing FROM part",
)
def missing_letters(spark, sf_dir):
    """Letters of a text that an alphabet lacks, each once, in order."""
    letters = F.regexp_extract_all("p_name", F.lit("([a-z])"), 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(letters, F.array(*[F.lit(c) for c in "abcdefghij"]))), "").alias("missing"))


@REGISTRY.add("ordered_distinct", "SELECT o_custkey, string_agg(p, ',' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """Values in the order of their first place, each once."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("p"))
    return rows.select("o_custkey", F.array_join(first_occurrences(F.col("p")), ",").alias("priorities"))


@REGISTRY.add(
    "request_schedule",
    """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, event_id, n, t, t AS a1, CAST(NULL AS BIGINT) AS a0 FROM e WHERE n = 1
            UNION ALL
            SELECT e.user_id, e.event_id, e.n, e.t,
                   CASE WHEN f.a0 IS NOT NULL AND greatest(e.t, f.a1) - f.a0 <= 86400000000 THEN f.a0 + 86400000000 + 50000 ELSE greatest(e.t, f.a1) END, f.a1
            FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, a1 - t AS waited FROM f
    """,
)
def request_schedule(spark, sf_dir):
    """When each request is let through a window of two a day, one after another."""
    return limits.schedule(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 86_400)
