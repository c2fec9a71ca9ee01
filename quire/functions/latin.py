"""From Latin back: Hebrew spellings of a romanization, and the scheme a text is written in.

Both rest on tables derived from the schemes, so they describe whatever the schemes say.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import hebrew
from quire.functions.arrays import let, literal_map
from quire.functions.schemes import SCHEMES, Scheme

SIGN_MARKS = "-’‘ʾʿʼʻ"
FINALS = dict(zip("מנצפכ", "םןץףך", strict=True))


def spellings(scheme: Scheme) -> dict[str, list[str]]:
    """Latin value -> the letters that a scheme writes so: plain, with dagesh, rafe, geresh, the dots of shin, then sequences."""
    marks = ["", "ּ", "ֿ", "׳", "ׁ", "ׂ"]
    out: dict[str, list[str]] = {}
    for mark in marks:
        for form, value in scheme.consonants.items():
            if form[1:] != mark or form[0] in hebrew.FINALS or not value:
                continue
            letters = form[0] if mark == "ּ" else form  # a dagesh is a point, and points are not restored
            if letters not in out.setdefault(value, []):
                out[value].append(letters)
    for sequence, value in scheme.sequences.items():
        if sequence not in out.setdefault(value, []):
            out[value].append(sequence)
    return out


def reverse(text: Column, scheme_name: str) -> Column:
    """struct<letters, ambiguities>: a spelling that a scheme romanizes so, word by word.

    The longest value at each place is taken, its first letters put and the others named; vowels and
    signs without letters are passed over; what matches nothing is said. Last letters take their final form.
    """
    scheme = SCHEMES[scheme_name]
    options = {}
    for value, letters in spellings(scheme).items():  # values that differ in case alone: the first one
        options.setdefault(value.lower(), (value, letters))
    vowels = {v for v in scheme.vowels.values() if v} | {scheme.rule(k) for k in ("shva_na", "tsere_male", "hireq_male", "holam_male", "shuruq")} | set("aeiou")
    longest = sorted(options, key=len, reverse=True)
    pattern = "(?s)(" + "|".join([*map(re.escape, longest), "."]) + ")"
    first = literal_map({k: letters[0] for k, (_, letters) in options.items()})
    several = literal_map({k: f"'{value}' could be " + " or ".join(letters) for k, (value, letters) in options.items() if len(letters) > 1})
    passed = [v for v in vowels if len(v) == 1] + list(SIGN_MARKS)

    def word(w: Column) -> Column:
        tokens = F.regexp_extract_all(w, F.lit(pattern), 1)
        letters = F.filter(F.transform(tokens, lambda t: F.element_at(first, t)), lambda x: x.isNotNull())
        unknown = lambda t: F.when(F.element_at(first, t).isNull() & ~t.isin(passed), F.concat(F.lit("'"), t, F.lit(f"' matches nothing in {scheme.name}")))
        notes = F.filter(F.transform(tokens, lambda t: F.coalesce(F.element_at(several, t), unknown(t))), lambda x: x.isNotNull())
        final = lambda a: F.coalesce(F.element_at(literal_map(FINALS), F.element_at(a, -1)), F.element_at(a, -1))
        fixed = let(letters, lambda a: F.when(F.size(a) > 0, F.concat(F.array_join(F.slice(a, 1, F.size(a) - 1), ""), final(a))).otherwise(""))
        return F.struct(fixed.alias("letters"), notes.alias("notes"))

    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), word)
    return let(words, lambda ws: F.struct(F.array_join(ws["letters"], " ").alias("letters"), F.flatten(ws["notes"]).alias("ambiguities")))


def reverse_candidates(texts: DataFrame, text_col: str = "text", schemes: list[str] | None = None) -> DataFrame:
    """Columns of ``texts`` plus scheme, letters, ambiguities, n_ambiguities and rank: by ambiguities, then by scheme name."""
    each = F.array(*[F.struct(F.lit(s).alias("scheme"), reverse(F.col(text_col), s).alias("r")) for s in schemes or sorted(SCHEMES)])
    ranked = F.array_sort(F.transform(each, lambda c: F.struct(F.size(c["r"]["ambiguities"]).alias("n"), c["scheme"].alias("scheme"), c["r"].alias("r"))))
    rows = texts.select(*[F.col(f"`{c}`") for c in texts.columns], F.posexplode(ranked).alias("at", "c"))
    return rows.select(
        *[F.col(f"`{c}`") for c in texts.columns], F.col("c.scheme").alias("scheme"), F.col("c.r.letters").alias("letters"),
        F.col("c.r.ambiguities").alias("ambiguities"), F.col("c.n").alias("n_ambiguities"), (F.col("at") + 1).alias("rank"),
    )


def signatures() -> dict[str, list[str]]:
    """Telling values of each scheme: of several characters or beyond ASCII, longest first."""
    return {n: sorted((v for v in s.emitted() if len(v) > 1 or not v.isascii()), key=lambda v: (-len(v), v)) for n, s in SCHEMES.items()}


def rarity() -> dict[str, int]:
    """Number of schemes that write each telling value."""
    values = [v for some in signatures().values() for v in some]
    return {v: values.count(v) for v in set(values)}


def producible() -> dict[str, list[str]]:
    """Characters that each scheme can write, lower case."""
    return {n: sorted({c for v in s.emitted() for c in v.lower()}) for n, s in SCHEMES.items()}


def undetectable() -> list[str]:
    """Schemes without any telling value."""
    return [n for n, values in signatures().items() if not values]


def occurrences(text: Column, value: str) -> Column:
    """Non-overlapping occurrences of a value."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(value), F.lit("")))) / len(value)).cast("long")


def detect(text: Column, limit: int = 3) -> Column:
    """Likeliest schemes of a text: array of struct<scheme, score, matched, impossible>.

    A scheme scores each telling value's occurrences over the number of schemes that write it. One that
    cannot write a letter of the text stands below all that can; without a score it is left out.
    """
    rare, can = rarity(), producible()
    lowered = F.lower(text)
    present = F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"(\p{L})"), 1)))
    values = sorted({v.lower() for some in signatures().values() for v in some})

    def judged(counts: Column, letters: Column) -> Column:
        guesses = []
        for name, some in signatures().items():
            seen = [F.get(counts, values.index(v.lower())) for v in some]
            score = sum((n / rare[v] for n, v in zip(seen, some, strict=True)), F.lit(0.0))
            matched = F.filter(F.array(*[F.when(n > 0, v) for n, v in zip(seen, some, strict=True)]), lambda v: v.isNotNull())
            impossible = F.array_except(letters, F.array(*map(F.lit, can[name])))
            guesses.append(F.struct((F.size(impossible) > 0).alias("no"), (-F.round(score, 3)).alias("less"), F.lit(name).alias("scheme"), matched.alias("matched"), impossible.alias("impossible")))
        kept = F.filter(F.array_sort(F.array(*guesses)), lambda g: g["less"] < 0)
        return F.transform(F.slice(kept, 1, limit), lambda g: F.struct(g["scheme"].alias("scheme"), (-g["less"]).alias("score"), g["matched"].alias("matched"), g["impossible"].alias("impossible")))

    counts = F.array(*[occurrences(lowered, v) for v in values])
    return let(F.struct(counts.alias("counts"), present.alias("letters")), lambda f: judged(f["counts"], f["letters"]))


def explain(guesses: Column) -> Column:
    """A short report of ``detect``'s guesses with their evidence, and whether the first two tie."""
    line = lambda g: F.concat(F.lit("  "), F.rpad(g["scheme"], 34, " "), F.lit(" "), F.lpad(g["score"].cast("string"), 3, " "), F.lit("  "), F.array_join(F.transform(F.slice(g["matched"], 1, 8), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "))
    tie = F.when((F.size(guesses) > 1) & (guesses[0]["score"] == F.get(guesses, F.lit(1))["score"]), "\n\nThe top two tie, so this is not a determination.").otherwise("")
    found = F.concat(F.lit("Most likely first, with the evidence:\n"), F.array_join(F.transform(guesses, line), "\n"), tie)
    return F.when(F.size(guesses) > 0, found).otherwise("No scheme can be identified: this text uses nothing that only one scheme produces.")
