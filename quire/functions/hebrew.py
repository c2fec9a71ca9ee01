"""Column expressions on pointed Hebrew and Yiddish.

Fixed values: letters U+05D0-05EA and the ligatures U+05F0-05F2; vowels U+05B0-05BB and U+05C7; points as
in ``POINTS``; accents U+0591-05AF; marks that are punctuation, not points, U+05BE, 05C0, 05C3, 05C6.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "\u05d0-\u05ea\u05f0-\u05f2"
VOWELS = "\u05b0-\u05bb\u05c7"
POINTS = "\u0591-\u05bd\u05bf\u05c1\u05c2\u05c7\u034f\u05f3\u05f4"
ACCENTS = "\u0591-\u05af"
MAQAF = "\u05be"
FINALS, BASES = "\u05da\u05dd\u05df\u05e3\u05e5", "\u05db\u05de\u05e0\u05e4\u05e6"


#: Presentation forms that normalization (NFC) writes as letters and points.
PRESENTATION = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in range(0xFB1D, 0xFB50) if unicodedata.normalize("NFC", chr(c)) != chr(c)}


def normalized(text: Column) -> Column:
    """Hebrew presentation forms as letters and points; the rest is taken as composed already."""
    plain = reduce(lambda out, form: F.replace(out, F.lit(form[0]), F.lit(form[1])), PRESENTATION.items(), text)
    return F.when(text.rlike("[\ufb1d-\ufb4f]"), plain).otherwise(text)


def is_letter(character: Column) -> Column:
    return character.rlike(f"^[{LETTERS}]$")


def is_final(character: Column) -> Column:
    return character.rlike(f"^[{FINALS}]$")


def is_point(character: Column) -> Column:
    return character.rlike(f"^[{POINTS}]$")


def is_vowel(character: Column) -> Column:
    return character.rlike(f"^[{VOWELS}]$")


def is_accent(character: Column) -> Column:
    return character.rlike(f"^[{ACCENTS}]$")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ACCENTS}]", "")


def strip_vowels(text: Column) -> Column:
    """Without vowel points; the dots of letters stay."""
    return F.regexp_replace(text, f"[{VOWELS}]", "")


def strip_points(text: Column) -> Column:
    return F.regexp_replace(text, f"[{POINTS}]", "")


def strip_punctuation(text: Column) -> Column:
    """Without paseq, end of verse, inverted nun, geresh and gershayim; the maqaf stays."""
    return F.regexp_replace(text, "[\u05c0\u05c3\u05c6\u05f3\u05f4]", "")


def for_speech(text: Column) -> Column:
    return strip_punctuation(strip_accents(normalized(text)))


def syllables(word: Column) -> Column:
    """Estimate: letters with a full vowel or a hataf, and vavs with a dot alone."""
    full = F.regexp_count(word, F.lit("[\u05b1-\u05bb\u05c7]"))
    shuruq = F.regexp_count(word, F.lit("\u05d5(?=\u05bc)(?![\u0591-\u05bb\u05bd\u05bf\u05c1\u05c2\u05c7]*[\u05b0-\u05bb\u05c7])"))
    return full + shuruq


def has_meteg(word: Column) -> Column:
    return word.contains("\u05bd")


def base_letters(text: Column) -> Column:
    """Final forms as their base letters."""
    return F.translate(text, FINALS, BASES)


def skeleton(text: Column) -> Column:
    """Letters alone, finals folded; ligatures count as letters."""
    return base_letters(F.regexp_replace(text, f"[^{LETTERS}]", ""))


def has_hebrew(text: Column) -> Column:
    return text.rlike(f"[{LETTERS}]")


def is_hebrew_word(text: Column) -> Column:
    return text.rlike(f"^[{POINTS}]*[{LETTERS}][{LETTERS}{POINTS}]*$")


def has_vowels(text: Column) -> Column:
    return text.rlike(f"[{VOWELS}]")


def has_accents(text: Column) -> Column:
    return text.rlike(f"[{ACCENTS}]")


def vocalization(text: Column) -> Column:
    """accented, pointed or bare, the fullest that holds."""
    return F.when(has_accents(text), "accented").when(has_vowels(text), "pointed").otherwise("bare")


def runs(text: Column) -> Column:
    """Runs in order: (kind hebrew or other, text, trailing); a maqaf trails the Hebrew run before it.

    Points without a letter before them are other text; a maqaf after anything else is a run of its own.
    """
    word = f"[{LETTERS}][{LETTERS}{POINTS}]*"
    pattern = f"({word}{MAQAF}?|[^{LETTERS}{MAQAF}]+|{MAQAF})"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 1),
        lambda r: F.struct(
            F.when(r.rlike(f"^[{LETTERS}]"), "hebrew").otherwise("other").alias("kind"),
            F.when(r.rlike(f"^[{LETTERS}]"), F.replace(r, F.lit(MAQAF), F.lit(""))).otherwise(r).alias("text"),
            F.when(r.rlike(f"^[{LETTERS}].*{MAQAF}$"), MAQAF).otherwise("").alias("trailing"),
        ),
    )


def clusters(word: Column) -> Column:
    """Letters of a word with what their marks say; the first vowel of a letter wins."""

    def cluster(c: Column) -> Column:
        marks = F.substr(c, F.lit(2), F.length(c))
        vowel = F.regexp_extract(marks, f"([{VOWELS}])", 1)
        return F.struct(
            F.left(c, F.lit(1)).alias("letter"),
            marks.contains("\u05bc").alias("dagesh"),
            marks.contains("\u05bf").alias("rafe"),
            marks.contains("\u05c1").alias("shin"),
            marks.contains("\u05c2").alias("sin"),
            marks.rlike("[\u05f3\u05f4]").alias("geresh"),
            marks.contains("\u05bd").alias("meteg"),
            F.when(vowel != "", vowel).alias("vowel"),
            c.alias("raw"),
        )

    return F.transform(F.regexp_extract_all(word, F.lit(f"([{LETTERS}][{POINTS}]*)"), 1), cluster)
