"""Register of romanized text: Ashkenazi or Sephardi, by weighted markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers with their weights, whole words unless they end in an asterisk; any case.
ASHKENAZI = {"Shabbos": 3, "Shabbes": 3, "Akeidas": 3, "Bereishis": 3, "Sukkos": 3, "Shavuos": 3, "mitzvos": 3, "Toyre": 3, "halach*": 2, "chochm*": 2, "Moshiach": 2, "yomim": 2}
SEPHARDI = {"Shabbat": 3, "Sukkot": 3, "Shavuot": 3, "mitzvot": 3, "Bereshit": 3, "halakh*": 2, "ḥokhm*": 2, "Mashiach": 2}
DOTTED = "ḥṭṣẓḳ"
ASHKENAZI_ENDS, SEPHARDI_ENDS = r"\b[A-Za-z]{2,}(?:os|us)\b", r"\b[A-Za-z]{2,}ot\b"


def _patterns(markers: dict[str, int]) -> dict[int, str]:
    """Weight -> one pattern for all markers of that weight."""
    bodies: dict[int, list[str]] = {}
    for marker, weight in markers.items():
        bodies.setdefault(weight, []).append(marker[:-1] if marker.endswith("*") else rf"{marker}\b")
    return {weight: rf"(?iu)\b(?:{'|'.join(some)})" for weight, some in bodies.items()}


def _score(text: Column, markers: dict[str, int], ends: str) -> Column:
    """Weighted markers and endings; markers of one weight share a pass, as no two can begin at the same place."""
    total = F.regexp_count(text, F.lit(ends))
    for weight, pattern in _patterns(markers).items():
        total = total + F.regexp_count(text, F.lit(pattern)) * weight
    return total


def scores(text: Column) -> tuple[Column, Column]:
    """(Ashkenazi, Sephardi) scores; a null text scores nothing."""
    text = F.coalesce(text, F.lit(""))
    return _score(text, ASHKENAZI, ASHKENAZI_ENDS), _score(text, SEPHARDI, SEPHARDI_ENDS) + F.regexp_count(text, F.lit(f"(?iu)[{DOTTED}]"))


def evidence(text: Column) -> Column:
    """Words that a text's scores rest on, in order of their place, each once."""
    markers = "|".join(m[:-1] if m.endswith("*") else rf"{m}\b" for m in [*ASHKENAZI, *SEPHARDI])
    pattern = rf"(?u)((?i:\b(?:{markers}))|(?i:[{DOTTED}])|{ASHKENAZI_ENDS}|{SEPHARDI_ENDS})"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))


def register(ashkenazi: Column, sephardi: Column) -> Column:
    return F.when(ashkenazi > sephardi, "ashkenazi").when(sephardi > ashkenazi, "sephardi").otherwise("undetermined")


def confident(ashkenazi: Column, sephardi: Column) -> Column:
    high, low = F.greatest(ashkenazi, sephardi), F.least(ashkenazi, sephardi)
    return (high >= 3) & (high >= low * 2)


def guarded(ashkenazi: Column, sephardi: Column, scheme: str, force: bool = False) -> Column:
    """Whether romanizing under ``scheme`` must be refused: confident Ashkenazi text, another tradition's scheme."""
    ours = F.lit(scheme in ("yivo", "ala-lc-yiddish") or force)
    return (ashkenazi > sephardi) & confident(ashkenazi, sephardi) & ~ours
