"""Romanization schemes as tables: a row per rule, per sign and per letter sequence.

Fixed values, as the published schemes print them. A dot in a cell means that the scheme prints no
such row; an empty pair of quotes stands for a value that it prints as empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

HEBREW_SCHEMES = "sbl-general sbl-academic ala-lc bgn-pcgn encyclopaedia-judaica-general encyclopaedia-judaica-scientific".split()
YIDDISH_SCHEMES = ["yivo", "ala-lc-yiddish"]

# Rules by scheme, columns in the order of HEBREW_SCHEMES; blanks take the default
RULES = """
doubles            true   true  false true   true true
never_double       ts,sh  .     .     sh,ts  sh   sh
article_doubles    false  .     .     .      .    .
hyphenate_prefixes true   false true  false  .    .
capital_prefixes   .      .     .     true   .    .
always_mark_alef   false  true  false false  false true
shva_na            e      ǝ     e     e      e    ə
tsere_male         ei     ê     e     e      ei   e
hireq_male         i      î     i     i      i    i
holam_male         o      ô     o     o      o    o
shuruq             u      û     u     u      u    û
qamats_he          ah     â     .     .      .    .
patah_male         .      .     ai    .      .    .
suffix_3ms         ayw    āyw   .     .      .    .
source_gaps        .      .     .     .      hataf_qamats,qamats_qatan hataf_qamats,qamats_qatan
"""

# Consonants, a row per form, columns in the order of HEBREW_SCHEMES and then YIDDISH_SCHEMES
CONSONANTS = """
א ’ ʾ ʼ ’ "" ʾ "" ʼ
ב v b v v v v b b
בּ b . b b b b . b
בֿ . . . . . . v .
ג g g g g g ḡ g g
גּ . . . g g g . .
ג׳ . . . ǧ dzh ğ . .
ד d d d d d ḏ d d
דּ . . . d d d . .
ה h h h h h h h h
ו v w ṿ v v w u ṿ
וּ . . . . . . u .
ז z z z z z z z z
ז׳ . . . ž zh ž . .
ח ḥ ḥ ḥ ẖ ḥ ḥ kh ḥ
ט t ṭ ṭ t t ṭ t ṭ
י y y y y y y y y
ך kh k kh kh kh kh kh kh
ךּ . . k k . . . k
כ kh k kh kh kh kh kh kh
כּ k . k k k k k k
ל l l l l l l l l
ם m m m m m m m m
מ m m m m m m m m
ן n n n n n n n n
נ n n n n n n n n
ס s s s s s s s s
ע ‘ ʿ ʻ ‘ "" ʿ e ʻ
ף f p f f f f f f
ףּ . . p . . . . p
פ f p f f f f . f
פּ p . p p p p p p
פֿ . . . . . . f .
ץ ts ṣ ts ts ẓ ṣ ts ts
צ ts ṣ ts ts ẓ ṣ ts ts
צ׳ . . . č ch č . .
ק q q ḳ q k q k ḳ
ר r r r r r r r r
ש . . . . . . sh .
שׁ sh š sh sh sh š . sh
שׂ s ś ś s s ś s ś
ת t t t t t ṯ s s̀
תּ . . t t t t t t
װ . . ṿ . . . . ṿ
"""

# Vowel points by code point, columns in the order of HEBREW_SCHEMES
VOWELS = """
05B0 e ǝ e e e ə
05B1 e ĕ e e e œ
05B2 a ă a a a a
05B3 o ŏ o o . .
05B4 i i i i i i
05B5 e ē e e e e
05B6 e e e e e æ
05B7 a a a a a a
05B8 a ā a a a å
05B9 o ō o o o o
05BB u u u u u u
05C7 o o o o . .
"""

# Letter sequences of the Yiddish schemes
SEQUENCES = {
    "yivo": "אַ a אָ o וו v װ v זש zh דזש dzh טש tsh וי oy ױ oy יי ey ײ ey ײַ ay ייַ ay",
    "ala-lc-yiddish": (
        "אַ a אָ o ו u או u וי oy אוי oy ױ oy אױ oy י i אי i ע e ײַ ay אײַ ay ייַ ay אייַ ay ײ ey אײ ey יי ey איי ey"
    ),
}

# Words whose qamats is short, divine names and what is written for them, accepted English forms, by consonants
SHORT_QAMATS = "כל חכמה אזנימ חפשי קדשו קדשי עניי תכנית אניה נעמי".split()
SACRED = {"יהוה": "HaShem", "אדני": "Adonai"}
ESTABLISHED_FORMS = """
תורה Torah
תלמוד Talmud
משנה Mishnah
כשר kosher
קבלה Kabbalah
סנהדרין Sanhedrin
קידושין Kiddushin
שבת Shabbat
ירושלים Jerusalem
משה Moses
רמבם Maimonides
מצוה mitzvah
הלכה halakhah
מדרש midrash
סידור siddur
תנך Tanakh
גמרא Gemara
רבי Rabbi
כנסת Knesset
שופר shofar
מנורה menorah
סוכה sukkah
חנוכה Hanukkah
פסח Passover
מזוזה mezuzah
ציצית tzitzit
תפילין tefillin
ישיבה yeshiva
רבנות rabbinate
"""
FINAL_TO_BASE = str.maketrans("םןץףך", "מנצפכ")
ESTABLISHED = {hebrew.translate(FINAL_TO_BASE): english for hebrew, english in (line.split() for line in ESTABLISHED_FORMS.strip().split("\n"))}


@dataclass(frozen=True)
class Scheme:
    """A scheme as read from its tables; an empty rule does not apply."""

    name: str
    script: str
    consonants: dict[str, str]
    vowels: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, str] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)

    def rule(self, key: str, default: str = "") -> str:
        return self.rules.get(key, default)

    def holds(self, key: str, default: bool = False) -> bool:
        return self.rules.get(key, str(default).lower()) == "true"

    def listed(self, key: str) -> list[str]:
        return [x for x in self.rule(key).split(",") if x]

    def emitted(self) -> set[str]:
        """Every Latin string that the scheme can write, but for rules that few schemes state."""
        rules = {self.rule(k) for k in ("shva_na", "tsere_male", "hireq_male", "holam_male", "shuruq")}
        return {v for v in {*self.consonants.values(), *self.vowels.values(), *self.sequences.values(), *rules} if v}


def _column(table: str, at: int) -> dict[str, str]:
    """One scheme's column of a table, rows without a value left out."""
    rows = (line.split() for line in table.strip().split("\n"))
    return {row[0]: row[at].strip('"') for row in rows if len(row) > at and row[at] != "."}


def _read() -> dict[str, Scheme]:
    out = {}
    for at, name in enumerate(HEBREW_SCHEMES, 1):
        vowels = {chr(int(point, 16)): value for point, value in _column(VOWELS, at).items()}
        out[name] = Scheme(name, "hebrew", _column(CONSONANTS, at), vowels, rules=_column(RULES, at))
    for at, name in enumerate(YIDDISH_SCHEMES, 1 + len(HEBREW_SCHEMES)):
        pairs = SEQUENCES[name].split()
        out[name] = Scheme(name, "yiddish", _column(CONSONANTS, at), sequences=dict(zip(pairs[::2], pairs[1::2], strict=True)))
    return out


SCHEMES = _read()
