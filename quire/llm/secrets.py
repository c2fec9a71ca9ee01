"""Secret scans: fixed patterns plus character Markov models (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.spans import let, positions

#: kind -> (pattern, group whose length counts, least length); letters of the keywords in either case.
#: A run that is too short cannot hold a longer one, so only ``assign``, whose failing matches use up text, needs a test of its own.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
#: Cheap tests that hold for every text with a match that counts.
MAY = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
KINDS = [*BASE, "markov"]
#: Characters of the Markov models; runs of them are scored.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = "[A-Za-z0-9+/_.=-]"
#: Most that one pair of characters adds to the log-likelihood ratio of a run, and the sum above which a run is taken for random.
MOST_PER_PAIR, THRESHOLD = 2.0, 12.0

SPAN = "struct<kind:int,start:int,end:int>"
#: The table of log ratios is indexed by two character codes below this.
CODES = 128


def _pairs(token: Column) -> Column:
    """Table indices, from 1, of all neighbouring characters of a token over the alphabet."""
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * CODES + b + 1)


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of random strings over identifiers for every pair of characters.

    ``samples`` has (token, random boolean); tokens of under two characters, null tokens or labels
    and characters outside the alphabet are left out. First-order models, smoothed towards each
    label's character frequencies; the counts are one grouped aggregate of at most the alphabet's
    square rows per label, whatever the size of the samples. Without samples all ratios are 0. The
    list is indexed by the first character's code times ``CODES`` plus the second one's.
    """
    token = F.regexp_replace("token", f"[^{ALPHABET.replace('-', '')}-]", "")
    rows = samples.where(F.col("random").isNotNull()).select("random", F.explode(F.array(token)).alias("token")).where(F.length("token") >= 2)
    counts = rows.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count()
    seen: dict[bool, dict[tuple[str, str], int]] = {True: {}, False: {}}
    for r in counts.collect():  # at most 2 * 68 * 68 rows
        seen[r["random"]][chr((r["pair"] - 1) // CODES), chr((r["pair"] - 1) % CODES)] = r["count"]

    def model(row: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
        """Conditional log-probabilities, backing off to the label's own character frequencies."""
        k = len(ALPHABET)
        single = {b: smoothing + sum(row.get((a, b), 0) for a in ALPHABET) for b in ALPHABET}
        total, out = sum(single.values()), {}
        for a in ALPHABET:
            n = sum(row.get((a, b), 0) for b in ALPHABET)
            out |= {(a, b): math.log((row.get((a, b), 0) + smoothing * k * single[b] / total) / (n + smoothing * k)) for b in ALPHABET}
        return out

    random, ordinary = model(seen[True]), model(seen[False])
    table = [0.0] * (CODES * CODES)
    for a, b in random:
        table[ord(a) * CODES + ord(b)] = random[a, b] - ordinary[a, b]
    return table


def random_samples(spark: SparkSession, n: int = 12000) -> DataFrame:
    """Labelled random strings, made from digests of a counter: base64, hex and upper-case keys of 12 to 43 characters."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    upper = F.translate(F.upper(b64), "+/=", "XYZ")
    token = F.when(F.col("id") % 3 == 0, b64).when(F.col("id") % 3 == 1, digest).otherwise(upper)
    return spark.range(n).select(F.substr(token, F.lit(1), (12 + F.col("id") % 32).cast("int")).alias("token"), F.lit(True).alias("random"))


def ordinary_form(word: Column) -> Column:
    """An identifier made from a word: as it is, joined, numbered, versioned, in a path or address, or a date; which one, a hash of the word says."""
    h = F.xxhash64(F.lit("form"), word)
    digit = lambda n, shift: F.pmod(F.shiftright(h, shift), F.lit(n)).cast("string")
    two = lambda n, shift: F.lpad((F.pmod(F.shiftright(h, shift), F.lit(n)) + 1).cast("string"), 2, "0")
    year, month, day, low = F.concat(F.lit("20"), two(60, 8)), two(12, 16), two(28, 24), F.lower(word)
    joined = lambda sep: F.concat(low, F.lit(sep), F.reverse(F.array(low, F.lit("item"), F.lit("main")))[F.pmod(F.shiftright(h, 12), F.lit(3)).cast("int")])
    forms = [
        word, word, word, joined("_"), joined("-"), joined("."), joined("/"),
        F.concat(low, F.initcap(low)), F.concat(low, digit(1000, 20)), F.concat(low, F.lit("_"), digit(100, 20)), F.concat_ws("_", F.upper(word), F.upper(word)),
        F.concat_ws("-", year, month, day, low), F.concat(year, month, day), F.concat_ws("-", low, F.concat(F.lit("v"), digit(10, 28))),
        F.concat_ws(".", digit(256, 4), digit(256, 12), digit(256, 20), digit(256, 28)), F.concat_ws(".", digit(10, 4), digit(20, 12), digit(40, 20)),
        F.concat(F.lit("www."), low, F.lit(".com/"), low, F.lit("-"), digit(10000, 20)), F.concat(low, F.lit("/"), F.initcap(low), digit(10, 28), F.lit(".txt")),
        F.concat(low, F.lit("_"), year, F.lit("_"), digit(10, 28), F.lit(".pdf")), digit(1_000_000_000, 8),
    ]
    which, out = F.pmod(h, F.lit(len(forms))), forms[0]
    for i, form in enumerate(forms[1:], 1):
        out = F.when(which == i, form).otherwise(out)
    return out


def identifier_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled ordinary identifiers, one for each distinct word of 3 and more letters in all documents (see ``ordinary_form``).

    A word counts once however often it stands anywhere, so copies do not weigh more.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]{3,}"), 0))).alias("word")).distinct()
    return words.select(ordinary_form(F.col("word")).alias("token"), F.lit(False).alias("random"))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    steps = let(matches, lambda found: F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"))))
    return F.transform(positions(steps), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _ratio(token: Column, table: Column) -> Column:
    """Summed log-likelihood ratio over the pairs of a token; long ones are split first, so that each character is found at once."""
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1)))
    add = lambda a, i: a + F.get(table, i)
    short = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: add(a, code(i) * CODES + code(i + 1)))
    return F.when(F.length(token) <= 64, short).otherwise(F.aggregate(_pairs(token), F.lit(0.0), lambda a, i: add(a, i - 1)))


def secret_spans(text: Column, table: list[float], threshold: float) -> tuple[Column, Column]:
    """(base spans, added spans) of a text, each an array of (kind, start, end)."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    base = []
    for kind, (name, (pattern, group, least)) in enumerate(BASE.items()):
        found = _matches(text, pattern, kind)
        if group:
            values = F.regexp_extract_all(text, F.lit(pattern), group)
            found = F.transform(F.filter(F.arrays_zip(found.alias("span"), values.alias("value")), lambda m: F.length(m["value"]) >= least), lambda m: m["span"])
        base.append(F.when(text.rlike(MAY[name]), found).otherwise(none))
    ratios = F.from_json(F.lit("[" + ",".join(f"{min(x, MOST_PER_PAIR):.4f}" if x else "0" for x in table) + "]"), "array<double>")
    # no shorter run can reach the threshold
    pattern = f"(?<!{RUN}){RUN}{{{int(threshold / MOST_PER_PAIR) + 2},}}"
    scores = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: _ratio(m, ratios) > threshold)
    spans = F.arrays_zip(_matches(text, pattern, len(BASE)).alias("span"), scores.alias("random"))
    added = F.when(F.array_contains(scores, True), F.transform(F.filter(spans, lambda m: m["random"]), lambda m: m["span"])).otherwise(none)
    return F.concat(*base), added


def _joined(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, spans of secrets by kind, in code points, end exclusive.

    Columns: ``base`` (spans of the fixed patterns) and ``added`` (maximal runs over the alphabet that
    the Markov models take for random: log-likelihood ratio, summed over pairs that add
    ``MOST_PER_PAIR`` each at most, above ``threshold``; so a short run must look random throughout,
    and runs of fewer than threshold / MOST_PER_PAIR pairs cannot pass. Runs that overlap a base span
    are left out). Both are arrays of (kind, start, end), kind indexing ``KINDS``. A null text is
    empty and has no spans; whole texts are scanned, whatever their length; other columns are ignored.
    ``samples``: see ``train_markov``.
    """
    base, added = secret_spans(F.col(text_col), train_markov(samples), threshold)
    rows = docs.select(F.col(id_col), base.alias("base"), added.alias("_added"))
    clear = F.filter("_added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return rows.select(id_col, "base", clear.alias("added"))


def secret_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, digest of the base spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        id_col,
        *[count(i).alias(f"n_{name}") for i, name in enumerate(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
