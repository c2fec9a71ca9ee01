"""Operators on cases that the tables do not hold: edges, errors, streams, files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quire.functions import latin, romanizer, schemes, text
from quire.operators import editions, render, romanized, statutes
from quire.sources import recorded, requests, services, tables
from quire.streaming import limits


def test_whole_tables_equal_the_expression(spark):
    rows = [(1, "כָּל־הָאָרֶץ and שָׁלוֹם׃"), (2, "no Hebrew"), (3, ""), (4, None), (5, "שָׁלוֹם שָׁלוֹם שלום"), (6, "־ וְ־־ּ")]
    df = spark.createDataFrame(rows, "doc long, t string")
    want = {r.doc: (r.r.text, list(r.r.flags)) if r.r else (None, []) for r in df.select("doc", romanizer.romanize(F.col("t")).alias("r")).collect()}
    got = {r.doc: (r.text, list(r.flags or [])) for r in romanized.romanize_texts(df, "doc", "t").collect()}
    assert got == want


def test_entities_equal_the_standard_library(spark):
    import html

    cases = ["&amp;lt; &copy; &#8220;x&#x201D; &#150; &bogus; &notit; &ampx &#65 & &NotEqualTilde; &#0; &#x110000; 𝄞&#119070;"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(text.unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [html.unescape(c) for c in cases]


def test_front_matter_and_tables():
    scheme = "---\nname: mine\ndoubles: true\nnever_double: [ts, 'sh']\nshva_na: \"\"\n---\n## Consonants\n| Letter | Name | Value |\n|---|---|---|\n| א | alef | ∅ |\n| בּ | bet | b |\n\n## Vowels\n| Point | Value |\n|---|---|\n| ◌ָ | a |\n"
    read = tables.load_scheme(scheme)
    assert read["rules"] == {"name": "mine", "doubles": True, "never_double": ["ts", "sh"], "shva_na": ""} and read["consonants"] == {"א": "", "בּ": "b"} and read["vowels"] == {"ָ": "a"}
    for bad in ("no front", "---\nname: a\nname: b\n---\n", "---\nwhat: a\n---\n", "---\nname: a\n", "---\nname: a\n---\n## Consonants\ntext\n", "---\ndoubles: true\n---\n"):
        with pytest.raises(tables.TableError):
            tables.load_scheme(bad)
    with pytest.raises(tables.TableError, match="has the values"):
        tables.read_forms([["ב", "v"], ["ב", "b"]])


def test_requests_are_checked():
    assert requests.address("https://x.org/a", {"q": ["a b", "c"], "yes": True, "none": None}) == "https://x.org/a?q=a%20b&q=c&yes=1"
    assert requests.bounded(100) == 100 and services.law_filter("o'x") == "substringof('o''x',Name)"
    for wrong in (lambda: requests.address("file:///etc", {}), lambda: requests.bounded(0), lambda: requests.checked({"z": 1}, {"a": None}), lambda: requests.checked({"a": "q"}, {"a": ["x"]}), lambda: services.laws(None, " ")):
        with pytest.raises(ValueError):
            wrong()


def test_recorded_answers(spark, tmp_path):
    rows = [{"service": "library", "url": "u1", "written": "2024-01-01T00:00:00", "payload": {"is_ref": True}}, {"service": "register", "url": "u2", "body": "b", "written": "2024-01-01T00:00:00", "payload": "[1]"}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    recorded.register(spark)
    got = spark.read.format("recorded").load(str(tmp_path)).orderBy("url").collect()
    assert [(r.service, r.body, r.payload) for r in got] == [("library", None, '{"is_ref": true}'), ("register", "b", "[1]")] and got[0].written == datetime.datetime(2024, 1, 1)
    assert spark.read.format("recorded").option("service", "register").load(str(tmp_path)).count() == 1


def test_errors_of_renderers_and_topics(spark):
    blank = spark.createDataFrame([("r", None, " ")], "ref string, t string, s string")
    none = F.lit("")
    for column in (render.block(F.col("ref"), F.col("t"), none, none, none), render.inline(F.col("s"), none, "sbl-general")):
        with pytest.raises(Exception, match="no Hebrew found|no text to gloss"):
            blank.select(column).collect()
    with pytest.raises(Exception, match="no topic"):
        services.topic(spark.createDataFrame([("x", "{}")], "key string, payload string")).collect()


def test_files_are_written_by_name(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "# A\n\ntext"), ("b.md", "# B")], "name string, text string")
    render.write_files(files, f"{tmp_path}/out")
    got = {r.file: r.value for r in spark.read.text(f"{tmp_path}/out", wholetext=True).collect()}
    assert got["a.md"].startswith("# A\n\ntext") and set(got) == {"a.md", "b.md"}


def test_detection_and_its_report(spark):
    rows = spark.createDataFrame([(1, "ha-melekh shemaʻ ḳol ṿe-ṭov"), (2, "shalom"), (3, "123"), (4, None)], "id int, t string")
    guesses = latin.detect(F.col("t"))
    got = {r.id: r for r in rows.select("id", guesses.alias("g"), latin.explain(guesses).alias("e")).collect()}
    assert got[1].g[0].scheme.startswith("ala-lc") and got[1].e.startswith("Most likely first") and got[3].g == [] and got[3].e.startswith("No scheme")
    assert latin.undetectable() == [] and set(latin.spellings(schemes.SCHEMES["sbl-general"])["t"]) == {"ט", "ת"}


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "doc string, text string")
    assert statutes.parse_sections(none).count() == 0
    assert statutes.parse_sections(spark.createDataFrame([("a", None), ("b", "no sections")], "doc string, text string")).count() == 0
    schema = "ref string, place int, title string, language string, actual_language string, source string, text string"
    assert editions.compare_editions(spark.createDataFrame([("r", 1, "A", "he", None, None, None), ("r", 2, "B", "he", None, None, "ויכלו")], schema)).count() <= 1
    picked = editions.chosen_editions(spark.createDataFrame([("r", "A", "he", True, False, 1), ("r", "B", "en", False, False, 2)], "ref string, title string, language string, is_source boolean, is_primary boolean, priority int"), "en|B")
    assert [r.title for r in picked.collect()] == ["B"]


def test_schedule_as_a_stream(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // 2)) for i in range(40)]
    events = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    events.write.parquet(f"{tmp_path}/in")
    want = {r.id: r.waited for r in limits.schedule(events, "key", "ts", "id", 2, 3).collect()}
    stream = limits.schedule_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "key", "ts", "id", 2, 3)
    query = stream.writeStream.format("memory").queryName("scheduled").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.waited for r in spark.table("scheduled").collect()} == want and max(want.values()) > 0
    with pytest.raises(ValueError):
        limits.schedule(events, "key", "ts", "id", 0, 3)
