"""Exact dedup, chat formatting and secret scans against brute force and on edge cases."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quire.llm import chat, exact_dedup, secrets

DOCS = "doc_id long, text string, keep_id string"


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best, size = {}, {}
    for i, t, _ in rows:
        k = norm(t)
        size[k] = size.get(k, 0) + 1
        cand = (-len(t or ""), i is None, i if i is not None else 0)
        best[k] = min(best.get(k, cand), cand)
    return sorted(
        (str(i), str(None if best[norm(t)][1] else best[norm(t)][2]), size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows
    )


def test_exact_dedup_edges(spark):
    rows = [(1, "a b", "x"), (2, "ab ", "x"), (3, "a  b", None), (4, None, None), (5, " \t", None), (None, "ab", None), (7, "ünï 𝄞", "y"), (8, "ünï\n𝄞", "y"), (8, "ünï\n𝄞", "y"), (9, "long " * 20000, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = exact_dedup.exact_dedup(df, fan_in=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute_dedup(rows)
    assert [r.kept for r in got if r.doc_id == 3] == [True]
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_spans(text):
    out = []
    for name, (pattern, group, least) in secrets.BASE.items():
        rx = re.compile(pattern.replace("(?i:", "(?ai:"))
        out += [(m.start(), secrets.KINDS.index(name), m.end()) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "PassWord", "api_key", "apikey", "token", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH1234567", "deadbeef", "0123456789abcdef", "é𝄞", "\n", "x", "secret", "passwdtoken", "--", "a1B2c3D4e5F6"]
    texts = [None, "", "password = abc"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["x " * 50000 + "token: 12345678"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("clash")).repartition(4)
    samples = secrets.random_samples(spark).unionByName(secrets.identifier_samples(docs))
    got = {r.doc_id: r for r in secrets.secret_digest(secrets.scan_secrets(docs, samples)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i].n_assign == want.count("assign:") and got[i].n_hex == want.count("hex:") and got[i].n_access == want.count("access:")


ORDINARY = (
    "connection_pool_size2 http.request.timeout1 user_profile_settings3 benchmark-results-final4 2024-01-15-meeting-notes-v2 192.168.100.200.10.20.30 report_2023_final_version_7.docx "
    "www.example.com/products/item-4711 src/main/java/com/acme/Service2.java 20240115 internationalization getUserProfileById MAX_CONNECTION_COUNT 1.14.3-beta.2 /usr/local/lib/python3.11"
).split()
RANDOM = "xQ9vZ2kLr8TnW4bYp7Gd aJ3kd9Xq0PzLm2Vt8RwE q8Zt5LmX2cVb9NkJ4hGf XkQzVbNwRtLpGhJd fG7dK2pQ9xZ4 BCQXZRTKWPVHGJMNDFLS".split()


def brute_added(text, table, base):
    """Runs that the table takes for random, but for those that overlap a base span."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text or ""):
        ratio = sum(min(table[ord(a) * secrets.CODES + ord(b)], secrets.MOST_PER_PAIR) for a, b in zip(m[0], m[0][1:]))
        if ratio > secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, e in base):
            out.append((m.start(), m.end()))
    return out


def test_markov_tells_random_from_ordinary(spark):
    """Fitted on half of the words of the smallest tables; the identifiers of the other half are held out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = secrets.identifier_samples(docs).withColumn("h", F.pmod(F.xxhash64("token"), F.lit(2)))
    keys = secrets.random_samples(spark, 6000).withColumn("h", F.pmod(F.xxhash64("token"), F.lit(2)))
    known = keys.unionByName(words).where("h = 0").select("token", "random")
    blank = spark.createDataFrame([(None, True), ("a", None)], "token string, random boolean")
    table = secrets.train_markov(known.unionByName(blank))
    base, added = secrets.secret_spans(F.col("token"), table, secrets.THRESHOLD)
    held = keys.unionByName(words).where("h = 1").select("random", (F.size(added) > 0).alias("hit"), F.length("token").alias("n")).collect()
    right, wrong = sum(r.random and r.hit for r in held), sum(not r.random and r.hit for r in held)
    recall = right / sum(r.random for r in held)
    long = [r.hit for r in held if r.random and r.n >= 20]
    print("precision", right / (right + wrong), "recall", recall, "from 20 characters", sum(long) / len(long), len(held))
    assert right / (right + wrong) > 0.99 and recall > 0.9 and sum(long) / len(long) > 0.97
    texts = [f"see {w} there" for w in ORDINARY + RANDOM] + ["password = xQ9vZ2kLr8TnW4bYp7Gd", "é" * 30 + " xQ9vZ2kLr8TnW4bYp7Gd𝄞aJ3kd9Xq0PzLm2Vt8RwE", None, "x" * 100 + "aJ3kd9Xq0PzLm2Vt8RwE" * 5]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).collect()}
    table = secrets.train_markov(known)
    for i, t in enumerate(texts):
        assert [(s.start, s.end) for s in got[i].added] == brute_added(t, table, [(s.start, s.end) for s in got[i].base]), t
    assert [len(got[i].added) for i in range(len(ORDINARY + RANDOM))] == [0] * len(ORDINARY) + [1] * len(RANDOM)
    assert secrets.train_markov(known.limit(0)) == [0.0] * secrets.CODES**2


def test_spans_take_time_in_proportion(spark):
    """Texts full of failing and counting matches: four times the length takes some four times as long, not sixteen."""
    table = [-0.1] * secrets.CODES**2
    base, added = secrets.secret_spans(F.col("t"), table, secrets.THRESHOLD)
    took = {}
    for n in (1_000, 4_000, 16_000):
        text = "token=a be cafe password: hunter2x4y abcdefghij " * n
        df = spark.createDataFrame([(text,)], "t string")
        began = time.time()
        spans = df.select(base.alias("b")).first().b
        took[n] = time.time() - began
        assert len(spans) == n and (spans[-1].start, spans[-1].end) == (48 * (n - 1) + 16, 48 * (n - 1) + 36)
    assert took[16_000] < 10 * max(took[4_000], 0.5), took


TREE = "tree long, node long, parent long, score double, role string, text string, extra string"


def test_columns_with_names_of_the_operator(spark):
    """Columns named like the operators' own ones are ignored; a long conversation keeps its spans."""
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} & <|", "a", "b", "c", "d", "e", "f") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, position string, above string, at string, total string, branch string, loss string")
    rows = chat.linear_trees(df).withColumns({c: F.lit("x") for c in ("position", "above", "at", "total", "branch", "_above", "gain")})
    out = chat.format_trees(rows).select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("t")).first()
    assert out.t == "".join(f"text {i} & <|" for i in range(1, 3000, 2))


def test_reply_trees_rank_branches_and_round_trip(spark):
    rows = [
        (1, 10, None, 0.0, "user", "q", None), (1, 11, 10, 1.0, "assistant", "good <|end|> &lt; &amp;", None), (1, 12, 10, 0.5, "assistant", "bad", None),
        (1, 13, 12, 0.4, "user", None, None), (1, 14, 11, -3.0, "user", "neg", None), (2, 20, 99, None, None, "orphan", None),
        (3, 30, 31, 0.0, "user", "cycle", None), (3, 31, 30, 0.0, "user", "cycle", None), (4, 40, None, 1.0, "assistant", "<|start|>", None),
    ]
    df = spark.createDataFrame(rows, TREE)
    paths = {(r.tree, r.branch): r.p for r in chat.branch_paths(df, 2).groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("p")).collect()}
    assert {k: [x.node for x in v] for k, v in paths.items()} == {(1, 1): [10, 12, 13], (1, 2): [10, 11, 14], (2, 1): [20], (4, 1): [40]}
    out = chat.format_trees(df, 2)
    got = {(r.tree, r.branch): (r.turns, r.under) for r in out.select("tree", "branch", chat.parse_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    assert [tuple(t) for t in got[1, 2][0]] == [("user", "q"), ("assistant", "good <|end|> &lt; &amp;"), ("user", "neg")]
    assert got[1, 2][1] == "good <|end|> &lt; &amp;" and got[1, 1][1] == "bad" and got[4, 1][1] == "<|start|>" and got[2, 1][1] == ""
    assert chat.format_trees(df.limit(0)).count() == 0


def test_linear_chain_and_ties(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(133)] + [(None, 0, "user", "x"), (None, None, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.tree: r.t for r in chat.format_trees(chat.linear_trees(df)).select("tree", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert [t.text for t in got[1]] == [f"t{i}" for i in range(133)]
    assert [t.text for t in got[2]] == ["a", "a", "b"] and [t.text for t in got[None]] == ["x", ""]
