"""The pipeline's stages against plain versions, with nulls, repeats, ties and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_filters import brute_hits
from test_jaccard import brute as brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, mix int, shard string, toxic int, severity double, grade string, node long"
ITEMS = [(0, "what is the name of the river that runs past the old mill near our town"), (1, "seven green birds sat upon the long wall and sang for the whole of the day"), (2, None)]


def documents():
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in "ba de fi go ku la me ni po ra".split() for b in "ro sa ti vu wen xa yol zim".split()]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    texts = [prose(rng.randint(3, 60)) for _ in range(120)]
    texts += [f"{prose(30)} scum scum {prose(4)}" for _ in range(14)] + [f"{prose(10)}. {ITEMS[i % 2][1]} {prose(10)}" for i in range(6)]
    texts += [t + " end" for t in texts[:120:9] if len(t.split()) > 40] + texts[1:30:7] + ["", None, " \n", "word " * 30000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "h", 1, "s", 2, 0.5, "g", 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[0], None, None, None, None, None, None, None, None, None, None), (None, None, *rows[0][2:])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 0, int(120 <= i < 134)) for i in range(0, 134)]
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def listed(df):
    return sorted(map(str, df.collect()))


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(5)
    columns = docs.columns
    kept = corpus_pipeline.written(corpus_pipeline.toxicity_stage(spark, docs, folder), "toxicity")
    model = toxicity.toxicity_model(docs.drop("toxic", "severity", "grade"), spark.read.parquet(f"{folder}/labels.parquet"))

    def severity(text):
        p = model.probabilities(model.scores(toxicity.features(pa.array([text], pa.string()), model.vocabulary)))[0]
        return sum(k * x for k, x in enumerate(p))

    assert kept.columns == columns and listed(kept) == sorted(str(r) for r in docs.collect() if severity(r.text) < 0.4)
    assert not any(120 <= (r.doc_id or 0) < 134 for r in kept.collect()) and kept.count() == docs.count() - 14

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    apart = corpus_pipeline.written(corpus_pipeline.near_duplicate_stage(spark, kept, folder), "near")
    classes = {i: c for i, c, _ in brute_classes(rows)}
    assert apart.columns == columns
    assert listed(apart) == sorted(str(r) for r in kept.collect() if r.doc_id is None or str(r.doc_id) == classes[str(r.doc_id)] or not (r.text or "").strip())

    clean = corpus_pipeline.written(corpus_pipeline.decontamination_stage(spark, apart, folder), "clean")
    items = [i for i in ITEMS if i[1]]
    assert clean.columns == columns and listed(clean) == sorted(str(r) for r in apart.collect() if not brute_hits(r.text or "", items))
    assert clean.count() < apart.count()

    mixed = corpus_pipeline.written(corpus_pipeline.mixing_stage(spark, clean, folder), "mixed")
    want = Counter()
    for r in mixing.drawn_counts(clean.drop("mix", "shard")).collect():
        want[r.doc_id] += r.copies
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == +want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, texts = 0, {}
    for r in mixed.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in corpus_pipeline.token_stage(spark, mixed, folder).orderBy("start").collect():
        ids = [*library.encode(texts[r.doc_id].pop() or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not any(texts.values())


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
