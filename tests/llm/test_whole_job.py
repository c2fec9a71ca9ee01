"""Cases that a cut of the work once left out."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quire.llm import decontaminate, queries, toxicity

VOCAB = [f"{a}{b}" for a in "ba de fi go ku la me ni".split() for b in "ro sa ti vu wen xa yol zim".split()]


def test_few_toxic_labels_are_learnt(spark):
    rng = random.Random(6)
    said = lambda bad: " ".join([rng.choice(VOCAB) for _ in range(30)] + bad)
    docs = [(i, said(["scum"] if i < 5 else ["Dreck"] if i < 9 else [])) for i in range(90)] + [(i, said(["scum"] if i < 110 else [])) for i in range(100, 140)]
    labels = [(i, int(i < 9)) for i in range(90)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(df, toxicity.toxicity_model(df, marks)).collect()}
    assert all(got[i] for i in range(9)) and not any(got[i] for i in range(9, 90))
    assert sum(got[i] for i in range(100, 110)) >= 8 and not any(got[i] for i in range(110, 140))


def test_labelled_toxic_texts_of_every_language_are_found(spark):
    for size, least in (("sf0.001", 1.0), ("sf0.01", 0.75)):
        d = f"/root/testdata/{size}"
        docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
        scored = toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, labels)).join(labels.withColumnRenamed("toxic", "mark"), "doc_id")
        rows = scored.where("text is not null and mark is not null").select("lang", "toxic", "mark").collect()
        for lang in ("en", "de", "fr", "es"):
            marked = [r.toxic for r in rows if r.lang == lang and r.mark]
            assert not marked or np.mean(marked) >= least
        assert np.mean([r.toxic for r in rows if not r.mark]) < 0.02


def test_rare_grades_stay_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 60)
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(1000).selectExpr("id AS doc_id", "CAST(id % 100 = 0 AS INT) AS toxic")
    rows, grades, shares = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")
    assert rows.n_rows == 60 and grades.sum() == 10
    assert np.isclose(shares[grades == 0].sum(), 990) and np.isclose(shares[grades == 1].sum(), 10)
    assert toxicity._quotas({0: 5, 1: 2, 2: 100}, 30) == {1: 2, 0: 5, 2: 23}
    assert toxicity.fit_ordinal(toxicity.features(pa.array([], pa.string())), np.zeros(0, np.int64)).cuts.tolist() == [10.0]


def test_literal_passages_count_whatever_their_slots(spark, tmp_path):
    rng = random.Random(8)
    asked = "A train leaves Boston at 40 km per hour and Anna rides 3 hours before she meets Paul near the old bridge"
    few = "Every day Maria took 3 apples and then Maria gave 4 pears to the men who came by with Peter"
    said = lambda t: " ".join(rng.choices(VOCAB, k=20)) + f". {t}. " + " ".join(rng.choices(VOCAB, k=9))
    docs = [(0, said(asked.replace("Paul", "Anna"))), (1, said(asked)), (2, said(few.replace("Maria took 3", "Clara took 5").replace("4 pears", "5 pears"))), (3, said("")), (4, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, asked), (1, few)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: (r["items"], r.covered) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1} and found[1] == ("0", 1.0) and found[0][0] == "0" and found[0][1] < 1
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination_stage(spark, read, str(tmp_path)).collect()) == [2, 3, 4]
    assert decontaminate.decontaminate(read, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 4
