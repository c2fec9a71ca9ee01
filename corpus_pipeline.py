"""The corpus pipeline: documents to token files, in five stages.

Every stage works on all rows its predecessor kept; all but the last return the columns of
``documents``, whatever their names. ``ORACLE_SQL`` is None: ordinal regression, similarity classes
and token ids are not expressible in SQL, so tests hold every stage against a plain version of it on
a small table (``tests/llm/test_pipeline.py``).

Rows with a null id stay where an id is needed to tell them from others; null texts are empty: not
toxic, in no class with others, without benchmark items, of size 0 (so that mixing takes them only
with their block) and without tokens. Repeated rows are judged alike: equal ids all stay or all go.
An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, mixing, token_files, toxicity
from quire.llm.store import written
from quire.plans.registry import table


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names renamed, and the expressions that give the columns back."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose expected severity reaches the operator's threshold."""
    docs, back = _aside(docs, {"severity", "grade", "toxic"})
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("not toxic").select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every class of near duplicates."""
    return jaccard.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    docs, back = _aside(docs, {"hits"})
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), literal=True).select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to their target weights; documents are repeated or left out."""
    docs, back = _aside(docs, {"mix", "shard"})
    rows, _ = mixing.mix(docs)
    return mixing.mixed_rows(rows).select(*back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
