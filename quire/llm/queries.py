"""Registered queries of the corpus operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, exact_dedup, jaccard, mixing, pseudo_likelihood, secrets, substring_dedup, token_files, toxicity
from quire.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add(
    "op3_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
               FROM documents),
         g AS (SELECT text_sha256, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
    """,
)
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@REGISTRY.add(
    "op4_chat_formatting",
    r"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
         e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'),
                      '[INST]', '&lsb;INST]'), '[/INST]', '&lsb;/INST]') AS safe FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(role) + length(safe) + length('<|start|><|text|><|end|>')) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], turns.schema))
    out = chat.format_trees(chat.linear_trees(turns)).withColumnRenamed("tree", "conv_id")
    out = out.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("under", chat.loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@REGISTRY.add("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = secrets.random_samples(spark).unionByName(secrets.identifier_samples(docs))
    return secrets.secret_digest(secrets.scan_secrets(docs, samples))


@REGISTRY.add("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@REGISTRY.add("op1_mix_sources")
def op1_mix_sources(spark, sf_dir):
    return mixing.drawn_counts(table(spark, sf_dir, "documents"))


@REGISTRY.add("op5_decontaminate")
def op5_decontaminate(spark, sf_dir):
    """Contaminated documents with the benchmark items that they hold."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), literal=True)
    items = F.array_join(F.transform("hits", lambda h: h["item"].cast("string")), ",")
    most = F.array_max(F.transform("hits", lambda h: h["covered"] / h["item_words"]))
    return found.where(F.size("hits") > 0).select("doc_id", F.lit(True).alias("contaminated"), items.alias("items"), F.round(most, 6).alias("covered"))


@REGISTRY.add("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.round("severity", 9).alias("severity"), "grade", "toxic")


@REGISTRY.add("op2_token_files")
def op2_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@REGISTRY.add("op10_jaccard_join")
def op10_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@REGISTRY.add("op6_lm_score")
def op6_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))
    return scored.select("doc_id", "n_tokens", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("mean", 6).alias("mean"))
