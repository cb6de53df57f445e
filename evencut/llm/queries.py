"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evencut.llm import decontamination, html_text, language, mixing, oracle, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, toxicity
from evencut.llm.common import new_path, table


def op1_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, f = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(f"{f}.words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(f"{f}.items"), ",")
    return found.select(
        "doc_id", F.col(f"{f}.n_words").alias("n_words"), hit.alias("n_hit"), F.size(f"{f}.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op2_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark, sf_dir):
    """Each document's shard after several arrivals, each with a compaction."""
    return sharding.store_and_locate(spark, table(spark, sf_dir, "documents"), new_path(spark, "shards"))


def op6_quality_rules(spark, sf_dir):
    j = quality_rules.judge(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "n_lines")


def op7_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("spans")


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")


_ALL = (
    op1_decontamination, op2_toxicity, op3_simhash, op4_quality_classifier, op5_sharding, op6_quality_rules,
    op7_html_text, op8_language_id, op9_suffix_dedup, op10_mixing,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = oracle.sqls()
