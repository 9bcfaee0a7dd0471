"""The training-data operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import archive, chat, decontaminate, licenses, merkle, mixing, quality, resample, secrets, sharding, simhash, suffixes, tokens
from palisade.llm.common import table
from palisade.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicated(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "mix_copy", "mix_key", F.octet_length("text").cast("long").alias("n_bytes"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive.verified(archive.read_records(archive.rebuild_records(*archive.archive_pages(table(spark, sf_dir, "pages")))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's operator over conversations whose turns quote earlier ones at one and two levels."""
    return chat.link_quotations(chat.quoted_view(table(spark, sf_dir, "conversations")))


def built_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of quoted_conversations, each as one text in the order of replies."""
    return chat.build_conversations(quoted_conversations(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_secrets": op1_secrets,
        "op2_simhash": op2_simhash,
        "op3_tokens": op3_tokens,
        "op4_mixing": op4_mixing,
        "op5_warc": op5_warc,
        "op6_suffixes": op6_suffixes,
        "op7_quotations": op7_quotations,
        "quoted_conversations": quoted_conversations,
        "built_conversations": built_conversations,
        "op8_quality": op8_quality,
        "op9_decontamination": op9_decontamination,
        "op10_licenses": op10_licenses,
        "op11_merkle": op11_merkle,
        "op12_shards": op12_shards,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the result; the other queries are held against brute force in the tests."""
    return dict(ORACLES)
