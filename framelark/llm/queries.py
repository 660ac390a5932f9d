"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import bpe_counts, chat_format, decontaminate, main_text, mixing, near_dedup, oracles, periodic_runs, pitman_yor, quality_rules, repeats, site_bayes, vector_codes, warc
from framelark.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_counts.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_decontamination", oracles.DECONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_mixing", mixing.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: whole documents, texts included, replicated and shuffled globally."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_warc", warc.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.records(warc.read_warc(spark, manifest))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


@query("op1_near_dedup", oracles.NEAR_DEDUP)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup", oracles.SUBSTRING_DEDUP)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))))


@query("op12_vector_codes", vector_codes.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


@query("op11_chat_format", chat_format.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.blocks(chat_format.with_control_strings(table(spark, sf_dir, "conversations"))))
