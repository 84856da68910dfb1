"""The corpus queries: thin contracts over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import decontaminate, language, lmscore, neardup, packing, phrases, sharding, substring, topk, toxicity, treaps, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.summary(substring.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judge(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"), every=50)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages")).drop("uri", "payload")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(spark, table(spark, sf_dir, "documents"), neardup.PERCENT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.summary(sharding.shard(spark, table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(spark, table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring": op1_substring,
    "op2_language": op2_language,
    "op3_topk": op3_topk,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_url_filters": op6_url_filters,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_lm": op11_lm,
    "op12_search": op12_search,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op1_substring": substring.ORACLE,
    "op3_topk": topk.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_url_filters": urlfilter.oracle(),
    "op7_minhash": neardup.ORACLE,
    "op12_search": treaps.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
