"""One query per operator over its whole table, and SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, html, langid, mixing, neardup_vectors, ngramjoin, packing, quality, rules, urlfilter


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as c(conv_id, turn, role, text)")
    return chat.digests(chat.formatted(turns.unionByName(planted)))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    counts = mixing.mixed_counts(_t(spark, d, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    found = langid.predicted(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_vector_neardup(spark: SparkSession, d: str) -> DataFrame:
    return neardup_vectors.linked(_t(spark, d, "embeddings"))


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_t(spark, d, "documents"))


def op6_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngramjoin.grouped(_t(spark, d, "documents"))


def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    found = quality.scored(docs, quality.fit(docs, _t(spark, d, "labels")), ["doc_id"])
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.judged(_t(spark, d, "documents"), ["doc_id"])


def op9_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html.extracted(_t(spark, d, "pages"), ["page_id", "url"])


def op10_url_filters(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_mixing, op3_language_id, op4_vector_neardup, op5_packing, op6_ngram_join, op7_quality_classifier, op8_quality_rules,
        op9_html_extraction, op10_url_filters,
    )
}

ORACLE_SQL = {"op1_chat_formatting": chat.ORACLE, "op2_mixing": mixing.ORACLE, "op10_url_filters": urlfilter.ORACLE}
