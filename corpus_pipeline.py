"""A training corpus from ``documents``: languages, rules, one of each group of near copies, a mix, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Rows without an id are judged by their text alone and come
last in their group in the join stage, where of rows that repeat id and text one
stays and rows that share an id alone are documents of their own.
"""

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import langid, mixing, ngramjoin, packing, rules
from tidelog.sources.shared import SharedTables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which no language is likelier than 0.4, go."""
    return langid.identified(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat too much go."""
    return rules.clean(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return ngramjoin.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_join", ngram_join), ("mix", mix), ("pack", pack)]

#: The stages are not all SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = SharedTables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
