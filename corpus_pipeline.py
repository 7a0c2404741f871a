"""From raw documents to a training mix: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stage, table
from textloom.llm.decontam import hit_documents, words
from textloom.llm.linededup import without_boilerplate
from textloom.llm.mixing import mixed
from textloom.llm.neardup import near_components
from textloom.llm.quality import good_documents

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is in ids, by a merge join at every size; rows without a doc_id stay."""
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(spark, docs, sf_dir).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that had nothing else go."""
    out = without_boilerplate(docs)
    text = F.when(F.col("n_gone") > 0, F.concat_ws("\n", "kept")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    out = out.withColumn("row", row.withField("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else row)
    blank = F.trim(F.translate("row.text", "\t\r\n\x0b\x0c", "     ")) == ""
    return out.filter((F.col("n_gone") == 0) | ~blank).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates."""
    return without(docs, near_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT).filter("doc_id != component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    return without(docs, hit_documents(text, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document, and its source's target."""
    return mixed(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: the quality classifier is trained, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
