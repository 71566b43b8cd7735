"""Corpus pipeline: five stages over ``documents``, each one of the library's text operators.

A stage takes (spark, docs, folder) and returns a DataFrame. All but the last return the columns of
documents; ``run`` writes every stage's result as Parquet below the shared checkpoint folder and hands the
rows read back to the next one. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, probminhash, quality_cnn, substring_dedup
from tidemark.llm.queries import quality_network
from tidemark.llm.stage import stored
from tidemark.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, taught by the labels, gives 0.5 or more."""
    return quality_cnn.score(docs.select(*COLUMNS), quality_network(spark, sf_dir)).where("score >= 0.5").select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; rows without an id stay."""
    classes = probminhash.near_duplicates(docs).where("doc_id = class_id").select("doc_id", F.lit(1).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("rows"))
    joined = docs.join(classes, "doc_id")
    # an id that stands on several rows is one document: its first row in text order stays
    single = joined.where(F.col("rows") == 1)
    repeated = joined.where(F.col("rows") > 1).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return single.select(*COLUMNS).unionByName(repeated.select(*COLUMNS)).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 50 words or more that stand in an earlier one; emptied documents go."""
    parsed = substring_dedup.remove_repeats(docs.select(*COLUMNS), layout=True)
    left = parsed.where("n_removed < n_words or n_removed = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "version").distinct()
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("version")).alias("d")
    return named.join(found.alias("f"), F.expr("d.version = f.version and d.doc_id <=> f.doc_id"), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of a long one, in training sequences of several lengths."""
    return packing.pack(docs, packing.word_length())


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores and signatures have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
