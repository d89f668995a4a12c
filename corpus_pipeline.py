"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands the next stage what it
reads back. All but the last return the columns of ``documents``.

Defined results: an empty table passes through every stage; null and empty
texts have no perplexity and leave at the quality stage; repeated rows are
judged alike, and of equal texts one id stays. A row with a null id is judged
by its own text where quality and contamination are concerned; deduplication,
which names what it drops by id, leaves it. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from assay.llm.common import stored, without
from assay.llm.queries import table, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects.

    A row is known by its id and a hash of its text, so that one with a null id,
    or whose id another row shares, leaves by its own text.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    marked = docs.select("doc_id", "text", "lang", F.struct("doc_id", F.xxhash64("text").alias("text")).alias("judged"))
    bad = quality.classify(marked, trusted, carry=["judged"]).where("not kept").select("row.judged")
    return without(docs.withColumn(JUDGED, F.struct("doc_id", F.xxhash64("text").alias("text"))), bad.withColumnRenamed("judged", JUDGED), JUDGED).drop(JUDGED)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one document stays."""
    return without(docs, exact_dedup.exact_dedup(docs).where("not kept"), "doc_id")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (0.8 of all 5-word shingles), the smallest id stays."""
    return without(docs, near_dedup.near_duplicates(docs, percent=80, width=5).where("not kept"), "doc_id")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents.

    Whole rows are judged, so that one with a null id, or whose id another row
    shares, leaves by its own text.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    judged = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), "row")
    return judged.where("not contaminated").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return stored(bpe.digests(bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"))), "tokens")


#: Column that no table of documents has.
JUDGED = "judged row"

STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("bpe", tokens),
]

#: The quality model and the near-duplicate components are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
