"""A training-data pipeline of five stages over documents: quality, recurring lines, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Nulls, ties, repeated rows and empty tables are handled as
the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import jaccard_join, line_dedup, mixing, packing, quality
from mediaframe.llm._spark import checkpointed, new_folder, read_table, remove_folder, row_hash


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled ones among them."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("_qc_score >= 0.3").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines of one token and more go from all documents but each template's first (so that of copies one stays whole)."""
    return line_dedup.drop_recurring_lines(docs, short=True, keep_first=True).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, the one with the smallest id (null last, then by its hash). Rows are told apart by their hash, as ids can repeat or be null; equal rows are interchangeable."""
    rows = docs.withColumn("_row", row_hash(docs))
    near = jaccard_join.near_documents(rows.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0")
    near = checkpointed(near.groupBy(F.col("doc_id").alias("_row"), F.col("component_id").alias("c")).agg(F.count(F.lit(1)).alias("n")))
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("id")).dropDuplicates(["_row"])
    # written, so that both sides of the join below are dealt anew and a component of very many rows is split
    first = checkpointed(near.join(ids, "_row").groupBy("c").agg(F.min("id")["_row"].alias("first")))
    gone = checkpointed(near.join(first, "c").where("_row <> first or n > 1").select("_row", (F.col("_row") == F.col("first")).alias("again")))
    once = rows.join(gone.where("again"), "_row", "left_semi").dropDuplicates(["_row"])
    return rows.join(gone, "_row", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as the mix takes them: repeated, cut to their chosen blocks, or gone."""
    return mixing.mixed_texts(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("packing", pack_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents. What lies between two stages is written below spark.checkpoint.dir and deleted when the next is written; the last stage's rows are checkpointed there."""
    docs, folder = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before, folder = folder, new_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
    out = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    remove_folder(spark, folder)
    return out
