"""The registered queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm._spark import checkpointed, new_folder, read_table, remove_folder

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.line_dedup import drop_recurring_lines

    d = drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.near_vectors import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.media import decode_media, encode_media

    d = decode_media(encode_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    tail = F.expr("substring(pixels, greatest(length(pixels) - 15, 1), 16)")
    return d.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
                    F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.repeats import remove_repeats

    held: list[DataFrame] = []
    out = checkpointed(remove_repeats(read_table(spark, sf_dir, "documents"), held=held).drop("kept"))
    for df in held:
        df.unpersist()
    return out


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.jaccard_join import near_documents

    return near_documents(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.language_model import fit, release, scored

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.expr(HELD_OUT) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    s = scored(docs, model, keep_text=False)
    out = checkpointed(s.select("doc_id", held_out.alias("held_out"), F.col("_lm_tokens").alias("n_tokens"), F.col("_lm_known").alias("n_known"), F.col("_lm_train_tokens").alias("train_tokens"), F.col("_lm_base").alias("base_score"), F.col("_lm_score").alias("score")))
    release(model)
    return out


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.quality import fit, scored

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return s.select("doc_id", F.coalesce(F.expr(HELD_OUT) == 0, F.lit(False)).alias("held_out"), F.col("_qc_score").alias("score"), (F.col("_qc_score") >= 0.3).cast("int").alias("predicted"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.token_count import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.token_ids import read_token_ids, write_token_ids

    folder = new_folder(spark, "token-ids")
    write_token_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    out = checkpointed(read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    remove_folder(spark, folder)
    return out


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.spelling import variants

    return variants(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaframe.llm.fill_in_middle import digests, pieces

    return digests(pieces(read_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(importlib.import_module("mediaframe.llm.sql").ORACLES)
