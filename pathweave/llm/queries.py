"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import alignment, bpe, chat, hnsw, idfiles, language, mixing, orderminhash, pii, quantisation, search, secrets, warc
from pathweave.llm.spans import count_of, listed
from pathweave.llm.sql import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = language.identify(table(spark, sf_dir, "documents"))
    held_out = ~language.in_training(F.col("doc_id"))
    return d.select("doc_id", held_out.alias("held_out"), F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantisation.links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_history(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, path: str = BYTE_RANKS) -> DataFrame:
    d = bpe.round_trip(docs, path)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orderminhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.archive(table(spark, sf_dir, "pages")))
    whole = F.col("record_type") == "response"
    # what has been read back counts; a revisit states the length and digest of its response
    return records.select(
        F.col("id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.write_and_read(table(spark, sf_dir, "documents"), WORD_TOKENIZER).withColumnRenamed("id", "doc_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.draw(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.sha2(pii.sanitized(F.col("content"), F.col("spans")), 256).alias("sanitized_sha256"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns)).withColumn("text", said)
    nodes = chat.chain(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    return chat.digests(chat.formatted(nodes, chat.paths(nodes))).withColumnRenamed("tag", "conv_id")


ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *ALIGNED).withColumnRenamed("id", "doc_id")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_itq_near_dedup, op3_secret_scan, op4_byte_bpe, op5_order_minhash, op6_warc, op7_id_files, op8_source_mixing, op9_hnsw, op10_pii_sanitisation, op11_chat_format, op12_token_alignment, op13_block_max_search)}
