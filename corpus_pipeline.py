"""A corpus pipeline of five of the operations in ``pathweave.llm``, stage after stage.

Each stage is a function of the session, the documents its predecessor kept, and the folder of
tables. ``run`` applies them to ``documents``, each result written as Parquet in the shared
folder and read again by the next.

1. language: documents without letters, or with less likeness to any learned language than two
   random texts have (a cosine below 0.03), go; where no document is labelled, only the former;
2. near_dedup: of each group of near-duplicates the one with the smallest id stays;
3. secrets: secrets are replaced by their kind in brackets, all documents stay;
4. mix: documents are repeated or left out so that the sources meet their target weights;
5. encode: a row per remaining document (a repeated one comes as often) with its byte-level BPE
   ids' number and digest, and the digest of the bytes they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import language, mixing, orderminhash, secrets
from pathweave.llm.queries import bpe_digests
from pathweave.session import write_and_reread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LIKENESS = 0.03


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language.fit(docs)
    if not profiles[0]:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    found = docs.select(*COLUMNS).withColumn("prediction", language.predictor(*profiles)(F.col("text")))
    return found.filter((F.col("prediction.lang") != "und") & (F.col("prediction.score") >= MIN_LIKENESS)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return orderminhash.keep_one(docs, COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Trained profiles, alignment and merges are beyond SQL; the tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_reread(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
