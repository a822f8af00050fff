"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds a row
per (blob, rule, rule version) that has been scanned, with its findings. A scan hashes the
versions it is given, keeps one copy of each blob, leaves out the pairs that the ledger has,
runs the rules on the rest, appends to the ledger, and joins the findings back to every path
that holds the blob. A copied or unchanged text is scanned once; a new version of one rule
scans for that rule only.

The ledger is Parquet in a folder, a sub-folder per run, so a failed run leaves no half of
itself that a later one would take for scanned: a run counts once Spark has committed it.

Main path: DataFrame functions only. A group of copies is reduced on the map side to one
text per task before anything is shuffled.

Cases: null text is scanned as empty; null paths and versions are carried as they are; equal
rows each get their findings; an empty table gives an empty result; only the three named
columns are read, so others may be called anything; texts of any length are scanned whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.spans import SPAN, cut_out, find, merged
from pathweave.session import scratch_path


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    valid: Callable[[Column], Column] | None = None


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    # a shorter run holds no longer match, so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Spans that the ledger adds to the base ones.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
RULES = BASE + ADDED


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blobs(blob, content, due)`` -> ``blob, due, spans``; due names the rules to run."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("due", f"{r.kind}:{r.version}"), find(F.col("content"), r.pattern, r.kind, i, r.valid)).otherwise(none) for i, r in enumerate(rules)]
    return blobs.select("blob", "due", merged(found).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``blob, due, spans``: a row per blob and run, with the rules that the run applied to it."""
    return spark.read.schema(f"blob string, due array<string>, spans array<{SPAN}>").parquet(f"{ledger}/run-*")


def scan_history(versions: DataFrame, ledger: str | None = None, *, path_col: str = "doc_id", text_col: str = "text", version_cols: Sequence[str] = (), rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str]:
    """Scan all ``versions``; returns a row per version with ``path``, ``blob`` and ``spans``, and the ledger's path.

    Without ``ledger`` a new one is begun in the shared folder.
    """
    spark = versions.sparkSession
    v = versions.select(F.col(path_col).alias("path"), *version_cols, F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    blobs = v.select(blob_id(F.col("content")).alias("blob"), "content").groupBy("blob").agg(F.first("content").alias("content"))
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    if ledger is None:
        ledger = scratch_path(spark, "secret-ledger")
        blobs = blobs.withColumn("due", current)
    else:
        known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("due"))).alias("done"))
        due = F.array_except(current, F.coalesce("done", F.array().cast("array<string>")))
        blobs = blobs.join(known, "blob", "left").withColumn("due", due).filter(F.size("due") > 0).drop("done")
    scan_blobs(blobs, rules).write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")
    # a span of an older version of its rule no longer counts
    counts = F.filter("spans", lambda s: F.exists(F.array_intersect(F.col("due"), current), lambda d: F.substring_index(d, ":", 1) == s["kind"]))
    findings = (
        read_ledger(spark, ledger)
        .select("blob", counts.alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    hashed = v.select("path", *version_cols, blob_id(F.col("content")).alias("blob"))
    joined = hashed.join(findings, "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))), ledger


def redact(docs: DataFrame, columns: Sequence[str], *, ledger: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by its kind in brackets; ``columns`` are returned."""
    carried = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("content"))
    found, _ = scan_history(carried, ledger, path_col="row", text_col="content")
    clean = cut_out(F.col("path")[text_col], F.col("spans"), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    return found.select(*[clean.alias(c) if c == text_col else F.col("path")[c].alias(c) for c in columns])
