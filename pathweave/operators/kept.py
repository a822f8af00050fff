"""Answers that are kept in a table, so that only questions it hasn't seen are worked out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import write_and_reread


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def version_folder(version: str) -> str:
    """The folder of a version, whatever its text holds."""
    return "version=" + hashlib.sha256(version.encode()).hexdigest()[:32]


def forget_others(spark: SparkSession, path: str, version: str) -> None:
    """Remove what is kept for other versions than this one."""
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(_path(spark, path)):
        for found in fs.listStatus(_path(spark, path)):
            name = found.getPath().getName()
            if name.startswith("version=") and name != version_folder(version):
                fs.delete(found.getPath(), True)


def answered(path: str, version: str, asked: DataFrame, keys: Sequence[str], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``asked`` with the answers to its ``keys``: those that the table under ``path`` has for this ``version``, and for
    the others what ``solve(distinct keys)`` gives, a row with the keys and the answer's columns for each, which is
    appended to the table first. With a new version the table is emptied. ``kept`` tells whether an answer
    was there already.

    Keys are compared as values, null being one. A key that two runs have answered at the same time counts once.
    """
    spark, folder = asked.sparkSession, f"{path}/{version_folder(version)}"
    forget_others(spark, path, version)
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    questions = asked.select(*keys).distinct()
    known = None
    if fs.exists(_path(spark, f"{folder}/_SUCCESS")):
        known = spark.read.parquet(folder)
        # a list of files now: what is appended below must not show in it
        known = known.groupBy(*keys).agg(F.first(F.struct(*[c for c in known.columns if c not in keys])).alias("answer"))
        met = known.join(questions.withColumnsRenamed({k: f"q_{k}" for k in keys}), [known[k].eqNullSafe(F.col(f"q_{k}")) for k in keys], "left_semi")
        known = write_and_reread(met, "kept-answers")
        questions = questions.join(known, same(questions, known), "left_anti")
    questions = write_and_reread(questions, "kept-questions")
    found = known.withColumn("kept", F.lit(True)) if known is not None else None
    if not questions.isEmpty():
        solved = solve(questions)
        new = write_and_reread(solved.select(*keys, *[c for c in solved.columns if c not in keys]), "kept-new")
        new.write.mode("append").parquet(folder)
        new = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("answer"), F.lit(False).alias("kept"))
        found = new if found is None else found.unionByName(new)
    if found is None:  # nothing was asked and nothing is kept
        found = solve(questions)
        found = found.select(*keys, F.struct(*[c for c in found.columns if c not in keys]).alias("answer"), F.lit(False).alias("kept"))
    right = found.withColumnsRenamed({k: f"k_{k}" for k in keys})
    return asked.join(right, [asked[k].eqNullSafe(right[f"k_{k}"]) for k in keys], "left").select(*[asked[c] for c in asked.columns], "answer.*", "kept")
