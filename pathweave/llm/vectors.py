"""Rows of vectors that can be compared, and classes of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def split_usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, v`` of the vectors that can be compared, as they are stored, and of the rest.

    A row without an id can't be told from others and isn't compared.
    """
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if d.schema["v"].dataType.simpleString() != "array<float>":
        d = d.withColumn("v", F.col("v").cast("array<double>"))
    ok = usable(F.col("v")) & F.col("id").isNotNull()
    d = d.withColumn("ok", ok)
    return d.filter("ok").select("id", "v"), d.filter(~F.col("ok")).select("id", "v")


def lengths(classes: DataFrame) -> list[tuple[int, int]]:
    """Length and number of the vectors ``v`` of each length, the most frequent first; a row each, of which there are few."""
    found = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()
    return [(r["n"], r["count"]) for r in found]


def dtype_of(classes: DataFrame) -> str:
    """The numpy type in which the vectors ``v`` are stored."""
    return "<f4" if classes.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
