"""Mixing sources to target weights by capped water-filling.

Every source gets a target in words: its share, by weight, of a total; no target exceeds
``max_epochs`` times the source's size, and what a clamped source can't take is shared out
again among the others by weight. The targets of this repeated resharing are
``min(cap, level * weight)`` for one water level, so the level comes from running sums over
the sources in the order in which they reach their caps, without a loop.

Documents are then drawn: every document of a source is taken ``floor(target / size)`` times
whole, and the rest of the target goes to documents in a seeded order, each once more until
the words are used up. The last of these is taken in part, so a source meets its target.
The seeded order is dealt into hash buckets, whose sums place each bucket in its source's
order; a source that holds a third of all rows is thus many small groups.

Only DataFrame functions are used, and no text is shuffled.

Cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of
its own, last in the order; equal rows get equal chances, and the words they take together
are the same in every run; an empty table gives an empty result; other columns are passed
through by ``draw`` whatever their names, as they stay in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(key: Column, seed: int) -> Column:
    """A hex digest by which rows are put in an order that depends on the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), total_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, a row per source -> the same with weight, cap, target.

    Weights repeat over the sources by code point, null last. The table has a row per source
    only, so its order needs one small partition.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = W.partitionBy()
    fills = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(total_share)))
    # level if this source and all that fill later are not clamped
    s = s.withColumn("cap_before", F.sum("cap").over(fills) - F.col("cap"))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(fills) + F.col("weight"))
    s = s.withColumn("level_here", F.greatest(F.col("total") - F.col("cap_before"), F.lit(0.0)) / F.col("weight_left"))
    open_ = F.col("level_here") * F.col("weight") <= F.col("cap")
    # the first source in filling order that stays below its cap sets the level
    s = s.withColumn("level", F.min_by(F.col("level_here"), F.when(open_, F.col("cap_before"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "weight", "cap", target.alias("target"))


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3.0, 1.0, 2.0), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 1, bucket_digits: int = 3, whole_documents: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """A row per document: ``id, size, source, source_size, target, repeats, part_words, taken, kept``.

    ``repeats`` whole copies and ``part_words`` words of one more make ``taken`` words. With
    ``whole_documents`` a partial copy is rounded to a whole one or none. ``keep`` names
    columns that are passed through in the struct ``kept``.
    """
    d = docs.select(
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.col(source_col).alias("source"),
        (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("kept"),
    )
    d = d.withColumn("order_key", seeded_order(F.col("id"), seed))
    d = d.withColumn("bucket", F.substring("order_key", 1, bucket_digits))

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))

    narrow = d.select("source", "bucket", "size")
    sources = bucketed(narrow).groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sources, weights, total_share, max_epochs)
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = bucketed(narrow).withColumn("bucket_start", F.sum("bucket_size").over(ahead) - F.col("bucket_size"))
    t, b = targets.alias("t"), starts.alias("b")
    places = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("p_source"), F.col("b.bucket").alias("p_bucket"), "bucket_start", "source_size", "target"
    )
    d = d.join(places, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket"))).drop("p_source", "p_bucket")
    within = W.partitionBy("source", "bucket").orderBy("order_key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("words_before", F.col("bucket_start") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("whole", whole)
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    d = d.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("words_before"))))
    if whole_documents:
        d = d.withColumn("rest", F.when((F.col("rest") * 2 >= F.col("size")) & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0).cast("long")))
    full = (F.col("rest") == F.col("size")) & (F.col("size") > 0)
    return d.select(
        "id", "size", "source", "source_size", "target",
        (F.col("whole") + full.cast("long")).alias("repeats"),
        F.when(full, F.lit(0).cast("long")).otherwise(F.col("rest")).alias("part_words"),
        (F.col("whole") * F.col("size") + F.col("rest")).alias("taken"),
        "kept",
    )


def mix(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it whole."""
    taken = draw(docs, whole_documents=True, keep=list(columns), **options).filter(F.col("repeats") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("kept.*")
