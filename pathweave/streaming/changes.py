"""Streams of changes: one commit per batch, last write wins, and closures that come and go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pathweave.operators.report import latest_by_key

CHANGE = "id string, kind string, seq bigint, deleted boolean, body string"


def changes(spark: SparkSession, folder: str, schema: str = CHANGE, **options: str) -> DataFrame:
    """A stream over JSON files of changes as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.json(folder)


def apply_batch(state: DataFrame | None, batch: DataFrame, keys: tuple[str, ...] = ("id",), order: str = "seq") -> DataFrame:
    """The state after a batch: of each key the row with the highest number, deleted keys included
    so that a late older change can't bring one back."""
    every = batch if state is None else state.unionByName(batch)
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*every.columns), order).alias("row"))
    return best.select("row.*")


#: Parts of a state by the hash of its keys.
PARTS = 64


def upsert_stream(stream: DataFrame, state_path: str, checkpoint: str, notify: Callable[[int, DataFrame], None] | None = None, *, keys: tuple[str, ...] = ("id",), order: str = "seq", parts: int = PARTS):
    """Fold a stream of changes into a table: however many changes a batch has, it is one commit and
    one notification, and an empty one is none.

    The state is dealt into ``parts`` by the hash of the keys, a number that stays with the state. Batch n writes those
    parts that it touches, anew, under ``batch=n``, before the stream's checkpoint moves on; so a batch
    that is run again reads the same older parts and writes the same again. Of each part the last version and the
    one before are kept.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        placed = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in placed.select("part").distinct().collect()]  # ``parts`` at most
        old = [paths[-1] for part, paths in _versions(spark, state_path, number).items() if part in touched]
        state = spark.read.parquet(*old) if old else None
        new = apply_batch(state, batch, keys, order).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state_path}/batch={number}")
        for paths in _versions(spark, state_path).values():
            for path in paths[:-2]:
                _files(spark, path).delete(_path(spark, path), True)
        if notify is not None:
            notify(number, batch)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, state_path: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each part's versions, oldest first, of finished batches before the given one."""
    fs, found = _files(spark, state_path), {}
    inside = lambda path, kind: [(int(s.getPath().getName().split("=")[1]), f"{path}/{s.getPath().getName()}") for s in fs.listStatus(_path(spark, path)) if s.getPath().getName().startswith(f"{kind}=")]
    if not fs.exists(_path(spark, state_path)):
        return {}
    for number, path in sorted(inside(state_path, "batch")):
        if fs.exists(_path(spark, f"{path}/_SUCCESS")) and (before is None or number < before):
            for part, folder in inside(path, "part"):
                found.setdefault(part, []).append(folder)
    return found


def current(spark: SparkSession, state_path: str, order: str = "seq", keys: tuple[str, ...] = ("id",)) -> DataFrame | None:
    """The rows that are there now: the last version of each part without what has been deleted."""
    last = [paths[-1] for paths in _versions(spark, state_path).values()]
    return latest_by_key(spark.read.parquet(*last), list(keys), order) if last else None


def closures_with_edges(stream: DataFrame, edges: DataFrame, graph_hash: str) -> DataFrame:
    """A stream of closures ``closure_id, graph_hash, from_utc, to_utc, edge_ids`` against the static
    edges: one row per closed edge that still exists. ``stale`` tells that a closure was written for
    another graph; of such a one what can be resolved is kept and the rest is dropped."""
    each = stream.select("closure_id", (F.col("graph_hash") != graph_hash).alias("stale"), "from_utc", "to_utc", F.explode("edge_ids").alias("edge_id"))
    return each.join(edges.select(F.col("id").alias("edge_id")), "edge_id")


def active_counts(stream: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Closed edges per window of their begin; rows later than the watermark are left out."""
    return stream.withWatermark("from_utc", late).groupBy(F.window("from_utc", window)).agg(F.count("*").alias("edges"))


def closures_in_force(stream: DataFrame, *, lifetime_s: int = 60) -> DataFrame:
    """A stream of closures ``closure_id, stale, edge_id, seen`` (as ``closures_with_edges`` gives them, with the time
    at which each was heard of) -> ``edge_id, closure_id, closed, stale``: a row when an edge is closed by a closure
    and one when that lapses.

    A closure holds for ``lifetime_s`` after it was last heard of. Each row that confirms it sets its timer anew;
    when the stream's time, the watermark of ``seen``, passes a timer the closure lapses without any row of
    its own. One that was written for another graph is passed on as stale.
    The state is a row per closed edge and closure; the session's state store has to be RocksDB.
    """
    out = "edge_id string, closure_id string, closed boolean, stale boolean"
    return (
        stream.withWatermark("seen", "0 seconds")
        .groupBy("edge_id", "closure_id")
        .transformWithStateInPandas(statefulProcessor=_Lifetime(lifetime_s), outputStructType=out, outputMode="Append", timeMode="EventTime")
    )


class _Lifetime(StatefulProcessor):
    """A closed edge until its timer runs out."""

    def __init__(self, lifetime_s: int):
        self.lifetime_ms = 1000 * lifetime_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "until long, stale boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.known.get() if self.known.exists() else None
        until, stale = (before[0], before[1]) if before else (0, True)
        for batch in rows:
            last = int(batch["seen"].max().timestamp() * 1000) + self.lifetime_ms
            if last >= until:
                until, stale = last, bool(batch.loc[batch["seen"].idxmax(), "stale"])
        if until <= timerValues.getCurrentWatermarkInMs():
            return
        if before:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(until)
        self.known.update((until, stale))
        if not before or before[1] != stale:
            yield self._row(key, True, stale)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, stale = self.known.get()
        self.known.clear()
        yield self._row(key, False, stale)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, closed: bool, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"edge_id": [key[0]], "closure_id": [key[1]], "closed": [closed], "stale": [stale]})
