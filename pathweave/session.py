"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting by which Spark removes a query's shuffle files when it has ended.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "pathweave", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``. Only a local master, whose
    executors are the driver itself, gets a temporary folder where nothing is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="pathweave-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind; otherwise they stay until the driver collects its garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_and_reread(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: for wide rows, which
    Parquet keeps smaller than a checkpoint and from which later steps read only some columns; and
    in loops that join a table with itself, as a checkpoint keeps the estimated size, which such a
    loop squares each round until planning stalls on its digits."""
    path = scratch_path(df.sparkSession, name)
    out = _written(df, path)
    _paths[out] = path
    return out


#: Where the tables are that ``write_and_reread`` has written.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def remove(*tables: DataFrame) -> None:
    """Remove tables of ``write_and_reread``; all steps that read them must have been written."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in the shared folder that are removed once nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(write_and_reread(df, name))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Remove these; all steps that read them must have been written."""
        remove(*tables)
        self.tables = [t for t in self.tables if not any(t is gone for gone in tables)]

    def drop_all(self) -> None:
        self.drop(*self.tables)


def counted_side(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``df`` written out and counted, marked for broadcast if it has at most ``most`` rows."""
    df = cut_lineage(df)
    n = df.count()
    return (F.broadcast(df) if n <= most else df), n
