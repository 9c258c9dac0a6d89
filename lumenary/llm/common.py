"""What the operators of this package share: tables, intermediate results, small-side checks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side that has been counted may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20
#: Rows of a file of a scratch table whose number of rows is known.
FILE_ROWS = 500_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one, which only a session on one machine has."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (spark.master is {master})")
        root = tempfile.mkdtemp(prefix="lumenary-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class _While:
    """Session settings that hold while any write of a scratch table is under way, however many there are at once."""

    def __init__(self, **values: str):
        self.values, self.lock, self.held = values, threading.Lock(), {}

    @contextlib.contextmanager
    def __call__(self, spark: SparkSession):
        key = spark._jsparkSession.hashCode()
        with self.lock:
            n, before = self.held.get(key, (0, None))
            if not n:
                before = {k: spark.conf.get(k, None) for k in self.values}
                for k, v in self.values.items():
                    spark.conf.set(k, v)
            self.held[key] = (n + 1, before)
        try:
            yield
        finally:
            with self.lock:
                n, before = self.held.pop(key)
                if n > 1:
                    self.held[key] = (n - 1, before)
                else:
                    for k, v in before.items():
                        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Where the shared folder is of the file: scheme, without checksum files beside the data: each file made forks the executor's JVM
#: to set permissions, and for that moment its memory counts twice. Other schemes are not concerned.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Batches of long texts stay small, and a write's shuffle files go with its end, as nothing reads them again.
_writing = _While(**{ARROW_ROWS: "1024", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors.

    ``drop`` removes those that later steps have superseded; what the returned result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.there = 0, {}

    def keep(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """Writes ``df`` and reads it back. ``most``, a known bound of its rows, joins small partitions into files of about ``FILE_ROWS``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        if most is not None:
            df = df.coalesce(-(-max(1, most) // FILE_ROWS))  # never more partitions than there are
        with _writing(self.spark):
            df.write.options(**RAW_FILES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.there[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.there.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *frames: DataFrame) -> None:
        self.drop(*[df for df, _ in list(self.there.values()) if not any(df is f for f in frames)])


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted rows are within the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df.hint("merge")
