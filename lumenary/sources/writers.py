"""Sinks: combined, per type, and a single JSON array."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_combined(results: DataFrame, path: str, append: bool = False) -> str | None:
    """JSON lines, replacing what was there unless they ``append``; nothing is written, and None returned, for no rows."""
    if results.isEmpty():
        return None
    results.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_by_type(results: DataFrame, path: str, append: bool = False) -> str | None:
    """A folder per source_type; folders of types that are not in ``results`` stay as they are, the others are replaced unless rows ``append``."""
    if results.isEmpty():
        return None
    (results.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
     .partitionBy("source_type").json(path))
    return path


def export_array(results: DataFrame, path: str, order: str | None = "pos") -> str:
    """One JSON array with indent 2, non-ASCII kept, in one file at ``path`` of any file system that Spark reaches, replacing what was there.

    Rows go by ``order``, which is no part of them, or, where they lack it, as they come. They are sorted by range and written in parallel;
    the file is the parts one after the other, copied as bytes, so no row passes through Python on the driver and their number has no bound."""
    spark = results.sparkSession
    rows = results
    if order in results.columns:
        rows = results.repartitionByRange(order).sortWithinPartitions(order).drop(order)

    @F.arrow_udf("string")
    def laid_out(texts: pa.Array) -> pa.Array:
        return pa.array(["\n".join(f"  {x}" for x in json.dumps(json.loads(t), indent=2, ensure_ascii=False).split("\n")) for t in texts.to_pylist()], pa.string())

    # With their names in the text, so that columns that do not go into JSON fields by themselves do as well.
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    between = ",\n"
    parts = f"{path}.parts-{uuid.uuid4().hex[:12]}"
    rows.select(laid_out(text).alias("value")).write.option("lineSep", between).text(parts)
    _joined(spark, parts, path, between)
    return path


def _joined(spark: SparkSession, parts: str, path: str, between: str) -> None:
    """The files of ``parts``, in the order of their names, framed as an array in one file; ``parts`` goes."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, to, half = hadoop.fs.Path(parts), hadoop.fs.Path(path), hadoop.fs.Path(f"{parts}-joined")
    files = source.getFileSystem(conf)
    found = sorted(((f.getPath().getName(), f.getPath(), f.getLen()) for f in files.listStatus(source)), key=lambda f: f[0])
    found = [(at, size) for name, at, size in found if name.startswith("part-") and size]
    out = files.create(half, True)
    try:
        out.write(b"[\n" if found else b"[")
        for k, (at, size) in enumerate(found):
            part = files.open(at)
            try:  # the last separator of all goes
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, size - (len(between) if k == len(found) - 1 else 0))
            finally:
                part.close()
        out.write(b"\n]" if found else b"]")
    finally:
        out.close()
    files.mkdirs(to.getParent()) if to.getParent() is not None else None
    files.delete(to, True)
    if not files.rename(half, to):
        raise OSError(f"could not move {half} to {to}")
    files.delete(source, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark that something is done."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()
