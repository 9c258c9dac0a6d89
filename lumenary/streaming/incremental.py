"""The incremental path: records that arrive are analysed by the same narrow plan and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenary.operators.records import analysed, detailed


def stream_records(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def append_analysed(raw: DataFrame, out: str, checkpoint: str, as_of: str, keys: tuple[str, ...] = (), **enrichment) -> StreamingQuery:
    """Analyses raw records as they come and appends them to ``out``. No state is kept. The file sink commits a batch's
    files once, so one that is run again after a failure adds no rows."""
    return (detailed(analysed(raw, as_of, **enrichment), keys).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def append_each(raw: DataFrame, sink, checkpoint: str, as_of: str, keys: tuple[str, ...] = (), **enrichment) -> StreamingQuery:
    """As ``append_analysed``, with ``sink(batch, batch_id)`` for tables that Spark cannot write as a stream."""
    return (raw.writeStream.foreachBatch(lambda batch, n: sink(detailed(analysed(batch, as_of, **enrichment), keys), n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
