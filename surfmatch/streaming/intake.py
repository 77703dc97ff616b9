"""Resumable intake as a stream: every micro-batch appends what the table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from surfmatch.operators.catalog import append_missing


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, or none of its rows before the first append."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def append_batch(batch: DataFrame, path: str, key: tuple[str, ...]) -> None:
    """One batch: repeats within it and keys already stored are skipped, so a replayed batch changes nothing."""
    stored = read_or_empty(batch.sparkSession, path, batch.schema)
    append_missing(batch.dropDuplicates(list(key)), stored, key).write.mode("append").parquet(path)


def start_intake(stream: DataFrame, path: str, key: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """Run the stream over all that is there, batch by batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_batch(batch, path, key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
