"""Incremental ingest, and windowed sums of a stream of values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terradrift.sources.readers import exists, list_files


def pending(spark: SparkSession, raw_folder: str, out_folder: str, force: bool = False) -> list[str]:
    """Raw files whose two outputs don't both exist."""
    raw = list_files(spark, raw_folder, ".csv", ".txt")
    written = list_files(spark, out_folder, ".parquet", recursive=True) if exists(spark, out_folder) else []
    done = {re.sub(r"\.part[0-9]{4}(?=_)", "", p.rsplit("/", 1)[-1]) for p in written}
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [p for p in raw if force or not {f"{stem(p)}_meta.parquet", f"{stem(p)}_ts.parquet"} <= done]


def ingest_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform) -> StreamingQuery:
    """Files that arrive in folder, each once: transform(batch) is appended to out. Runs through what is there
    and stops; a later call takes up where it ended."""
    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    stream = stream.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return stream.writeStream.foreachBatch(lambda df, n: transform(df).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days", by: tuple[str, ...] = ()) -> DataFrame:
    """Count and sum of value per window and key, with a watermark; the same plan for batch and stream."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")
