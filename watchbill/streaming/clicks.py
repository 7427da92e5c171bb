"""Click events as a stream: deduplicated ingestion, counts by event-time window, latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from watchbill.operators.store import upsert
from watchbill.sources.tables import shared_dir


def read_events(spark: SparkSession, path: str, files: str = "*.parquet", schema: StructType | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Events from the Parquet files of a folder as they arrive; `files` names those that count."""
    known = schema or spark.read.option("pathGlobFilter", files).parquet(path).schema
    return spark.readStream.schema(known).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(path)


def once_each(events: DataFrame, id: str, ts: str, late: str) -> DataFrame:
    """Events sent again under one id within the watermark are dropped; state older than it is freed.

    Events that arrive later than the watermark are dropped too: for streams without end, not for whole tables.
    """
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])


def window_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n) of tumbling windows; rows later than the watermark are left out once a window closed."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """(session_start, session_end, key, n) of sessions that a gap ends."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def append(events: DataFrame, path: str, name: str) -> StreamingQuery:
    """What has arrived, appended to a Parquet table exactly once; the checkpoint lies in the shared folder."""
    spark = events.sparkSession
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).outputMode("append").start()


BUCKETS = 64  # parts of a kept table, by a hash of its keys


def _latest_parts(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> list[str]:
    """The newest complete version of each part of a kept table, of versions under `before`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        name = v.getPath().getName()
        if not name.startswith("v") or not name[1:].isdigit() or before is not None and int(name[1:]) >= before:
            continue
        parts = {p.getPath().getName(): p.getPath().toString() for p in fs.listStatus(v.getPath())}
        if "_SUCCESS" not in parts:
            continue
        for part, where in parts.items():
            if part.startswith("bucket=") and (buckets is None or int(part[7:]) in buckets):
                newest[int(part[7:])] = max(newest.get(int(part[7:]), (-1, "")), (int(name[1:]), where))
    return [where for _, where in newest.values()]


def latest_state(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a table that keep_latest keeps; none before its first batch."""
    parts = _latest_parts(spark, path)
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def keep_latest(events: DataFrame, keys: list[str], version: str, tie: str, path: str, name: str) -> StreamingQuery:
    """The newest event of each key as a table, merged batch by batch; latest_state reads it.

    A batch reads and writes only those of the table's BUCKETS parts that its keys fall in, as a new version under
    path/vN, by batch number, so a batch run again after a failure gives the same version.
    """
    schema = events.schema
    part = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(part).distinct().collect()]  # BUCKETS at most
        parts = _latest_parts(spark, path, number, touched)
        old = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
        new = upsert(old, batch, keys, version, tie).withColumn("bucket", part)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{shared_dir(events.sparkSession)}/stream-{name}").trigger(availableNow=True).start()
