"""Structured Streaming: windowed rollup of events and incremental intake of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.session import checkpointed, table


def hourly(events: DataFrame) -> DataFrame:
    """hour, event_type, n, n_users, total of a batch of events."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


def hourly_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """hour, event_type, n, total of a stream of events; rows later than ``late`` behind the newest are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


BUCKETS = 64  # parts of a store; a batch rewrites those that its keys fall into


def upsert_latest(batch: DataFrame, store: str, key: str, order: list[str]) -> None:
    """Merge a micro-batch into a parquet store that keeps the latest row of each key.

    The store is cut into BUCKETS parts by a hash of the key; a batch rewrites the parts that it touches and leaves the others. The
    list of parts in force is written beside the old one and its number is published last, so a run that is lost half-way
    leaves the old state in force, and a batch given twice changes nothing. Parts that neither of the last two lists names
    are removed.
    """
    spark = batch.sparkSession
    rows = checkpointed(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return
    version = _version(spark, store)
    parts = _parts(spark, store, version)
    now = _read(spark, store, {b: v for b, v in parts.items() if b in touched})
    if now is not None:
        rows = now.unionByName(rows.select(*now.columns))
    others = [c for c in rows.columns if c not in (key, "bucket")]
    best = rows.groupBy("bucket", key).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("m")).select("bucket", key, *[F.col(f"m.{c}").alias(c) for c in others])
    best.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/v{version + 1}")
    new = parts | dict.fromkeys(touched, version + 1)
    spark.createDataFrame(sorted(new.items()), "bucket int, part int").coalesce(1).write.mode("overwrite").parquet(f"{store}/lists/v{version + 1}")
    spark.createDataFrame([(version + 1,)], "version long").coalesce(1).write.mode("append").parquet(f"{store}/versions")
    before = _parts(spark, store, version - 1) if version else {}
    for b, v in before.items():
        if parts.get(b) != v and new.get(b) != v:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/data/v{v}/bucket={b}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _version(spark: SparkSession, store: str) -> int:
    if not _exists(spark, f"{store}/versions"):
        return 0
    return spark.read.schema("version long").parquet(f"{store}/versions").agg(F.max("version").alias("v")).first().v or 0


def _parts(spark: SparkSession, store: str, version: int) -> dict[int, int]:
    """The version of every part in force."""
    if version < 1 or not _exists(spark, f"{store}/lists/v{version}"):
        return {}
    return {r.bucket: r.part for r in spark.read.parquet(f"{store}/lists/v{version}").collect()}


def _read(spark: SparkSession, store: str, parts: dict[int, int]) -> DataFrame | None:
    if not parts:
        return None
    return spark.read.option("basePath", f"{store}/data").parquet(*[f"{store}/data/v{v}/bucket={b}" for b, v in sorted(parts.items())])


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The state in force, or None before the first batch."""
    now = _read(spark, store, _parts(spark, store, _version(spark, store)))
    return None if now is None else now.drop("bucket")


def ingest_captures(stream: DataFrame, store: str, checkpoint: str, key: str = "id", order: list[str] | None = None):  # noqa: ANN201
    """Run all that is there of a stream of captures into the store and stop."""
    order = order or ["ingested_at"]
    return stream.writeStream.foreachBatch(lambda b, _: upsert_latest(b, store, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a stream of its files; it may be one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
