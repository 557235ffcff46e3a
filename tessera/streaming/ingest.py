"""Fields that arrive one by one: an idempotent streaming upsert into a plate's field table.

Events (plate, well, path, acquisition, ts) come from any stream. Repeats within
the watermark are dropped in the stream's state; every micro-batch is merged
into the table by key, so a batch that runs twice changes nothing. The merge
rewrites only the wells of the batch: the table is partitioned by a bucket of
the well, and a batch's buckets are read and replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.plate import upsert_fields
from ..runtime import shared_root

FIELDS = "plate string, well string, pos int, path string, acquisition int"
EVENTS = "plate string, well string, path string, acquisition int, ts timestamp"


def bucket(buckets: int):
    return F.pmod(F.xxhash64("plate", "well"), F.lit(buckets)).cast("int")


def create_table(fields: DataFrame, path: str, buckets: int = 16) -> None:
    fields.withColumn("bucket", bucket(buckets)).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS + ", bucket int").parquet(path).drop("bucket")


def merge(batch: DataFrame, path: str, buckets: int = 16) -> None:
    """Add the batch's new fields to the table at ``path``."""
    spark = batch.sparkSession
    new = batch.select("plate", "well", "path", "acquisition").distinct().withColumn("bucket", bucket(buckets))
    # as many numbers as there are buckets at most
    touched = [r[0] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    table = spark.read.schema(FIELDS + ", bucket int").parquet(path).where(F.col("bucket").isin(touched))
    merged = upsert_fields(table.drop("bucket"), new.drop("bucket")).withColumn("bucket", bucket(buckets))
    # the rows replace what they are read from, so they are computed before
    shared_root(spark)
    merged = merged.checkpoint()
    merged.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def ingest(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", buckets: int = 16, **trigger) -> StreamingQuery:
    """Start the upsert stream of ``events`` (a streaming DataFrame of EVENTS)."""
    unique = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["plate", "well", "path", "acquisition"])
    writer = unique.writeStream.foreachBatch(lambda batch, _: merge(batch, path, buckets)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
