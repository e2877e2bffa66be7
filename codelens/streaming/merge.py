"""Results merged as they arrive: an append-only log of JSON lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT = "work_id string, project string, passed boolean, seconds double, written_at timestamp"


def result_stream(spark: SparkSession, path: str, schema: str = RESULT, late: str = "1 hour") -> DataFrame:
    """Result rows from JSON files under a folder, each work item once; an item that comes back within ``late`` is dropped.

    A file's last line may be broken, as a writer that was stopped leaves it,
    and is skipped; a broken line before it is an error. A file is read as
    one row, so writers should begin a new one from time to time.
    """
    lines = spark.readStream.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    rows = lines.select(F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line")).withColumn("broken", F.try_parse_json("line").isNull())
    whole = rows.where("NOT (broken AND at = n - 1)")
    # parse_json fails on a broken line
    named = F.try_variant_get(F.parse_json("line"), "$.work_id", "string").isNotNull()
    rows = whole.where(named).select(F.from_json("line", schema).alias("r")).select("r.*")
    return rows.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["work_id"])


def progress_stream(results: DataFrame, window: str = "10 minutes") -> DataFrame:
    """(window, project, processed, passed) by time of writing."""
    return results.groupBy(F.window("written_at", window), "project").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))


def merge_into(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet folder; a restart goes on where the last run stopped."""
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
