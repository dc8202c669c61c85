"""An archive of a stream in segments, with a manifest of what times each holds, and reads of an interval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: rows (video, t_us, ...) of a batch become one segment, and a row a video of the manifest.

    A segment is named by its batch, and written over what is there: a batch that comes again, after a
    failure, leaves the archive as it was.  The manifest is written after the rows, so that it never tells of what is not there.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("segment", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{path}/rows")
        written = batch.sparkSession.read.parquet(f"{path}/rows").where(F.col("segment") == number)
        spans = written.groupBy("segment", "video").agg(F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"), F.count(F.lit(1)).alias("rows"))
        spans.withColumn("batch", F.col("segment")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/manifest")

    return put


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(segment, video, from_us, to_us, rows) of each segment and video."""
    return spark.read.parquet(f"{path}/manifest").select("segment", "video", "from_us", "to_us", "rows")


def interval(spark: SparkSession, path: str, video: int, from_us: int, to_us: int, slack_us: int = 200_000) -> DataFrame:
    """Rows of a video between two times, read from the segments that overlap them (and ``slack_us`` around).

    The manifest names the few segments of the interval, so that the scan is pruned to their folders before it begins.  An
    archive without any manifest has no rows to give: that is an error of Spark's, as of any folder that is not there.
    """
    near = manifest(spark, path).where((F.col("video") == video) & (F.col("from_us") <= to_us + slack_us) & (F.col("to_us") >= from_us - slack_us))
    wanted = [r["segment"] for r in near.select("segment").distinct().collect()]  # as many as batches fall into the interval
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("segment").isin(wanted) if wanted else F.lit(False)).where((F.col("video") == video) & F.col("t_us").between(from_us, to_us)).drop("segment")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was archived there yet."""
    try:
        manifest(spark, path)
    except AnalysisException:
        return False
    return True
