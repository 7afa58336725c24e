"""Keeping an index current from a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.chunks import text_hash


def changed_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files with rows of (repo_id, path, content, walked_at)."""
    return spark.readStream.schema(schema).parquet(folder)


def activity(stream: DataFrame, window: str = "1 day", late: str = "21 days") -> DataFrame:
    """Changed files a repository and window of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark("walked_at", late).groupBy(F.window("walked_at", window), "repo_id").agg(F.count("*").alias("files")).select("repo_id", F.col("window.start").alias("start"), "files")


def refresh(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each batch replaces its files' rows in the index; rows whose text's hash is unchanged are left out
    of what is stored anew. ``load`` gives the stored (repo_id, path, hash), ``store`` takes the changed
    rows; a batch that is run again after a failure finds its hashes stored and does nothing."""

    def batch(df: DataFrame, _: int) -> None:
        new = df.groupBy("repo_id", "path").agg(F.max_by("content", "walked_at").alias("content")).withColumn("hash", text_hash("content"))
        store(new.join(load().select("repo_id", "path", "hash"), ["repo_id", "path", "hash"], "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
