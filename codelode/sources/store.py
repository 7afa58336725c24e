"""Sinks and guarded reads: the graph as one JSON document, indexes by model, caches by hash."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def graph_json(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """One JSON document for each value of ``by``. A document is as large as its graph: meant for one
    repository's report, not for the whole corpus."""
    n = nodes.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in nodes.columns if c != by]))).alias("nodes"))
    e = edges.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in edges.columns if c != by]))).alias("edges"))
    return n.join(e, by, "left").select(by, F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("document"))


def model_slug(model: str) -> str:
    return re.sub(r"[^a-z0-9.\-]+", "_", model.lower())


def save_index(chunks: DataFrame, folder: str, models: list[str]) -> None:
    """One folder a model; only the named models' folders are replaced."""
    for m in models:
        chunks.where(F.col("model") == m).write.mode("overwrite").parquet(os.path.join(folder, f"model={model_slug(m)}"))


def load_index(spark: SparkSession, folder: str, model: str, schema: str) -> DataFrame:
    """The stored chunks of a model; an empty table where there are none, they can't be read, columns are
    missing or vectors differ in length."""
    empty = spark.createDataFrame([], schema)
    try:
        got = spark.read.parquet(os.path.join(folder, f"model={model_slug(model)}"))
        if not set(empty.columns) <= set(got.columns):
            return empty
        got = got.select(*empty.columns)
        if got.select(F.size("embedding").alias("n")).distinct().limit(2).count() > 1:
            return empty
        return got
    except AnalysisException:
        return empty
    except Exception as e:  # a damaged file shows only when it is read
        if "parquet" in str(e).lower():
            return empty
        raise


def prune_cache(cache: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """Entries of a cache whose key is still in use."""
    return cache.join(live.select(*by).distinct(), by, "left_semi")


def clear_index(spark: SparkSession, folder: str, model: str) -> None:
    """Removes a model's index; nothing happens where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, f"model={model_slug(model)}"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


GRAPH = "version int, source string, nodes array<struct<path:string,language:string,importance:double>>, edges array<struct<`from`:string,`to`:string,weight:int>>"


def load_graph(spark: SparkSession, path: str, schema: str = GRAPH) -> DataFrame:
    """A stored graph document as one row. Where there is none, or it isn't one, the error says what to do."""
    try:
        got = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        if got.where("nodes IS NOT NULL").limit(1).count():
            return got
    except AnalysisException:
        raise FileNotFoundError(f"There is no graph at {path}; analyse the repository first.") from None
    raise ValueError(f"{path} holds no graph; analyse the repository again.")


def trimmed(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A graph small enough to ship as a sample: files with the named columns and no declarations, edges as they are."""
    kept = nodes.select(*columns, F.array().cast("array<string>").alias("functions"))
    return kept, edges
