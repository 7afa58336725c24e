"""Session, tables and the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary one is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python once an application, so that they needn't have it
    installed. Spark's own file server passes the archive on."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "codelode.zip")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    spark.sparkContext.addPyFile(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out anew where a table has fewer files than the cluster has cores; costly work on
    each row would else sit in a few tasks, as a file may be one row group. Other tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df if files >= cores or not files else df.repartition(3 * cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors and is
    read column by column."""
    path = f"{shared_dir(df.sparkSession)}/codelode-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def forget(df: DataFrame) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    found = _WRITTEN.pop(id(df), None)
    if found:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(found[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
