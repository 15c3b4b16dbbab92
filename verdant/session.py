"""Session helpers shared by tests, the benchmark and the jobs."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: set[str] = set()
#: Bytes that a row takes in a hash relation at the least: two places of two longs each, its bits, one column, the next row.
HASHED = 56
#: Bytes of files below which a table's rows are not counted.
COUNTED = 1 << 16


def local_session(cores: int | str = "*", app: str = "verdant", checkpoints: str | None = None) -> SparkSession:
    """Session for a single machine; on a cluster the submitter's session is used as it is."""
    builder = SparkSession.builder if checkpoints is None else SparkSession.builder.config("spark.checkpoint.dir", checkpoints)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, deleted when the driver's Python ends.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Where none is named it lies
    in the warehouse, which driver and executors share as well.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/intermediate-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # the session ended first; its folder is left to the cluster's clean-up
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder, in a folder per value of the column ``by``.

    Unlike a local checkpoint it survives the loss of executors; unlike an RDD checkpoint readers
    prune its columns. Where its rows are too many to be sent to all tasks, joins know that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return unsent(spark.read.schema(df.schema).parquet(path))


def by_key(df: DataFrame) -> DataFrame:
    """``df``, which the next join sorts by key and never sends to all tasks.

    For rows that Spark takes for fewer than they are: it counts an exploded row as one, whatever it gives.
    """
    return df.hint("merge")


def unsent(stored: DataFrame) -> DataFrame:
    """A stored table, by key if a hash relation of its rows passes the session's limit for broadcasts.

    Spark goes by the files' size, which says little of the rows: sorted keys shrink to a bit each. Its limit
    is meant for what the driver holds.
    """
    session = stored.sparkSession._jsparkSession.sessionState()
    limit = session.conf().autoBroadcastJoinThreshold()
    files = int(str(stored._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    # a small table is not worth a count
    return by_key(stored) if limit > 0 and files >= COUNTED and stored.count() * HASHED > limit else stored
