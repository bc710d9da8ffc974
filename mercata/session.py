"""Session construction with the settings the operators rely on."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator assumes: UTC wall clock for TIMESTAMP_NTZ arithmetic,
# ANSI on (so operators use try_divide / try_cast explicitly), AQE with
# partition coalescing and skew-join splitting.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
    # Remove checkpoint files once the DataFrames that own them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "mercata",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the operator defaults applied.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); AQE coalesces small partitions anyway.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    Clusters name a shared folder in ``spark.checkpoint.dir``; that setting is
    always respected. A private temporary folder stands in only when nothing is
    configured and the master is ``local`` (tests); on any other master a
    missing setting raises, since executors could not read each other's files.
    """
    try:
        sc = spark.sparkContext
    except Exception as e:  # Spark Connect: no driver-side context
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from e
        return configured
    configured = (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
                  or sc.getConf().get("spark.checkpoint.dir", None))
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="mercata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


#: Folders that ``write_table`` has filled since they were last cleared.
_WRITTEN: list[str] = []


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear_tables(spark: SparkSession) -> int:
    """Delete every table that this process has written with ``write_table``; their number.

    For long sessions, between reports: DataFrames that were built on these
    tables and not stored elsewhere can no longer be read.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        delete_folder(spark, _WRITTEN.pop())
    return n


def write_table(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    Cuts lineage for good: a lost executor costs a re-read, not a recompute,
    and later readers prune columns and push filters into the scan.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/mercata-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a ``write_table`` result that no plan needs any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/mercata-" not in folder:
            raise ValueError(f"not a table of write_table: {folder}")
        delete_folder(spark, folder)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced.

    Spark's context cleaner does so when the driver collects its garbage; asking
    between heavy steps keeps one step's files from standing beside the next's.
    The driver's Python gives up its handles on another thread, and the cleaner
    works on its own one, hence the moments' wait and the second round.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark._jvm.System.gc()
    time.sleep(1)


def materialize(df: DataFrame) -> DataFrame:
    """``write_table`` for intermediates that several later jobs read."""
    return write_table(df)
