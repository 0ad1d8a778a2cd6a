"""Session helpers: the shared folder and staged tables.

Iterative jobs (model fits, searches) read their input many times, so it is staged once as
Parquet in the folder the cluster names in ``spark.checkpoint.dir``. A staged table cuts
lineage, survives the loss of executors and keeps column pruning and filter pushdown.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "viewtide", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.scheduler.mode", "FAIR")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as configured by the cluster.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting
    is an error, since a machine-local path would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="viewtide-"))
    return spark.sparkContext.getCheckpointDir()


def results_folder(spark: SparkSession) -> str:
    """Folder of results that a later session may find again, which takes a configured ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark).rstrip('/')}/viewtide/results"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path as Hadoop's own."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/viewtide/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over the written table.

    Values of the columns ``by`` become folders, so that a filter on them reads those folders only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def remove_staged(*tables: DataFrame) -> None:
    """Delete tables that ``stage_table`` returned, once nothing that hangs off them will run again."""
    for table in tables:
        system, path = hadoop_path(table.sparkSession, table.staged_at)
        system.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of ended fits: it does so once the driver's JVM has found their plans to be garbage."""
    spark.sparkContext._jvm.System.gc()
