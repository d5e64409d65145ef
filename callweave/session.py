"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("callweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: spark.checkpoint.dir if the cluster names one.

    Only where the session has no folder yet (tests, a laptop) a local one is made.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="callweave-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder when the driver ends, if its JVM is still there."""
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  (a stopped session has nothing left to call)
        pass


def shared_table(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a compressed table in the shared folder, read again; filters on the partition columns read only their part."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    atexit.register(_drop, df.sparkSession, path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Spread few input splits over the cluster before a Python stage.

    A scan of one small file is one task; a row-local Python stage behind it would use one core.
    The shuffle is skipped where the scan already has as many splits as the cluster has cores.
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df  # already behind a shuffle
    want = tasks or max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


#: Ids that may be broadcast: 16 MB at most. Beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Rows of one key from which on a join takes the key out of the shuffle.
HOT_ROWS = 20_000


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of df with a materialised table of ids (one column, same name); broadcast only if small enough."""
    return df.join(broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def hot_join(df: DataFrame, keys: DataFrame, column: str, rows: str = "n", how: str = "inner") -> DataFrame:
    """Join of df with a materialised table of one row per key, which says in `rows` how many rows of df the key has.

    Keys with more than HOT_ROWS rows (so at most one for each HOT_ROWS rows of df) come by broadcast where
    the rows lie, so that no task gets all rows of a key; the others are shuffled. Should there be more than
    BROADCAST_IDS hot keys, each is small against the whole and the plain join serves. `how` is inner or left.
    """
    hot = keys.where(F.col(rows) > HOT_ROWS)
    n = hot.count()
    if not n or n > BROADCAST_IDS:
        return df.join(keys, column, how)
    warm = df.join(broadcast(hot), column)
    cold = df.join(broadcast(hot.select(column)), column, "left_anti").join(keys.where(F.col(rows) <= HOT_ROWS), column, how)
    return warm.unionByName(cold)
