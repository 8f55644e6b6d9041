"""Where intermediate tables live, and when a table is small enough to broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 * 1024 * 1024
# Of a side with a row per query and more: its hash table of some 200 bytes a row is built by the driver.
JOINED_BYTES = 16 * 1024 * 1024
SPREAD_BYTES = 64 * 1024 * 1024

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A temporary folder is used only in local mode, where one machine is the whole cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="dimsift-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.append((spark, path))
    return path


def _forget() -> None:
    """Delete the intermediate tables of this process, as far as a session is left to do it with."""
    for spark, path in _made:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to the folder
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, survives lost executors, and gives later stages column pruning and
    file statistics, none of which a cached plan in executor memory would.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Size that Catalyst expects of ``df``; for a stored table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(stored: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the files of a stored table are within ``limit``; else leave an ordinary join.

    A quarter of the limit is allowed on disk, since values unfold in memory.
    """
    return F.broadcast(stored) if bytes_of(stored) * 4 <= limit else stored


def spread(stored: DataFrame) -> DataFrame:
    """Deal a small stored table with fewer splits than cores out over the cores, in no order.

    Tables above ``SPREAD_BYTES`` have splits enough, or row groups that should be smaller; they are
    read where they are.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    if bytes_of(stored) > SPREAD_BYTES or stored.rdd.getNumPartitions() >= cores:
        return stored
    return stored.repartition(cores)
