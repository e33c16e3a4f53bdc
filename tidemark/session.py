"""Session helpers: table access, lineage cuts, bounded side inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local, as in tests, one is made here.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it with its lineage cut.

    The files are that file system's to keep, so a lost executor costs nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, folder: str) -> DataFrame:
    """``df``, written out of ``folder`` into a checkpoint of its own; the folder goes."""
    out = cut(df)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return out


def small_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if there are at most ``most`` of them, else None (one bounded job)."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """Join with ``right`` broadcast when it was counted to have at most ``most`` rows.

    Beyond that the join is left to AQE, which shuffles and splits skewed partitions.
    """
    within = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if within else right, on, how)


#: Bytes of a plan's estimated output for each core below which its rows are spread anew.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores where it is too small to fill them, as a small file is; equal ``by`` meet in one task.

    For steps that cost far more than moving a row. The size is the optimizer's estimate, so nothing
    runs here; larger inputs are left as they lie. The result is the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores, *by) if int(str(size)) < cores * SPREAD_BYTES else df
