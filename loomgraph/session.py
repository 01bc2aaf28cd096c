"""Where lineage is cut, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir as the cluster sets it.

    Where it is unset, a temporary folder is set once if everything runs on one machine;
    on a cluster there is no such folder, and RuntimeError says so.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A file is written for so many rows at least where their number is known.
FILE_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    Later plans start from files: lost executors cost nothing, unused columns aren't read,
    and Catalyst knows the sizes. rows: at most so many, narrow ones, go into df's last
    stage, which then has no more tasks and files than they need.
    """
    path = scratch(df.sparkSession, "cut")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that cut returned, once nothing that is still to run reads them."""
    for df in frames:
        discard(df.sparkSession, df._cut_at)


def discard(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder, once nothing that is still to run reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
