"""Keeps a program's consequences up to date as triples arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.fixpoint import Result, reason
from loomgraph.operators.store import TripleStore
from loomgraph.plans.ir import Program

SCHEMA = "s string, p string, o string"


def maintain(stream: DataFrame, program: Program, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appends its new triples and what follows from them to those at path; available now, exactly once.

    Folder path/v=N holds what batch N added. What the folders before it hold is closed
    under the program, so only consequences of the new triples are derived, and nothing is
    written twice. A batch that is run again overwrites its own folder. latest() reads all.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _read(spark, path, number)
        out = reason(known, program, new_facts=TripleStore(batch), known=Result(known, {}, base_is_set=True))
        out.fresh.write.mode("overwrite").parquet(f"{path}/v={number:09d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str, below: int | None) -> list[str]:
    """Folders of finished batches before the given one."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    top = make(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("v=")]
    done = [p for p in found if fs.exists(make(p, "_SUCCESS")) and (below is None or int(p.getName()[2:]) < below)]
    return sorted(p.toString() for p in done)


def _read(spark: SparkSession, path: str, below: int | None) -> TripleStore:
    folders = _folders(spark, path, below)
    return TripleStore(spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA))


def latest(spark: SparkSession, path: str) -> TripleStore:
    """All triples that finished batches have added, each once."""
    return _read(spark, path, None)
