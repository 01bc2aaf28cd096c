"""What several operators use: size-checked broadcasts, files in the shared folder, arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut, discard, forget, scratch, shared_dir

#: A side is broadcast only if its counted rows times a stated row width stay below this.
BROADCAST_BYTES = 16 << 20

#: A key is hot if it has at least this share of a side's rows: there are at most 1 / HOT of them.
HOT = 1 / 1000
#: No key is hot where a side has no more rows than one task may well take.
COLD = 20_000

__all__ = ["BROADCAST_BYTES", "cut", "discard", "forget", "held", "join_checked", "join_hot", "join_shuffled", "open_input", "open_output", "scratch", "shared_dir", "ship", "strings", "utf32"]


_SHIPPED: set[str] = set()
_HELD: dict = {}


def held(key, build):
    """build(), done once for as long as the same key is asked for.

    A worker process holds one such value at a time: workers serve one stage after the
    other, and what a stage leaves behind goes when the next one asks for its own.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


#: Rows that go to a Python worker at once: with texts of 100 kB, Spark's own 10,000 would be a gigabyte.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS, SPARKS_OWN = 1000, "10000"


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application: they may not have the repository on their path.

    Batches for Python workers are made smaller, unless the session has a size of its own.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "loomgraph").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int = 64, size: Column | None = None) -> DataFrame:
    """left joined to a materialised right side, which is broadcast only where its counted size allows; else both are shuffled.

    The size is the rows times row_bytes, or the sum of size, for rows of any width.
    """
    n = right.count() * row_bytes if size is None else right.agg(F.sum(size + row_bytes).alias("n")).first().n or 0
    return left.join(F.broadcast(right), on, how) if n <= BROADCAST_BYTES else join_shuffled(left, right, on, how)


def join_shuffled(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """left joined to right, neither of them broadcast, whatever sizes Catalyst assumes.

    It takes exploded rows for no larger than their input and files for their compressed
    bytes, so a side of gigabytes may look small enough for the driver.
    """
    return left.join(right.hint("merge"), on, how)


def join_hot(left: DataFrame, right: DataFrame, on: str, share: float = HOT) -> DataFrame:
    """left joined to right, both materialised; right has one row of fixed width for a key, left any number.

    Rows of hot keys stay where they are and meet the few rows of right that they need by
    broadcast, so that no task gets all rows of a key. The others are shuffled.
    """
    n = left.count()
    if n <= COLD:
        return left.join(right, on)
    hot = cut(left.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= max(1000, int(n * share))).select(on), n)  # at most 1 / share rows
    if hot.isEmpty():
        return left.join(right, on)
    few = cut(right.join(F.broadcast(hot), on, "left_semi"), 0)
    return left.join(F.broadcast(few), on).unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str, data: bytes | None = None):
    """Write a whole file under a temporary name and rename it, so that a task run again or twice leaves one whole file.

    With data it is written at once; else a context manager gives the open stream.
    """

    class Out:
        def __enter__(self):
            self.fs, self.path = filesystem(uri)
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.temp = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"
            self.stream = self.fs.open_output_stream(self.temp)
            return self.stream

        def __exit__(self, kind, *rest):
            self.stream.close()
            if kind is None:
                self.fs.move(self.temp, self.path)
            else:
                self.fs.delete_file(self.temp)

    if data is None:
        return Out()
    with Out() as stream:
        stream.write(data)
    return None


def open_input(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def listing(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a folder's files, sorted; none if there is no folder."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    base = path.rstrip("/")
    return sorted((f"{uri.rstrip('/')}{i.path[len(base):]}", i.size) for i in found if i.is_file and not os.path.basename(i.path).startswith("."))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def utf32(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def batches(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
