"""Dense positions in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import cut


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Materialised: df with the LONG position, from 0, of each row in the order of the columns.

    Rows are range-partitioned; ranks inside a range are shifted by the sizes of the ranges
    before it, of which there are as many as partitions. Equal rows may swap positions.
    """
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the id's low 33 bits count the rows of a partition in the order they stand
    at = F.monotonically_increasing_id()
    placed = cut(ranges.withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # a row for each partition
    return placed.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")
