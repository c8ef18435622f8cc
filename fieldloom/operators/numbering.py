"""Numbers in an order, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.checkpoint import cut


def numbered(df: DataFrame, *order: str, out: str = "r") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of some columns that no two rows share.

    Rows are range-partitioned and numbered within partitions; how many rows the partitions before
    hold, a row for each partition, comes to the driver. The result is checkpointed.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = cut(spread.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    sums, starts = 0, []
    for part, n in sorted(within.groupBy("__part").count().collect()):
        starts.append((part, sums))
        sums += n
    offsets = df.sparkSession.createDataFrame(starts, "__p int, __start bigint")
    place = F.col("__start") + F.col("__id") - F.shiftleft(F.col("__part").cast("bigint"), 33)
    return within.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(out, place).drop("__part", "__id", "__p", "__start")
