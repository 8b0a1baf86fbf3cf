"""Ranks over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a 1-based rank in ``order``, which should be total.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the sizes of the
    partitions before it, a number per partition that comes to the driver.
    """
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "rank")
    sizes = rows.groupBy(part.alias("p")).count().orderBy("p").collect()
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(int(p)), F.lit(total)]
        total += n
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_id")
    start = F.element_at(F.create_map(*starts), part.cast("int"))
    return rows.withColumn(name, (start + place + 1).cast("long")).drop("_id")
