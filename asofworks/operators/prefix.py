"""Running sums and places over keys of any size: no key has to fit one task.

Rows are put in order by ranges of (key, order), so that a key with a third of
all rows lies in many ranges. Sums run within a range; what a key has in all
earlier ranges comes from one row a key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import saved


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with the sum of each column (sums: new name to column) over its own row and those before it of its keys.

    Rows of equal order stand in any order, the same in all sums.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    w = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = saved(ranged.withColumns({name: F.sum(c).over(w) for name, c in sums.items()}))  # ranges keep their numbers
    totals = own.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range of a key
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    both = own.join(offsets, [*keys, "_range"])
    return both.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_range", *[f"_{name}" for name in sums])
