"""Row numbers without putting a whole group into one task.

Rows are numbered inside buckets that follow the order, and a bucket's rows start after those of the buckets before it.
Only one count per group and bucket is added up by a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def ranged(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Adds `_b`, buckets of about equal numbers of rows in the order of `groups` and `order`: as many as Spark's range partitions.

    Their edges come from a sample of the rows, so the table is written: read again, a row has the bucket that it had.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *groups, *order).withColumn("_b", F.spark_partition_id()), "ranged")


def ranked(df: DataFrame, groups: list[str], bucket: Column | None, order: list[Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds `name`, the row number from 1 within `groups`; buckets must be in the order of `order`, and by default are ranges of it.

    `size` names a column for the group's row count. Ties in `order` are in any order; where many rows tie, end it with a key that doesn't.
    Null groups are a group, and null order values come first. An empty table gives none.
    """
    df = df.withColumn("_b", bucket) if bucket is not None else ranged(df, groups, order)
    counts = df.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*groups)
    before = counts.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col("_b").alias("_bb"),
        F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(over).alias("_total"),
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order))
    on = F.col("_b").eqNullSafe(F.col("_bb"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = df.withColumn("_in", inside).join(before, on).withColumn(name, F.col("_before") + F.col("_in"))
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.drop("_b", "_bb", "_in", "_before", "_total", *[f"_{g}" for g in groups])
