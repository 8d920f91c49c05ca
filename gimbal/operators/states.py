"""Histograms and precision-recall curves as tables of counts that grow by batches and are merged by adding.

A batch is counted once, between fixed edges, and its counts are appended under its name; a batch written again replaces itself, so that
a job that is run anew counts nothing twice. Merging reads counts only, of which there are at most as many as bins for each batch
and tag: rows of the batches before are never read again. Every row is counted: null and NaN in a bin without a number, values outside of the edges in one
below the first (-1) and one past the last (as many as there are bins). An empty batch appends no counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Thresholds of a precision-recall curve (a fixed value).
THRESHOLDS = 127


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin between equal edges that holds the value; the last one holds its upper edge too."""
    v = value.cast("double")
    inside = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return F.when(v.isNull() | F.isnan(v), None).when(v < low, -1).when(v > high, bins).otherwise(inside).cast("int")


def histograms(df: DataFrame, tags: list[str], values: dict[str, tuple[float, float]], bins: int = 100) -> DataFrame:
    """(tags, name, bin, n) of columns `values`, each between its own edges; all of them in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), bin_of(F.col(c), *edges, bins).alias("bin")) for c, edges in values.items()])
    return df.select(*tags, F.inline(each)).groupBy(*tags, "name", "bin").agg(F.count("*").alias("n"))


def scores(df: DataFrame, tags: list[str], score: str, label: Column, thresholds: int = THRESHOLDS) -> DataFrame:
    """(tags, bin, n, p): rows and positive ones by the greatest threshold k / (thresholds - 1) that the score, cut to [0, 1], reaches. A null label is not positive."""
    s = F.col(score).cast("double")
    reached = F.when(~F.isnan(s), F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * (thresholds - 1)).cast("int"))
    hit = F.coalesce(label, F.lit(False)).cast("long").alias("_p")
    return df.select(*tags, reached.alias("bin"), hit).groupBy(*tags, "bin").agg(F.count("*").alias("n"), F.sum("_p").alias("p"))


def append(state: DataFrame, path: str, batch: str | int) -> None:
    """Add a batch's counts to the log at `path`, in place of those that the same batch may have left there."""
    rows = state.withColumn("batch", F.lit(str(batch)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all batches of a log."""
    log = spark.read.parquet(path)
    counts = [c for c in ("n", "p") if c in log.columns]
    keys = [c for c in log.columns if c not in (*counts, "batch")]
    return log.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def edges(state: DataFrame, values: dict[str, tuple[float, float]], bins: int = 100) -> DataFrame:
    """Histogram counts with the edges `low` and `high` of their bins; open ones, and those of no bin, are null."""
    low = width = F.lit(None).cast("double")
    for c, (a, b) in values.items():
        low, width = (F.when(F.col("name") == c, v).otherwise(x) for v, x in ((a, low), ((b - a) / bins, width)))
    k = F.col("bin")
    return state.withColumns({"low": F.when(k >= 0, low + k * width), "high": F.when(k < bins, low + (k + 1) * width)})


def curve(state: DataFrame, tags: list[str], thresholds: int = THRESHOLDS) -> DataFrame:
    """(tags, threshold, precision, recall) at every threshold; rows without a score count as never called.

    The windows are by tag, over at most `thresholds` rows. Precision is null where nothing is called, recall where nothing is positive.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("bin")
    grid = state.select(*tags).distinct().select("*", steps, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"))
    full = state.select(*tags, "bin", "n", "p").unionByName(grid).groupBy(*tags, "bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    over = Window.partitionBy(*tags)
    down = over.orderBy(F.desc_nulls_last("bin")).rowsBetween(Window.unboundedPreceding, 0)
    called, hit, all_ = F.sum("n").over(down), F.sum("p").over(down), F.sum("p").over(over)
    out = full.select(*tags, "bin", called.alias("called"), hit.alias("hit"), all_.alias("positive")).where("bin IS NOT NULL")
    return out.select(*tags, (F.col("bin") / (thresholds - 1)).alias("threshold"), F.try_divide("hit", "called").alias("precision"), F.try_divide("hit", "positive").alias("recall"))
