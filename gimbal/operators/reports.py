"""Evaluation reports: which metrics are summarised and how, and the files that hold them.

Results are a wide table with a row per sample, a report is a table of (name, value). Values that aren't finite are null in files and NaN again
when read. An empty result gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Names that are summarised, and those that get an area under the recall curve (fixed values).
SUMMARISED, ANGLES = "(_error$|recall|pixel)", "(roll|pitch|vfov|gravity)"


def selected(df: DataFrame) -> list[str]:
    """Numeric columns whose name tells that they are metrics."""
    import re

    return [c for c, kind in df.dtypes if kind.split("(")[0] in NUMERIC and re.search(SUMMARISED, c)]


def report(results: DataFrame, key: str, thresholds: list[float], digits: int = 3) -> DataFrame:
    """(name, value): mean and median of every metric, NaN skipped, and areas at the thresholds for angles, NaN a miss."""
    names = selected(results)
    long = M.long_form(results.select(key, *[F.col(c).cast("double") for c in names]), [key], names)
    stats = M.summary(long, digits)
    pairs = F.array(*[F.struct(F.concat(F.lit(f"{n}_"), F.col("metric")).alias("name"), F.col(n).alias("value")) for n in ("mean", "median")])
    out = stats.select(F.inline(pairs))
    if thresholds:
        areas = M.auc(long.where(F.col("metric").rlike(ANGLES)), thresholds)
        label = F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", "")
        out = out.union(areas.select(F.concat(F.lit("auc_"), "metric", F.lit("@"), label), F.round("auc", digits)))
    return out


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != M.INF), value)


def save(report_: DataFrame, results: DataFrame, path: str) -> None:
    """The results as Parquet and the report as one JSON row per name, under one folder."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    report_.select("name", finite_or_null(F.col("value")).alias("value")).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summaries")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(report, results) of a saved evaluation; null is NaN again, and columns of nested arrays are left out."""
    summaries = spark.read.schema("name string, value double").json(f"{path}/summaries")
    results = spark.read.parquet(f"{path}/results")
    flat = [c for c, kind in results.dtypes if kind.count("array<") < 2]
    return summaries.withColumn("value", F.coalesce("value", F.lit(float("nan")))), results.select(*flat)


def lines(report_: DataFrame) -> DataFrame:
    """`name: value` with four decimals."""
    return report_.select(F.format_string("%s: %.4f", "name", "value").alias("value"))


def write_details(detailed: DataFrame, report_: DataFrame, path: str) -> None:
    """The detailed results as CSV with a header, and the report as text."""
    detailed.write.mode("overwrite").csv(f"{path}/detailed", header=True)
    lines(report_).write.mode("overwrite").text(f"{path}/summary")


def log_scalars(values: DataFrame, path: str) -> None:
    """Append (step, name, value) rows to a log of metrics."""
    values.select(F.col("step").cast("long"), "name", F.col("value").cast("double")).write.mode("append").parquet(path)


def against(results: DataFrame, key: str, model: str, reference: str, metrics: list[str]) -> DataFrame:
    """Each model's metrics less those of the reference model on the same sample; samples that the reference lacks are left out."""
    base = results.where(F.col(model) == reference).select(F.col(key).alias("_k"), *[F.col(m).alias(f"_{m}") for m in metrics])
    return results.join(base, F.col(key) == F.col("_k")).select(key, model, *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in metrics])


def by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """Mean of a value by category, and its mean where NaN counts as zero."""
    v = F.col(value)
    return df.groupBy(category).agg(F.avg(M.finite(v)).alias("mean"), F.avg(F.nanvl(v, F.lit(0.0))).alias("mean_zero"), F.count("*").alias("n"))


def converged(log: DataFrame, key: str, step: str, cost: str, atol: float, rtol: float, patience: int = 3) -> DataFrame:
    """Adds `change`, `stop` (close to the step before) and `stalled` (no less than the greatest of the `patience` costs before) to an iteration log.

    Windows are by `key`: one run's steps, of which there are a bounded number.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(step)
    before = F.lag(cost).over(w)
    worst = F.max(cost).over(w.rowsBetween(-patience, -1))
    full = F.count(cost).over(w.rowsBetween(-patience, -1)) == patience
    close = F.abs(F.col(cost) - before) <= atol + rtol * F.abs(before)
    return log.withColumns({"change": F.col(cost) - before, "stop": F.coalesce(close, F.lit(False)), "stalled": F.coalesce(full & (F.col(cost) >= worst), F.lit(False))})
