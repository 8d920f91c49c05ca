"""Evaluation metrics over long tables of (group, error).

A null error counts nowhere. NaN is skipped by means, medians and quantiles (`finite`), and is an infinite error for recall and areas (`as_miss`).
Ties are counted one by one, in any order. A null group is a group. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged
from .store import written

INF = float("inf")


def finite(e: Column) -> Column:
    """The value, or null where it is NaN: aggregates then skip it."""
    return F.when(~F.isnan(e), e)


def as_miss(e: Column) -> Column:
    """NaN counts as an infinite error."""
    return F.nanvl(e, F.lit(INF))


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "e")


def quantile(df: DataFrame, groups: list[str], value: Column, q: float, name: str, lower: bool = False) -> DataFrame:
    """The exact quantile `name` of each group, nulls skipped: interpolated, or with `lower` the first value that covers the share.

    Equal values are counted first, and the counts put into ranges of their order, as many as a shuffle has tasks. The ranges' sums tell the one or two that
    hold the wanted ranks; only their values are added up one by one, so no group is held or sorted in one task, and equal values
    are one row. A group of nulls has no row.
    """
    rows = df.select(*groups, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    points = ranged(rows.groupBy(*groups, "_v").agg(F.count("*").alias("_c")), groups, [F.col("_v")])
    over = Window.partitionBy(*groups)
    sums = points.groupBy(*groups, "_b").agg(F.sum("_c").alias("_bc"))
    sums = sums.withColumns({"_n": F.sum("_bc").over(over), "_before": F.sum("_bc").over(over.orderBy("_b")) - F.col("_bc")})
    place = F.col("_n") * q if lower else (F.col("_n") - 1) * q
    low, high = (F.greatest(F.ceil(place) - 1, F.lit(0)),) * 2 if lower else (F.floor(place), F.ceil(place))
    sums = sums.where((F.col("_before") <= high) & (F.col("_before") + F.col("_bc") > low)).drop("_bc")
    near = matched(points, sums, [*groups, "_b"])
    inside = F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy("_v"))
    near = near.withColumn("_end", F.col("_before") + inside)

    def of(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank), F.col("_v")))

    ends = near.groupBy(*groups, "_n").agg(of(low).alias("_lo"), of(high).alias("_hi"))
    between = (high - place) * F.col("_lo") + (place - low) * F.col("_hi")
    return ends.select(*groups, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(name))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null equals null; the keys appear once."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def summary(long: DataFrame, digits: int = 3) -> DataFrame:
    """Mean and median by metric, NaN ignored."""
    e = finite(F.col("e"))
    means = long.groupBy("metric").agg(F.round(F.avg(e), digits).alias("mean"))
    out = matched(means, quantile(long, ["metric"], e, 0.5, "median"), ["metric"], "left")
    return out.select("metric", "mean", F.round("median", digits).alias("median"))


def recall_at(long: DataFrame, thresholds: list[float]) -> DataFrame:
    """Share of errors strictly below each threshold."""
    e = as_miss(F.col("e"))
    wide = long.groupBy("metric").agg(*[F.avg((e < t).cast("double")).alias(str(i)) for i, t in enumerate(thresholds)])
    at = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"`{i}`").alias("recall")) for i, t in enumerate(thresholds)])
    return wide.select("metric", F.inline(at))


def auc(long: DataFrame, thresholds: list[float], floor: float | None = 1.0) -> DataFrame:
    """Area under the recall curve up to each threshold, over the threshold.

    Equal errors are counted first, of those up to the greatest threshold, and put into ranges of their order: no metric is sorted in one task,
    and any number of equal errors is one row. The previous error of a range's first one is the greatest of the range before it.
    """
    top, least = float(max(thresholds)), floor if floor is not None else -1.0
    rows = long.select("metric", as_miss(F.col("e")).alias("e"))
    counts = rows.groupBy("metric", "e").agg(F.count("*").alias("c"))
    counts = written(counts, "errors")
    sizes = counts.groupBy("metric").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("e") <= least, F.col("c"))), F.lit(0)).alias("low"))
    curve = ranged(counts.where((F.col("e") <= top) & (F.col("e") > least)), ["metric"], [F.col("e")])
    w = Window.partitionBy("metric").orderBy("_b")
    ends = curve.groupBy("metric", "_b").agg(F.sum("c").alias("bc"), F.max("e").alias("m"))
    ends = ends.select("metric", "_b", (F.sum("bc").over(w) - F.col("bc")).alias("before"), F.lag("m").over(w).alias("m_before"))
    inside = Window.partitionBy("metric", "_b").orderBy("e")
    start = 0.0 if floor is None else float(floor)
    points = curve.withColumns({"i": F.sum("c").over(inside), "p": F.lag("e").over(inside)})
    points = matched(matched(points, ends, ["metric", "_b"]), sizes, ["metric"])
    last = F.col("low") + F.col("before") + F.col("i")
    # Of equal errors only the first one adds an area.
    points = points.select("metric", "e", (last / F.col("n")).alias("r"), ((F.col("e") - F.coalesce("p", "m_before", F.lit(start))) * (2 * (last - F.col("c")) + 1) / (2 * F.col("n"))).alias("area"))
    sums = points.groupBy("metric").agg(
        *[F.sum(F.when(F.col("e") <= t, F.col("area"))).alias(f"a{i}") for i, t in enumerate(thresholds)],
        *[F.max(F.when(F.col("e") <= t, F.struct("e", "r"))).alias(f"l{i}") for i, t in enumerate(thresholds)],
    )
    all_ = matched(sizes, sums, ["metric"], "left")
    s = F.col("low") / F.col("n")

    def one(i: int, t: float) -> Column:
        last_e = F.coalesce(F.col(f"l{i}.e"), F.lit(start))
        last_r = F.coalesce(F.col(f"l{i}.r"), s)
        whole = (start * s + F.coalesce(F.col(f"a{i}"), F.lit(0.0)) + (t - last_e) * last_r) / t
        return F.when(F.lit(t < start), s).otherwise(whole)

    at = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.round(one(i, float(t)), 4).alias("auc")) for i, t in enumerate(thresholds)])
    return all_.select("metric", F.inline(at))


def rolling_mean(df: DataFrame, order: str, value: str, rows: int = 100, block: int = 100_000) -> DataFrame:
    """Mean of the last `rows` values by a dense row number `order`; blocks overlap, so that no task holds all rows."""
    own = df.withColumn("_blk", F.floor(F.col(order) / block)).withColumn("_own", F.lit(True))
    tail = df.where(F.col(order) % block > block - rows).withColumn("_blk", F.floor(F.col(order) / block) + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy("_blk").orderBy(order).rowsBetween(-(rows - 1), 0)
    return own.unionByName(tail).withColumn("rolling", F.avg(value).over(w)).where("_own").drop("_blk", "_own")


def weighted_mean(error: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(error * weight), F.sum(weight))


def precision_recall(df: DataFrame, groups: list[str], score: str, label: Column, bucket: Column) -> DataFrame:
    """Precision and recall at each distinct score, the rows at or above it taken as positive.

    Rows are added up by score, scores inside buckets, and buckets over the group, so that no group is sorted in one task.
    `bucket` is a non-decreasing function of the score. Recall is null in a group without positives.
    """
    points = df.groupBy(*groups, score, bucket.alias("_b")).agg(F.count("*").alias("_n"), F.sum(label.cast("long")).alias("_p"))
    over = Window.partitionBy(*groups)
    down = over.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = points.groupBy(*groups, "_b").agg(F.sum("_n").alias("_bn"), F.sum("_p").alias("_bp"))
    sums = sums.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col("_b").alias("_bb"),
        F.coalesce(F.sum("_bn").over(down), F.lit(0)).alias("_an"),
        F.coalesce(F.sum("_bp").over(down), F.lit(0)).alias("_ap"),
        F.sum("_bp").over(over).alias("_all"),
    )
    on = F.col("_b").eqNullSafe(F.col("_bb"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*groups, "_b").orderBy(F.desc(score))
    n, p = F.sum("_n").over(inside), F.sum("_p").over(inside)
    rows = points.withColumns({"_cn": n, "_cp": p}).join(sums, on)
    hit = F.col("_ap") + F.col("_cp")
    return rows.select(*groups, score, (hit / (F.col("_an") + F.col("_cn"))).alias("precision"), F.try_divide(hit, "_all").alias("recall"))
