"""Deterministic sampling, sharding and batch schedules: a hash of (seed, key) takes the place of a random generator.

Rows with one key are drawn alike; a null key counts as a missing part of the hash. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import numeric as N
from ..functions import text as X
from .ranking import ranked


def hash_hex(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash."""
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def choose(options: list[str], *parts: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(unit(*parts) * len(options)) + 1).cast("int"))


#: Rows of a bucket of the shuffled order, about.
BUCKET_ROWS = 50_000


def shuffled(df: DataFrame, groups: list[str], key: str, seed: str, name: str = "position", size: str | None = None) -> DataFrame:
    """Number rows from 1 in an order drawn by hash. The order's first digits are the buckets, as many as the rows ask for.

    Rows with one key are in any order; a null key is a key.
    """
    digits = max(1, math.ceil(math.log(max(1, df.count() / BUCKET_ROWS), 16)))
    df = df.withColumn("_h", hash_hex(seed, F.col(key)))
    return ranked(df, groups, F.substring("_h", 1, digits), [F.col("_h"), F.col(key)], name, size).drop("_h")


def shard(df: DataFrame, key: str, world: int, seed: str) -> DataFrame:
    """Adds `shard`: rows rank, rank+world, ... of the shuffled order."""
    return shuffled(df.withColumn("_all", F.lit(1)), ["_all"], key, seed).withColumn("shard", F.pmod(F.col("position") - 1, F.lit(world))).drop("_all")


def batches(df: DataFrame, source: str, key: str, sizes: dict[str, int], repeats: dict[str, int], seed: str, size: int = 1, repeat: int = 1) -> DataFrame:
    """Adds `batch`, `cycle`, `slot`: batches of a source are consecutive runs, `repeats` of them in every cycle.

    Sources without an entry take `size` and `repeat`.
    """
    out = shuffled(df, [source], key, seed)

    def pick(table: dict[str, int], default: int) -> Column:
        value = F.lit(default)
        for k, v in table.items():
            value = F.when(F.col(source) == k, F.lit(v)).otherwise(value)
        return value

    out = out.withColumn("batch", F.floor((F.col("position") - 1) / pick(sizes, size)))
    r = pick(repeats, repeat)
    return out.withColumn("cycle", F.floor(F.col("batch") / r)).withColumn("slot", F.pmod("batch", r))


def draw(dist: dict, *parts: Column | str) -> Column:
    """A parameter from its distribution: {"type": "fix", "value"}, or "uniform" (loc, scale), or "truncnorm" (a, b, loc, scale)."""
    kind = dist["type"]
    if kind == "fix":
        return F.lit(float(dist["value"]))
    u = unit(*parts)
    if kind == "uniform":
        return dist.get("loc", 0.0) + dist.get("scale", 1.0) * u
    if kind == "truncnorm":
        return N.truncated_normal(u, dist["a"], dist["b"], dist.get("loc", 0.0), dist.get("scale", 1.0))
    raise ValueError(f"no such distribution: {kind}")


def mixed_caption(text: Column, p: float, *parts: Column | str) -> Column:
    """The sentence on the camera alone for a share p of the rows, else the whole caption."""
    return F.when(unit(*parts) < p, X.camera_sentence(text)).otherwise(text)


def square_crop(w: Column, h: Column, *parts: Column | str) -> tuple[Column, Column, Column]:
    """Left, top and side of a square as large as the image allows, at a place drawn by hash."""
    side = F.least(w, h)
    at = F.floor(unit(*parts) * (F.abs(w - h) + 1)).cast("int")
    return F.when(w > h, at).otherwise(0), F.when(w > h, 0).otherwise(at), side


def camera_walk(reach: float, *parts: Column | str) -> tuple[Column, Column, Column]:
    """Roll and pitch within `reach`, and yaw within twice of it, from 0 to a turn."""
    roll, pitch, yaw = ((2 * unit(*parts, F.lit(k)) - 1) * reach for k in ("roll", "pitch", "yaw"))
    return roll, pitch, F.when(yaw < 0, 2 * yaw + C.TURN).otherwise(2 * yaw)


def looped(total: int, loop: int):
    """(size, index of a position column): positions 0 to size - 1 walk over `loop` rows again and again, whole rounds only."""
    return total - total % loop, lambda position: F.pmod(position, F.lit(loop))


def mean_batch(sizes: dict[str, int], repeats: dict[str, int]) -> int:
    """Rows of an average batch over a cycle."""
    return sum(sizes[k] * repeats[k] for k in sizes) // sum(repeats[k] for k in sizes)


def offsets(counts: DataFrame, source: str, count: str) -> DataFrame:
    """Adds `end` and `start`: where each source's rows lie when sources follow one another by name. One row per source."""
    from pyspark.sql import Window

    w = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("end", F.sum(count).over(w)).withColumn("start", F.col("end") - F.col(count))


def mixture(parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows of all sources with `source` and `weight`, the batches that it gets in a cycle; a column that a source lacks is null there."""
    out = None
    for name, (df, weight) in parts.items():
        df = df.withColumns({"source": F.lit(name), "weight": F.lit(weight)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def collate(df: DataFrame, batch: str, key: str, columns: list[str], sized: str | None = None) -> DataFrame:
    """A row per batch with an array of each column, in the order of `key`; empty samples (null key) are left out.

    `sized` names an array column whose size must be one in a batch; otherwise reading the batch is an error.
    """
    rows = df.where(F.col(key).isNotNull())
    packed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), *columns))).alias("_r"))
    out = packed.select(batch, *[F.col("_r").getField(c).alias(c) for c in columns])
    if sized:
        n = F.array_distinct(F.transform(sized, F.size))
        out = out.where(F.when(F.size(n) <= 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{sized} differs in size within a batch")).cast("boolean")))
    return out
