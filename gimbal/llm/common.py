"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: The most bits of a bitmap (8 MB).
MOST_BITS = 1 << 26

#: Lists of the tables written inside each `temporary` block that is open.
_open: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors. Inside `temporary` the table is deleted at its end."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    for held in _open:
        held.append(path)
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, and let Spark clear the shuffle files of their making, which it does as the driver's JVM collects garbage."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Tables materialised inside are deleted at the end, but for those whose `written` path the block takes off the list."""
    held: list[str] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.remove(held)
        discard(spark, *held)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does the same on pure ASCII, and is faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sample_ids(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` distinct non-null ids, picked by hash: the bound of a training sample.

    The result has `limit` ids of 8 bytes at most, so it may be broadcast.
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def bitmap(rows: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """Bits of the hashes in a column: `bits` (a power of two), or some 16 for each and at most MOST_BITS in all."""
    bits = bits or 1 << min(MOST_BITS.bit_length() - 1, max(10, (16 * rows.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def maybe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among those of the bitmap; none that is there is missed."""
    at = hashes & (len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def map_text(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    fields: T.StructType,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    slice_rows: int = 512,
) -> DataFrame:
    """Apply a vectorised Python function to a text column, partition by partition, without a shuffle.

    `make()` runs once in each task and returns a function from texts (null as empty) to columns of `fields`.
    `keep` columns pass through untouched, except those that `fields` replaces.
    Rows are handled in slices of `slice_rows`, so a batch never holds more working memory than that.
    """
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])
    own = keep.index(text_col) if text_col in keep else len(keep)
    picked = df.select(*[F.col(f"`{c}`") for c in [*keep, text_col][: max(own, len(keep) - 1) + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                made = work([x or "" for x in part.column(own).to_pylist()])
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(made[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return picked.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BooleanType: pa.bool_(),
    }[type(kind)]
