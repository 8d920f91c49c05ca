"""Readers and writers of manifests, captions, camera tables, predictions and logs. Schemas are explicit.

Fields that a file lacks are null, and fields beyond the schema are not read. Rows keep no order. An empty folder gives no rows where the
schema is given; writers replace what is there, but for logs, which grow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import camera as C
from ..functions import text as X

MANIFEST = "image string, annotation string, camera string, image_init string"
CAMERAS = "fname string, roll double, pitch double, vfov double, width int, height int, px double, py double, k1 double, k2 double"
OUTPUTS = "id string, output_text string"
LOG = "iter long, loss double"


def manifest(spark: SparkSession, path: str, source: str | None = None, pattern: str = "*.json") -> DataFrame:
    """JSON arrays of rows: one file, or every file of a folder whose name fits."""
    df = spark.read.schema(MANIFEST).option("pathGlobFilter", pattern).json(path, multiLine=True)
    return df if source is None else df.withColumn("source", F.lit(source))


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all manifests; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def captions(spark: SparkSession, folder: str, field: str = "caption") -> DataFrame:
    """(annotation, text): a JSON object per file, keyed by its path below the folder at any depth; the text is stripped."""
    df = spark.read.schema(f"`{field}` string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    return df.select(below(F.col("_metadata.file_path"), folder).alias("annotation"), X.strip(F.coalesce(field, F.lit(""))).alias("text"))


def below(path: Column, folder: str) -> Column:
    """The part of a file's path after `folder`; Spark's paths are URLs, whose escapes are undone."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    tail = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", folder).strip("/") + "/"
    return F.substr(plain, F.instr(plain, F.lit(tail)) + F.lit(len(tail)))


def jsonl(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    return spark.read.schema(schema).json(path)


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera CSV with a header in any column order; the centre defaults to the middle, distortion to zero; adds the focal length."""
    df = spark.read.option("header", True).csv(path)
    kinds = [x.split(" ") for x in CAMERAS.split(", ")]
    df = df.select(*[(F.col(n).cast(k) if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds])
    filled = {"px": F.coalesce("px", F.col("width") / 2), "py": F.coalesce("py", F.col("height") / 2), "k1": F.coalesce("k1", F.lit(0.0)), "k2": F.coalesce("k2", F.lit(0.0))}
    return df.withColumns(filled).withColumn("f", C.fov2focal(F.col("vfov"), F.col("height")))


def model_outputs(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of (id, output_text); fields that lack are null."""
    return spark.read.schema(OUTPUTS).json(path, multiLine=True)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, size) of visible files at any depth in the order of their paths, without reading them."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.col("length").alias("size")).where(~F.startswith("name", F.lit("."))).orderBy("path")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output doesn't exist yet."""
    return todo.join(done.select(key), key, "left_anti")


def lookup(rows: DataFrame, cache: DataFrame, key: str = "name") -> DataFrame:
    """Rows with their cached prediction; a key without one is an error when its row is read."""
    hit = cache.withColumn("_hit", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string")))
    return rows.join(hit, key, "left").where(F.when(F.col("_hit"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_hit")


def rescaled(df: DataFrame, prefix: str, scale: str) -> DataFrame:
    """Array columns whose name begins with `prefix`, times the row's `scale`: cached points in the image's own size."""
    hit = [c for c, k in df.dtypes if c.startswith(prefix) and k.startswith("array")]
    return df.withColumns({c: F.transform(c, lambda x: x * F.col(scale)) for c in hit})


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with a header and six decimals."""
    cols = [F.format_string("%.6f", c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_by(df: DataFrame, column: str, path: str, form: str = "parquet") -> None:
    """Files by split or folder, as Parquet or as CSV with a header."""
    df.write.mode("overwrite").partitionBy(column).format(form).option("header", True).save(path)


def write_arrays(df: DataFrame, group: Column, path: str) -> None:
    """A folder with a JSON array of rows for each group: what `manifest` and `model_outputs` read. Groups are meant to be small."""
    packed = df.groupBy(group.alias("_g")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    packed.write.mode("overwrite").partitionBy("_g").text(path)


def duplicates(df: DataFrame, key: str = "name") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


#: A camera's parameters in the order of its array (fixed values).
VECTOR = ("w", "h", "fx", "fy", "cx", "cy", "k1", "k2")


def camera_vector(cam: dict[str, Column]) -> Column:
    return F.array(*[cam[k].cast("double") for k in VECTOR])


def batched(value: Column) -> Column:
    """A value as a batch of one."""
    return F.array(value)


def unbatched(value: Column) -> Column:
    """The first value of a batch; null for an empty one."""
    return F.get(value, F.lit(0))


def mapped(df: DataFrame, f, columns: list[str] | None = None) -> DataFrame:
    """`f` applied to every number in the columns (all by default), inside arrays, maps and structs at any depth; other values stay."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: of(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda k, v: of(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[of(value.getField(x.name), x.dataType).alias(x.name) for x in kind]))
        return f(value) if isinstance(kind, T.NumericType) else value

    return df.withColumns({c: of(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns or df.columns})


def required(df: DataFrame, keys: list[str], optional: list[str] = []) -> DataFrame:  # noqa: B006
    """The named columns; a required one that lacks is an error that names all that lack."""
    lacking = sorted(set(keys) - set(df.columns))
    if lacking:
        raise KeyError(f"missing columns: {', '.join(lacking)}")
    return df.select(*keys, *[c for c in optional if c in df.columns])


def projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV table of cameras; the others aren't parsed."""
    return required(cameras(spark, path), columns)


def export(df: DataFrame, path: str, keys: list[str], optional: list[str] = [], half: bool = False, callback=None) -> None:  # noqa: B006
    """Write predictions by name: required and optional columns, single precision if `half`; a name that occurs twice is an error."""
    df = callback(df) if callback else df
    df = required(df, ["name", *keys], optional)
    if twice := [r.name for r in duplicates(df).limit(5).collect()]:
        raise ValueError(f"names that occur twice: {', '.join(map(str, twice))}")
    narrow = {"double": "float", "array<double>": "array<float>"} if half else {}
    df.select(*[F.col(c).cast(narrow[k]) if k in narrow else F.col(c) for c, k in df.dtypes]).write.mode("overwrite").parquet(path)
