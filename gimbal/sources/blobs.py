"""A file per row: images and tensors, written below a folder by name and read back at any depth.

Files are read by Spark's own binary source, which knows every store and splits them among tasks, and are decoded in the task. They are
written by a data source of ours: a task writes hidden files beside their places and renames them when all its rows are
written, so that a failed attempt leaves nothing to be seen; a failed job takes back what its tasks had renamed, and a whole one is marked by `_SUCCESS`.
A file that can't be decoded has a row too, with nulls and the reason.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import codecs
from .tables import below

IMAGES = "name string, width int, height int, channels int, depth int, pixels array<int>, reason string"
MEANS = "name string, shape array<int>, kind string, means array<double>, reason string"
TENSORS = "name string, shape array<int>, kind string, values array<double>, reason string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FilesWriter(DataSourceWriter):
    """Writes rows (name, content) as files below `path`."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _store(self.path)
        own, done, moved = f".{uuid.uuid4().hex}", [], []
        try:
            for name, content in iterator:
                if name is None or content is None:
                    raise ValueError(f"a row without name or content: {name}")
                folder, _, last = f"{base}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                if not self.overwrite and store.get_file_info(f"{folder}/{last}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{name} is there already")
                hidden = f"{folder}/{own}-{len(done)}"
                done.append((hidden, f"{folder}/{last}"))
                with store.open_output_stream(hidden) as out:
                    out.write(bytes(content))
            for hidden, to in done:
                store.move(hidden, to)
                moved.append(to)
        except BaseException:
            for f in [*(h for h, _ in done), *moved]:
                if store.get_file_info(f).type != fs.FileType.NotFound:
                    store.delete_file(f)
            raise
        return Written(moved)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for f in (p for m in messages if m for p in m.paths):
            store.delete_file(f)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gimbal_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, path: str, overwrite: bool = False, names: DataFrame | None = None) -> None:
    """Write (name, content) as files below `path`, names with folders and all. A null, or a name that occurs twice, is an error before anything is
    written; so is, without `overwrite`, a file that is there already, and then nothing of its task is kept. Contents are made twice for this, unless `names` has the same names without them: then a null content is an error of its task."""
    rows = df.select("name", "content")
    empty = F.col("content").isNull() if names is None else F.lit(False)
    wrong = (rows if names is None else names.select("name")).groupBy("name").agg(F.count("*").alias("n"), F.bool_or(empty).alias("empty"))
    if bad := wrong.where("n > 1 OR name IS NULL OR empty").limit(5).collect():
        raise ValueError(f"names that occur twice, or rows without name or content: {', '.join(str(r.name) for r in bad)}")
    df.sparkSession.dataSource.register(Files)
    rows.write.format("gimbal_files").mode("overwrite" if overwrite else "append").save(path)


def _decoded(spark: SparkSession, folder: str, pattern: str, schema: str, decode: Callable[[bytes], tuple], nulls: int) -> DataFrame:
    """Files of a folder at any depth, by name below it, a batch at a time; whatever the decoder refuses becomes nulls and a reason."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    raw = raw.select(below(F.col("_metadata.file_path"), folder).alias("name"), "content")
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    row = (*decode(data.as_buffer().to_pybytes()), None)
                except ValueError as e:
                    row = (*[None] * nulls, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, *row), arrow)], schema=arrow)

    return raw.mapInArrow(run, schema)


def image_files(spark: SparkSession, folder: str, pattern: str = "*", as_grey: bool = False) -> DataFrame:
    """IMAGES: the images of a folder, pixels row by row, channels together; with `as_grey` a single channel."""

    def decode(data: bytes) -> tuple:
        pixels = codecs.decode_image(data)
        pixels = codecs.grey(pixels) if as_grey else pixels
        return pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.dtype.itemsize * 8, pixels.ravel().astype(np.int32)

    return _decoded(spark, folder, pattern, IMAGES, decode, 5)


def tensor_files(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """TENSORS: the .npy files of a folder, values in C order, `kind` the type they have in the file."""

    def decode(data: bytes) -> tuple:
        values = codecs.decode_npy(data)
        return list(values.shape), values.dtype.name, values.ravel().astype(np.float64)

    return _decoded(spark, folder, pattern, TENSORS, decode, 3)


def tensor_means(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """MEANS: of each .npy file of a folder the means over all but its first axis. Values are read whole, and stay in the task."""

    def decode(data: bytes) -> tuple:
        values = codecs.decode_npy(data)
        first = values.shape[0] if values.ndim else 1
        parts = values.reshape(first, values.size // max(first, 1)).astype(np.float64)
        return list(values.shape), values.dtype.name, [float(p.mean()) if p.size else None for p in parts]

    return _decoded(spark, folder, pattern, MEANS, decode, 3)


def encoded_images(df: DataFrame, form: str = "png", filters: tuple[int, ...] = (2,)) -> DataFrame:
    """(name, content) of rows with name, width, height, channels, depth (8 or 16) and pixels; `form` is png or ppm. A value beyond the depth is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for w, h, c, d, pixels in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), batch.column(5)):
                values = pixels.values.to_numpy(zero_copy_only=False).reshape(h, w, c)
                if values.min() < 0 or values.max() >= 1 << d:
                    raise ValueError("a pixel beyond its depth")
                values = values.astype(np.uint8 if d == 8 else np.uint16)
                made.append(codecs.encode_png(values, filters) if form == "png" else codecs.encode_netpbm(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    rows = df.select("name", *[F.col(c).cast("int") for c in ("width", "height", "channels", "depth")], F.col("pixels").cast("array<int>"))
    return rows.mapInArrow(run, "name string, content binary")


def encoded_tensors(df: DataFrame, shape: tuple[int, ...], columns: list[str], kind: str = "float32") -> DataFrame:
    """(name, content): each row's array columns, one after the other, as a .npy file of `shape`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                content = codecs.encode_npy(np.concatenate(parts).astype(kind).reshape(shape))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([content], pa.binary())], names=["name", "content"])

    return df.select("name", *columns).mapInArrow(run, "name string, content binary")
