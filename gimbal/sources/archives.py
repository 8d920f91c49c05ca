"""Tar archives as a source of files: an index of members made once, members read by range.

The index is a table (archive, name, at, size, reason), for which only headers are read, an archive to a task. Reading deals
members to tasks by archive and place, so that a large archive is shared out, and a task reads what lies together at once.
Names are those of the `ustar`, GNU and pax forms; folders and links are no members. What an archive holds after damage
can't be found: it has a last row with a null name and the reason, and so has a compressed one. A file without a byte is no archive.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs, tables

INDEX = "archive string, name string, at long, size long, reason string"
#: Bytes of members that an archive takes when written, and that a task reads at once.
FULL, READ = 64 << 20, 8 << 20


def write_archives(df: DataFrame, path: str, parts: int, full: int = FULL) -> None:
    """Rows (name, content) as tar archives below `path`: rows are dealt by name to `parts` parts, and a part begins another archive when one is full.

    A name that occurs twice is kept twice, null content is empty. Archives have the names of their parts, so that a task that is run again makes the same ones.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed():
            tar.close()
            return pa.RecordBatch.from_pydict({"name": [f"{part:05d}-{n:05d}.tar"], "content": [out.getvalue()]}, schema=shape)

        out = tar = part = None
        n = 0
        for batch in batches:
            for p, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                if tar is None:
                    out, part = io.BytesIO(), p
                    tar = tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(name)
                info.size = len(content or b"")
                tar.addfile(info, io.BytesIO(content or b""))
                if out.tell() >= full:
                    yield closed()
                    tar, n = None, n + 1
        if tar is not None:
            yield closed()

    shape = pa.schema([("name", pa.string()), ("content", pa.binary())])
    dealt = df.select("name", "content").repartition(parts, "name").sortWithinPartitions("name", "content")
    rows = dealt.select(F.spark_partition_id().alias("part"), "name", "content")
    blobs.write_files(rows.mapInArrow(packed, "name string, content binary"), path)


def _headers(path: str) -> Iterator[tuple]:
    """(name, at, size, reason) of the members of an archive, by its headers alone."""
    store, place = blobs._store(path)
    with store.open_input_file(place) as f:
        try:
            with tarfile.open(fileobj=f, mode="r:") as tar:
                if f.size() < 1024:
                    raise tarfile.ReadError("shorter than the end of an archive")
                for m in tar:
                    if m.isreg():
                        if m.offset_data + m.size > f.size():
                            raise tarfile.ReadError(f"{m.name} is cut short")
                        yield m.name, m.offset_data, m.size, None
                    tar.members = []  # or the archive keeps all of them
                f.seek(tar.offset)  # the reader takes a damaged header for the end, which is a block of zeros
                if f.read(512) != bytes(512):
                    raise tarfile.ReadError(f"no header and no end at {tar.offset}")
        except (tarfile.TarError, EOFError, ValueError) as e:
            yield None, None, None, str(e) or type(e).__name__


def index(spark: SparkSession, folder: str, target: str, pattern: str = "*.tar") -> DataFrame:
    """INDEX of the archives of a folder at any depth, written to `target`; where that is there and whole already, it is only read."""
    store, place = blobs._store(target)
    if store.get_file_info(f"{place}/_SUCCESS").type == blobs.fs.FileType.NotFound:
        shape = pa.schema([("archive", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("reason", pa.string())])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    rows = []
                    for row in _headers(path):
                        rows.append(dict(zip(shape.names, (path, *row))))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

        found = tables.files(spark, folder, pattern)
        tasks = spark.sparkContext.defaultParallelism * 4
        found.select("path").repartition(tasks, "path").mapInArrow(walk, INDEX).write.mode("overwrite").parquet(target)
    return spark.read.schema(INDEX).parquet(target)


def members(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(archive, name, content) of rows of an index: all, or those that a filter or a join left. Rows with a reason have null content."""
    shape = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(got):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), shape)], schema=shape)

        opened, f, got, held = None, None, [], 0
        try:
            for batch in batches:
                for path, name, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                    if at is None:
                        got.append((path, name, None))
                        continue
                    if path != opened:
                        if f is not None:
                            f.close()
                        store, place = blobs._store(path)
                        f, opened = store.open_input_file(place), path
                    data = f.read_at(size, at)
                    if len(data) != size:
                        raise OSError(f"{path} isn't what was indexed: {name} ends early")
                    got.append((path, name, data))
                    held += size
                    if held >= READ or len(got) == 1000:
                        yield made(got)
                        got, held = [], 0
            if got:
                yield made(got)
        finally:
            if f is not None:
                f.close()

    by = ["archive", "at"]
    dealt = rows.select("archive", "name", "at", "size")
    dealt = (dealt.repartitionByRange(parts, *by) if parts else dealt.repartitionByRange(*by)).sortWithinPartitions(*by)
    return dealt.mapInArrow(read, "archive string, name string, content binary")


def extract(rows: DataFrame, folder: str) -> None:
    """Write members of an index as files below `folder`, names with their folders; those whose file is there already are neither read nor written.

    A name that leads out of the folder is an error before anything is written.
    """
    spark = rows.sparkSession
    whole = rows.where("at IS NOT NULL")
    parts = F.split("name", "/")
    out = whole.where(F.startswith("name", F.lit("/")) | F.array_contains(parts, "..")).limit(5).collect()
    if out:
        raise ValueError(f"names that lead out of the folder: {', '.join(r.name for r in out)}")
    store, place = blobs._store(folder)
    if store.get_file_info(place).type != blobs.fs.FileType.NotFound:
        there = tables.files(spark, folder).select(tables.below(F.col("path"), folder).alias("name"))
        whole = tables.pending(whole, there, "name")
    blobs.write_files(members(whole), folder)
