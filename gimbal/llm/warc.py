"""WARC archives and a two-level capture index.

Writing: each task streams its pages into gzip-member WARC files in the shared folder; identical payloads after the
first become revisit records. Index: keys (reversed host and path, then page and digest) are range-sorted, cut into
compressed blocks, and a sparse directory keeps each block's first key. Reading: requests are range-sorted too; a
binary search in the directory of one shard finds the block, one in the block finds the entries, and the records are
fetched by range reads in file order.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import folder as fresh_folder
from .common import materialise

#: Entries in a compressed index block, decompressed blocks that a reader keeps, and index shards at most.
BLOCK_ENTRIES, CACHED_BLOCKS, MAX_SHARDS = 2_000, 8, 4_096
#: A WARC file is closed and the next one opened at this many bytes.
FILE_BYTES = 1 << 30

ENTRY = "key string, page_id long, digest string, file string, at long, size long"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder that Spark names; Hadoop's names of the S3 scheme are one to pyarrow."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query; scheme, user, fragment and a leading `www.` are dropped. Null is empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return f"!{url}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def _base32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def payload_digest(payload: bytes) -> str:
    return _base32(hashlib.sha1(payload).digest())


def _record(url: str, page_id, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else quote(c) for c in url or "urn:none"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Truncated: length",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload facts of one decompressed record; a response's digest is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) not in ("", "None") else None
    return {
        "page_id": number(h["WARC-Record-ID"]),
        "url": h["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": h["WARC-Type"],
        "refers_to": number(h["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _attempt() -> str:
    """A name that no other attempt of this task shares; only a successful attempt's names get into the tables."""
    c = TaskContext.get()
    return f"{c.partitionId() if c else 0:06d}-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, folder: str, level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html, digest, first_id, revisit) as WARC files; returns the entry of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                made: dict[str, list] = {k: [] for k in ("key", "page_id", "digest", "file", "at", "size")}
                for i in range(batch.num_rows):
                    page, url, html, digest, first, revisit = (batch.column(c)[i].as_py() for c in range(6))
                    digest = _base32(digest)
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{_attempt()}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(_record(url, page, (html or "").encode(), digest, first, revisit), level, mtime=0)
                    out.write(member)
                    for k, v in zip(made, (url_key(url), page, digest, name, at, len(member))):
                        made[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(made, schema=_ENTRY)
        finally:
            if out is not None:
                out.close()

    return pages.select("page_id", "url", "html", "digest", "first_id", "revisit").mapInArrow(run, ENTRY)


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
SORT = ["key", "page_id", "digest"]


def _sortable(key: str, page, digest: str) -> str:
    """One string in the order of (key, page, digest), nulls first: as Spark sorts them."""
    return f"{key}\x00{'' if page is None else f'{page + (1 << 63):020d}'}\x00{digest}"


def write_index(entries: DataFrame, folder: str, shards: int, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sort entries into `shards` index files of compressed blocks; returns (shard, first, last, blocks) of each file.

    Beside each file lies its sparse directory: the first key, place and size of every block. It is written last.
    """
    ordered = entries.withColumn("sort", _sort_column()).repartitionByRange(min(shards, MAX_SHARDS), "sort").sortWithinPartitions("sort", "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        name, out, at, block, directory, last = _attempt(), None, 0, [], [], ""

        def flush():
            nonlocal at, block
            raw = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            out.write(raw)
            directory.append((block[0][0], at, len(raw)))
            at, block = at + len(raw), []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sort", "file", "at", "size"))):
                out = out or store.open_output_stream(f"{root}/{name}.idx", compression=None)
                block.append(row)
                last = row[0]
                if len(block) >= block_entries:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pydict({"shard": [name], "first": [directory[0][0]], "last": [last], "blocks": [len(directory)]})

    return ordered.select("sort", "file", "at", "size").mapInArrow(run, "shard string, first string, last string, blocks long")


def _sort_column():
    page = F.when(F.col("page_id").isNull(), "").otherwise(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"))
    return F.concat_ws("\x00", "key", page, "digest")


class IndexReader:
    """Looks keys up: top level in memory, one shard's directory and a few blocks at a time."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.store, self.root = _file_system(folder)
        self.last, self.names = [s[0] for s in shards], [s[1] for s in shards]  # by last key
        self.shard, self.directory, self.firsts, self.file = None, [], [], None
        self.blocks: OrderedDict[tuple[str, int], tuple[list[str], list]] = OrderedDict()

    def _open(self, shard: str):
        if shard != self.shard:
            with self.store.open_input_file(f"{self.root}/{shard}.dir") as f:
                self.directory = json.loads(f.read())
            self.firsts = [d[0] for d in self.directory]
            if self.file is not None:
                self.file.close()
            self.file, self.shard = self.store.open_input_file(f"{self.root}/{shard}.idx"), shard

    def _block(self, i: int) -> tuple[list[str], list]:
        at = (self.shard, i)
        if at not in self.blocks:
            _, start, size = self.directory[i]
            rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, start)).decode().split("\n")]
            self.blocks[at] = ([r[0] for r in rows], rows)
            if len(self.blocks) > CACHED_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(at)
        return self.blocks[at]

    def lookup(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, at, size) of every entry with this key, also where it runs on into the next block or shard."""
        s = bisect.bisect_left(self.last, key)
        while s < len(self.names):
            self._open(self.names[s])
            b = max(0, bisect.bisect_left(self.firsts, key) - 1)
            while b < len(self.directory):
                keys, rows = self._block(b)
                i = bisect.bisect_left(keys, key)
                if i < len(keys) and keys[i] > key:
                    return
                while i < len(keys) and keys[i] == key:
                    yield tuple(rows[i][1:])
                    i += 1
                if i < len(keys):
                    return
                b += 1
            s += 1


def find(requests: DataFrame, folder: str, shards: list[tuple[str, str]], partitions: int) -> DataFrame:
    """(file, at, size) of the entries of requested `sort` keys. Requests are sorted, so each block is opened about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, shards)
        for batch in batches:
            found: list[tuple[str, int, int]] = []
            for key in batch.column("sort").to_pylist():
                for hit in reader.lookup(key):
                    found.append(hit)
                    if len(found) >= 50_000:
                        yield _hits(found)
                        found = []
            yield _hits(found)

    ordered = requests.select("sort").distinct().repartitionByRange(partitions, "sort").sortWithinPartitions("sort")
    return ordered.mapInArrow(run, "file string, at long, size long")


def _hits(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
    files, ats, sizes = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "at", "size"])


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(places: DataFrame, folder: str, partitions: int, with_payload: bool = False) -> DataFrame:
    """Range-read records at (file, at, size), in file order, and parse them; `with_payload` adds the bytes."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for f, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, store.open_input_file(f"{root}/{f}")
                rows.append(parse_record(gzip.decompress(file.read_at(size, at))))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    ordered = places.repartitionByRange(partitions, "file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, first_id, revisit): the smallest page of each payload is kept, the others refer to it.

    Rows that share the smallest id are responses all; a null id is greater than any other, and with no other
    in its group a response. Only groups of more than one row are joined back.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("bytes"))
    firsts = (
        rows.where(F.col("bytes") >= min_revisit_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.hex("sha").alias("s"), "first_id")  # another form of the key: Spark can split a hot payload's rows
    )
    joined = rows.join(firsts, F.hex("sha") == F.col("s"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.col("sha").alias("digest"), "first_id", revisit.alias("revisit"))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0, shards: int | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files, index them, and read every record back through the index.

    One row per page row: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload;
    characters that don't print are percent-encoded in the url;
    a null or bad url has a key of its own. Equal rows have equal keys and come back as often as they were
    written. An empty table gives no rows. Files live in the shared folder; a failed attempt's are never referred to.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    partitions = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = shards or partitions
    marked = mark_revisits(pages.select("page_id", "url", "html"), min_revisit_bytes)
    entries = materialise(write_archives(marked, f"{folder}/records"), "entries")
    top = materialise(write_index(entries, f"{folder}/index", shards), "shards")
    level = sorted((r.last, r.shard) for r in top.select("last", "shard").collect())  # MAX_SHARDS rows at most
    # The requests come from the pages, not from the entries.
    places = find(_requests(pages), f"{folder}/index", level, partitions)
    return read_records(places, f"{folder}/records", partitions)


def _requests(pages: DataFrame) -> DataFrame:
    """The sort key of every page's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("url", "page_id", "digest")))
            yield pa.RecordBatch.from_arrays([pa.array([_sortable(url_key(u), p, _base32(d)) for u, p, d in rows], pa.string())], names=["sort"])

    digest = F.unhex(F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    return pages.select("url", "page_id", digest.alias("digest")).mapInArrow(run, "sort string")
