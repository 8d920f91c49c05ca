"""Image and tensor files: codecs by round trip and by hand, and the writer's promises."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gimbal.sources import blobs, codecs


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_round_trip(dtype, channels, filters):
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (7, 5), (6, 13)):
        pixels = rng.integers(0, np.iinfo(dtype).max + 1, (h, w, channels)).astype(dtype)
        got = codecs.decode_png(codecs.encode_png(pixels, filters))
        assert got.dtype == dtype and (got == pixels).all()


def by_hand(w, h, depth, colour, lines, *more, interlaced=0):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)
    return codecs.PNG + chunk(b"IHDR", head) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_of_few_bits_and_palettes():
    grey = codecs.decode_png(by_hand(10, 2, 1, 0, b"\0\xaa\x80\0\x01\x40"))
    assert grey[:, :, 0].tolist() == [[255, 0] * 4 + [255, 0], [0] * 7 + [255, 0, 255]]
    assert codecs.decode_png(by_hand(3, 1, 2, 0, b"\0\x6c"))[0, :, 0].tolist() == [85, 170, 255]
    colours = bytes([9, 8, 7, 200, 100, 50, 1, 2, 3])
    assert codecs.decode_png(by_hand(2, 1, 4, 3, b"\0\x12", (b"PLTE", colours))).tolist() == [[[200, 100, 50], [1, 2, 3]]]
    assert codecs.decode_png(by_hand(2, 1, 8, 3, b"\0\0\1", (b"PLTE", colours), (b"tRNS", b"\x05"))).tolist() == [[[9, 8, 7, 5], [200, 100, 50, 255]]]
    assert codecs.decode_png(by_hand(2, 1, 16, 0, b"\1\x01\x02\x00\xff")).ravel().tolist() == [0x102, 0x101]


@pytest.mark.parametrize("data", [
    b"", b"GIF89a", codecs.PNG, by_hand(2, 2, 8, 0, b"\0\1\2"), by_hand(2, 1, 8, 0, b"\7\1\2"), by_hand(1, 1, 8, 0, b"\0\1", interlaced=1), by_hand(0, 1, 8, 0, b""), by_hand(1, 1, 8, 3, b"\0\1"),
    by_hand(1, 1, 8, 0, b"\0\1")[:-14] + b"\0" * 14, by_hand(9, 9, 8, 0, b"\0" * 90)[:60], b"P6\n2 2\n255\n123", b"P3\n1 1\n255\n1 1 1\n", b"P5\n0 1\n255\n",
])
def test_damaged_images_have_a_reason(data):
    with pytest.raises(ValueError, match="."):
        codecs.decode_image(data)


def test_netpbm_and_grey():
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (codecs.decode_image(codecs.encode_netpbm(pixels)) == pixels).all()
    deep = (pixels.astype(np.uint16) * 1000)[:, :, :1]
    assert (codecs.decode_image(codecs.encode_netpbm(deep)) == deep).all()
    assert codecs.decode_image(b"P5 # made by hand\n2 # wide\n1\n255\n\x03\x04").ravel().tolist() == [3, 4]
    assert codecs.grey(pixels)[0, 0, 0] == round(0.587 + 0.228) and (codecs.grey(deep) == deep).all()


def test_npy_layouts():
    a = np.arange(12.0).reshape(3, 4)
    for b in (a, np.asfortranarray(a), a.astype(">f4"), a.astype(np.int16), np.zeros((0, 3)), np.float32(5)):
        assert (codecs.decode_npy(codecs.encode_npy(b)) == b).all()
    for bad in (b"", b"\x93NUMPY", codecs.encode_npy(a)[:-1], b"hello"):
        with pytest.raises(ValueError):
            codecs.decode_npy(bad)


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "a b%20")
    rows = spark.createDataFrame([("x/1 ä+%.bin", b"one"), ("x/y/2.bin", b""), ("3.bin", b"three")], "name string, content binary")
    blobs.write_files(rows.repartition(3), path)
    assert files_below(path) == sorted(["x/1 ä+%.bin", "x/y/2.bin", "3.bin", "_SUCCESS"])
    assert open(f"{path}/x/1 ä+%.bin", "rb").read() == b"one"
    with pytest.raises(Exception, match="is there already"):
        blobs.write_files(spark.createDataFrame([("new.bin", b"n"), ("3.bin", b"other")], rows.schema).coalesce(1), path)
    assert "new.bin" not in files_below(path) and open(f"{path}/3.bin", "rb").read() == b"three"
    blobs.write_files(spark.createDataFrame([("3.bin", b"other")], rows.schema), path, overwrite=True)
    assert open(f"{path}/3.bin", "rb").read() == b"other" and len(files_below(path)) == 4
    for bad in ([("t", b"1"), ("t", b"2")], [(None, b"1")], [("t", None)]):
        with pytest.raises(ValueError, match="twice"):
            blobs.write_files(spark.createDataFrame(bad, rows.schema), path)
    late = F.when(F.col("name") == "z2", F.raise_error(F.lit("stopped")).cast("binary")).otherwise(F.col("content"))
    some = spark.createDataFrame([("z1", b"1"), ("z2", b"2")], rows.schema).coalesce(1)
    with pytest.raises(Exception, match="stopped"):
        blobs.write_files(some.select("name", late.alias("content")), path)
    assert len(files_below(path)) == 4
    empty = str(tmp_path / "empty")
    blobs.write_files(rows.limit(0), empty)
    assert files_below(empty) == ["_SUCCESS"] and blobs.image_files(spark, empty, "*.png").count() == 0


def test_images_and_tensors_come_back(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([("a/1.png", 2, 1, 3, 8, [1, 2, 3, 4, 5, 6]), ("a/2.png", 1, 2, 1, 16, [65535, 0])], "name string, width int, height int, channels int, depth int, pixels array<int>")
    blobs.write_files(blobs.encoded_images(rows).union(spark.createDataFrame([("bad.png", b"nothing")], "name string, content binary")), path)
    got = {r.name: r for r in blobs.image_files(spark, path, "*.png").collect()}
    assert got["a/1.png"][1:] == (2, 1, 3, 8, [1, 2, 3, 4, 5, 6], None) and got["a/2.png"].pixels == [65535, 0]
    assert got["bad.png"].pixels is None and "not a" in got["bad.png"].reason
    assert blobs.image_files(spark, path, "1.png", as_grey=True).first().pixels == [round(0.299 + 2 * 0.587 + 3 * 0.114), 5]
    with pytest.raises(Exception, match="beyond its depth"):
        blobs.encoded_images(rows.withColumn("depth", F.lit(8))).collect()
    maps = spark.createDataFrame([("t/1.npy", [1.0, 2.0], [3.0, 4.5])], "name string, a array<double>, b array<double>")
    blobs.write_files(blobs.encoded_tensors(maps, (2, 2), ["a", "b"]), path)
    r = blobs.tensor_files(spark, path).first()
    assert (r.name, r.shape, r.kind, r["values"], r.reason) == ("t/1.npy", [2, 2], "float32", [1.0, 2.0, 3.0, 4.5], None)


def test_levels_of_embeddings_in_their_own_precision(spark, tmp_path):
    """A float just below a level's edge is rounded to it when one is added in single precision, as in SQL."""
    import duckdb

    from gimbal.plans import catalog

    edges = (np.arange(-2, 62, dtype=np.float32) / 128).astype(np.float32)
    rows = [(i, np.nextafter(edges, np.float32(-2)).tolist()) for i in (1, 2, 3, 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.total for r in catalog.QUERIES["image_files"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {r[0]: r[4] for r in duck.execute(catalog.ORACLES["image_files"]).fetchall()}


def test_many_tensors_go_in_waves_and_leave_no_files(spark, tmp_path, monkeypatch):
    from gimbal.plans import catalog, file_queries

    where = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.QUERIES["tensor_files"](spark, where).collect()))
    monkeypatch.setattr(file_queries, "WAVE", 4)
    monkeypatch.setattr(file_queries, "folder", lambda s, tag: f"{tmp_path}/{tag}")
    assert sorted(map(tuple, catalog.QUERIES["tensor_files"](spark, where).collect())) == want and len(want) > 4
    assert not [f for f in files_below(str(tmp_path)) if f.endswith(".npy")]


def test_means_of_tensors_are_those_of_their_values(spark, tmp_path):
    """A file that can't be read has its reason; a null content is an error though names were checked alone, and names that occur twice are seen there."""
    rng = np.random.default_rng(1)
    for name, shape in (("a", (3, 4, 5)), ("b", (7,)), ("c", ())):
        np.save(tmp_path / f"{name}.npy", rng.normal(size=shape).astype(np.float32))
    (tmp_path / "d.npy").write_bytes(b"no tensor")
    got = {r.name: r for r in blobs.tensor_means(spark, str(tmp_path)).collect()}
    for r in blobs.tensor_files(spark, str(tmp_path)).collect():
        assert (got[r.name].shape, got[r.name].kind, got[r.name].reason) == (r.shape, r.kind, r.reason)
        if r.values is not None:
            assert got[r.name].means == pytest.approx(np.reshape(r.values, (r.shape[0] if r.shape else 1, -1)).mean(1))
    rows = spark.createDataFrame([("x", None), ("y", bytearray(b"1"))], "name string, content binary")
    with pytest.raises(Exception, match="without name or content"):
        blobs.write_files(rows, str(tmp_path / "out"), names=rows)
    with pytest.raises(ValueError, match="twice"):
        blobs.write_files(rows, str(tmp_path / "out"), names=rows.union(rows))
