"""Archives: members by range as whole files, names of every form, damage, and what is there already."""

import gzip
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from gimbal.sources import archives

FILES = "name string, content binary"


def tar(path, members, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as t:
        for name, content in members:
            info = tarfile.TarInfo(name)
            if content is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))


def content(df):
    return sorted((r.name, bytes(r.content)) for r in df.collect())


def test_round_trip_in_many_archives(spark, tmp_path):
    rows = [(f"{i % 7}/é {i}.bin", os.urandom(i * 37 % 2000)) for i in range(300)] + [("twice", b"a"), ("twice", b"b"), ("empty", None), ("n" * 300, b"long")]
    archives.write_archives(spark.createDataFrame(rows, FILES), f"{tmp_path}/t", 3, full=50_000)
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".tar")]) > 5
    index = archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    assert index.where("reason IS NOT NULL").count() == 0
    assert content(archives.members(index)) == sorted((n, c or b"") for n, c in rows)
    some = index.where(F.startswith("name", F.lit("3/")))
    assert content(archives.members(some, 5)) == sorted(r for r in rows if r[0].startswith("3/"))


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_names_of_every_form(spark, tmp_path, form):
    name = "/".join(["folder" * 4] * 5) + "/" + "x" * 60
    (tmp_path / "t").mkdir()
    tar(tmp_path / "t" / "a.tar", [("d", None), (name, b"1" * 513), ("b", b"")], form)
    got = archives.members(archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i"))
    assert content(got) == sorted([(name, b"1" * 513), ("b", b"")])


def test_damage_has_a_reason(spark, tmp_path):
    (tmp_path / "t").mkdir()
    tar(tmp_path / "t" / "good.tar", [("a", b"a"), ("b", b"b" * 5000)])
    data = (tmp_path / "t" / "good.tar").read_bytes()
    at = 1024  # the header of b
    bad = {"cut": data[: at + 2000], "header": data[:at] + b"?" * 512 + data[at + 512 :], "zip": gzip.compress(data), "edge": data[:at], "text": b"no archive " * 900}
    for n, d in bad.items():
        (tmp_path / "t" / f"{n}.tar").write_bytes(d)
    index = archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    got = {(os.path.basename(r.archive), r.name, r.reason is None) for r in index.collect()}
    whole = {("good.tar", "a", True), ("good.tar", "b", True), ("cut.tar", "a", True), ("header.tar", "a", True), ("edge.tar", "a", True)}
    assert {g for g in got if g[2]} == whole
    assert {g[0] for g in got if not g[2]} == {f"{n}.tar" for n in bad}
    assert archives.members(index).where("content IS NULL").count() == len(bad)


def test_what_is_there_is_skipped(spark, tmp_path):
    rows = [(f"{i % 3}/{i}", b"%d" % i) for i in range(20)]
    archives.write_archives(spark.createDataFrame(rows, FILES), f"{tmp_path}/t", 2)
    index = archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    archives.extract(index.where("size = 1"), f"{tmp_path}/x")
    (tmp_path / "x" / "0" / "0").write_bytes(b"kept")
    archives.extract(index, f"{tmp_path}/x")
    found = {f"{os.path.relpath(d, tmp_path / 'x')}/{f}": open(f"{d}/{f}", "rb").read() for d, _, fs in os.walk(tmp_path / "x") for f in fs if f[0].isdigit()}
    assert found == dict(rows) | {"0/0": b"kept"}
    for f in os.listdir(tmp_path / "t"):
        os.remove(tmp_path / "t" / f)
    assert archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i").count() == 20  # the index that is there is only read


def test_no_way_out_and_empty(spark, tmp_path):
    (tmp_path / "t").mkdir()
    tar(tmp_path / "t" / "a.tar", [("../out", b"1")])
    with pytest.raises(ValueError, match="lead out"):
        archives.extract(archives.index(spark, f"{tmp_path}/t", f"{tmp_path}/i"), f"{tmp_path}/x")
    (tmp_path / "e").mkdir()
    tar(tmp_path / "e" / "a.tar", [])
    empty = archives.index(spark, f"{tmp_path}/e", f"{tmp_path}/ei")
    assert empty.count() == 0 and archives.members(empty).count() == 0
