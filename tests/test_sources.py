import json

import pytest

from gimbal.sources import tables as T
from gimbal.streaming.events import windowed


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps([{"image": "x/1.jpg", "annotation": "x/1.json"}]))
    (tmp_path / "m/b.json").write_text(json.dumps([{"image": "x/2.jpg", "annotation": "x/y/2 é+.json"}]))
    (tmp_path / "c/x/y").mkdir(parents=True)
    (tmp_path / "c/x/1.json").write_text(json.dumps({"caption": " one\u3000"}))
    (tmp_path / "c/x/y/2 é+.json").write_text("{}")
    rows = T.manifest(spark, str(tmp_path / "m"), "s").join(T.captions(spark, str(tmp_path / "c")), "annotation")
    assert sorted((r.image, r.text, r.source) for r in rows.collect()) == [("x/1.jpg", "one", "s"), ("x/2.jpg", "", "s")]
    (tmp_path / "cam.csv").write_text("fname,vfov,roll,pitch,width,height\na.jpg,1.0,0.1,0.2,640,480\n")
    r = T.cameras(spark, str(tmp_path / "cam.csv")).first()
    assert (r.px, r.py, r.k1) == (320.0, 240.0, 0.0) and r.f == pytest.approx(439.3171, abs=1e-3)
    assert T.files(spark, str(tmp_path / "m"), "*.json").count() == 2


def test_lookup_pending_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, v double")
    cache = spark.createDataFrame([("a", 9)], "name string, p int")
    assert [r.name for r in T.pending(rows, cache, "name").collect()] == ["b"]
    with pytest.raises(Exception, match="no prediction for b"):
        T.lookup(rows, cache).collect()
    T.write_predictions(rows, str(tmp_path / "p"))
    assert sorted(r._c1 for r in spark.read.csv(str(tmp_path / "p")).collect() if r._c0 != "name") == ["1.500000", "2.000000"]
    assert not T.duplicates(rows).count()


def test_stream_gives_the_rows_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {tuple(r) for r in windowed(table).select("start", "event_type", "n").collect()}
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windowed").select("start", "event_type", "n").collect()} == want
