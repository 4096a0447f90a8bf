"""Files, generators, sinks, streams."""

import struct

import pytest
from pyspark.sql import functions as F

from huespan.operators import quality
from huespan.queries import DEMO_FILES
from huespan.sources import images as src
from huespan.streaming import append


def bmp(r, g, b):
    row = bytes((b, g, r)) * 2 + b"\0\0"
    return b"BM" + struct.pack("<IHHI", 54 + 16, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + row * 2


@pytest.fixture
def folder(tmp_path):
    for name in DEMO_FILES:
        at = tmp_path / "img" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bmp(10, 20, 30) if name == "d.bmp" else name.encode())
    return src.image_folder(str(tmp_path / "img"))


def test_scan_and_count(spark, folder):
    rows = src.load_files(spark, folder).orderBy("id").collect()
    assert [(r.id, r.filename) for r in rows] == [(1, "B.PNG"), (2, "a.png"), (3, "bad.jpg"), (4, "c.jpeg"), (5, "d.bmp")]
    assert all(0 <= v <= 255 and v == int(v) for r in rows for v in (r.r, r.g, r.b))
    assert src.load_files(spark, folder, 2).count() == 2
    assert src.count_images(spark, folder).agg(F.sum("n")).first()[0] == 6
    assert src.load_files(spark, folder + "/none").count() == src.count_images(spark, folder + "/none").count() == 0


def test_pixels(spark, folder):
    rows = src.pixel_means(spark, folder).collect()
    assert [(r.r, r.g, r.b) for r in rows if r.origin.endswith("d.bmp")] == [(10.0, 20.0, 30.0)]


def test_query_point(spark):
    files = spark.createDataFrame([("q.jpg", 10), ("x.jpg", None)], "path string, length long")
    found, lost, odd = (src.query_point(files, p).first() for p in ("q.jpg", "none.jpg", "x.jpg"))
    assert found.found and found.filename == "q.jpg" and found.id == 999999
    assert not lost.found and (lost.r, lost.g, lost.b, lost.filename) == (128.0, 128.0, 128.0, "query.jpg")
    assert (odd.r, odd.g, odd.b) == (128.0, 128.0, 128.0)


def test_generator(spark):
    df = src.synthetic(spark, 100_000, seed=42)
    row = df.agg(F.countDistinct("id").alias("n"), F.min("r").alias("lo"), F.max("b").alias("hi"), F.avg("g").alias("mean"), F.corr("r", "g").alias("c")).first()
    assert row.n == 100_000 and row.lo >= 0 and row.hi < 255 and abs(row.mean - 127.5) < 1 and abs(row.c) < 0.02
    assert quality.selectivity(df, (128.0, 128.0, 128.0), 50.0).first().selectivity_pct == pytest.approx(3.158, abs=0.25)
    assert df.limit(5).collect() == src.synthetic(spark, 100_000, seed=42).limit(5).collect()
    assert df.limit(5).collect() != src.synthetic(spark, 100_000, seed=20).limit(5).collect()


def test_append_and_clear(spark, tmp_path):
    path = str(tmp_path / "store")
    src.append_images(src.synthetic(spark, 10), path)
    src.append_images(src.synthetic(spark, 10), path)
    assert spark.read.parquet(path).count() == 20
    src.clear_images(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_stream(spark, tmp_path):
    src.synthetic(spark, 500).write.parquet(str(tmp_path / "in"))
    stream = append.hits_stream(append.image_stream(spark, str(tmp_path / "in")), (128.0, 128.0, 128.0), 100.0)
    q = append.store_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    want = quality.selectivity(src.synthetic(spark, 500), (128.0, 128.0, 128.0), 100.0).first().found
    assert spark.read.parquet(str(tmp_path / "out")).count() == want > 0
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == want
    src.append_images(src.synthetic(spark, 5), str(tmp_path / "out" / "batch=0"))  # a batch that is run again replaces what it left
    (tmp_path / "again").mkdir()
    append.store_stream(stream, str(tmp_path / "out"), str(tmp_path / "again" / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
