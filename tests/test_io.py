"""Images, sources, sinks and streaming."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import images
from tallyloom.operators import pages
from tallyloom.sources import files
from tallyloom.streaming import receipts


def page(h=60, w=40):
    image = np.full((h, w), 255, np.uint8)
    image[10:14] = 0
    image[30:34] = 0
    return image


def test_measures():
    p = page()
    assert images.sharpness(p) > images.sharpness(np.full((20, 20), 7, np.uint8)) == 0.0 == images.sharpness(None)
    assert images.cardinal_rotation(p) == 0 and images.cardinal_rotation(images.turn(p, 90)) == 90
    assert set(np.unique(images.binarise(p))) == {0, 255} and (images.binarise(p, True) == 255 - images.binarise(p)).all()
    assert images.line_score(np.full((9, 9), 255, np.uint8)) in (0.0, images.line_score(np.full((9, 9), 255, np.uint8)))
    colour = np.stack([p, p, p], axis=2)
    assert (images.grey(colour) == p).all()
    corners = images.order_corners(np.array([[100, 5], [0, 0], [0, 90], [110, 95]]))
    assert corners.tolist() == [[0, 0], [100, 5], [110, 95], [0, 90]]
    assert images.shrink_factor(4000, 100) == 0.5 and images.growth_factor(600, 900) == 2.0 and images.growth_factor(10, 10) == 3.0


def test_image_columns(spark):
    p = np.ascontiguousarray(images.turn(page(), 90))
    rows = spark.createDataFrame([(1, (p.shape[0], p.shape[1], 1, bytearray(p.tobytes()))), (2, None)], f"doc_id long, image {images.IMAGE}")
    out = rows.withColumns({"s": images.sharpness_of("image"), "r": images.rotation_of("image")}).withColumn("b", images.upright("image", "r"))
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[1]["r"] == 90 and found[1]["s"] > 0 and (found[1]["b"]["h"], found[1]["b"]["w"]) == (60, 40)
    assert found[2]["s"] == 0.0 and found[2]["r"] is None


def test_resampling():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (12, 9, 3), np.uint8)
    thirds = a.reshape(4, 3, 3, 3, 3).astype(float).mean(axis=(1, 3))
    assert np.abs(images.resample(a, 1 / 3) - thirds).max() <= 0.5
    ramp = np.repeat(np.arange(0, 200, 5, dtype=np.uint8)[:, None], 7, axis=1)
    big = images.resample(ramp, 2.0)
    assert big.shape == (80, 14) and np.abs(big[8:-8, 5] - (np.arange(8, 72) * 2.5 - 1.25)).max() <= 1.0
    level = np.full((5, 4), 77, np.uint8)
    assert (images.resample(level, 2.7) == 77).all() and images.resample(level, 2.7).shape == (13, 10) and (images.resample(level, 0.7) == 77).all()
    # A stretch of 10 / 4 = 2.5 pixels shares the third one.
    assert images.resample(np.array([[0, 10, 20, 30, 40, 50, 60, 70, 80, 90]], np.uint8), 0.45).tolist() == [[8, 32, 58, 82]]
    assert images.shrunk(np.zeros((4000, 100), np.uint8)).shape == (2000, 50) and images.shrunk(ramp) is ramp
    assert images.grown(np.zeros((600, 900), np.uint8)).shape == (1200, 1800) and images.grown(np.zeros((1200, 1300), np.uint8)).shape == (1200, 1300)


def test_stamp_views():
    image = np.full((200, 100, 3), 9, np.uint8)
    image[150:] = 200
    whole, part = images.stamp_views(image)
    assert whole.shape == (192, 96) and part.shape == (64 * 4 - 2 * 5, 400 - 2 * 8) and part[-1, 0] == 200
    assert [v.shape for v in images.stamp_views(np.zeros((1, 1), np.uint8))][0] == (1, 1)


def test_image_engines(spark):
    p = page()
    rows = [(1, bytearray(p.tobytes()), (60, 40, 1, bytearray(p.tobytes()))), (2, bytearray(b"x"), (60, 40, 1, bytearray(bytes(2400)))), (3, None, None)]
    table = spark.createDataFrame(rows, f"doc_id long, content binary, image {images.IMAGE}")

    def decode(content):
        return np.frombuffer(content, np.uint8).reshape(60, 40)

    def lying(image):
        return 450 if image.max() else None

    def broken(view):
        raise RuntimeError("no code")

    def low(view):
        return f"{view.shape[0]}" if view.max() and view.shape[0] < 60 else ("" if view.max() else None)

    out = table.select("doc_id", images.decoded(decode)("content").alias("d"), images.orientation(lying)("image").alias("o"), images.stamp_text(broken, low)("image").alias("t"))
    found = {r["doc_id"]: r for r in out.collect()}
    assert (found[1]["d"]["h"], found[1]["d"]["w"]) == (60, 40) and bytes(found[1]["d"]["data"]) == p.tobytes()
    assert found[2]["d"]["h"] is None and found[3]["d"]["h"] is None
    assert [found[i]["o"] for i in (1, 2, 3)] == [90, None, None]
    assert [found[i]["t"] for i in (1, 2, 3)] == ["58", None, None]


def test_pages(spark):
    p = page()
    rows = [(i, (60, 40, 1, bytearray(p.tobytes()))) for i in (1, 2)] + [(3, None)]
    made = pages.prepare(spark.createDataFrame(rows, f"doc_id long, image {images.IMAGE}")).withColumn("nitidez", F.lit(40.0))
    out = pages.turned(pages.turned(made, F.lit(270)), F.when(F.col("doc_id") == 1, 270))
    found = {r["doc_id"]: r for r in out.collect()}
    assert (found[1]["rotation"], found[2]["rotation"], found[1]["nitidez"]) == (180, 270, 40.0)
    assert bytes(found[1]["colour"]["data"]) == p[::-1, ::-1].tobytes() and (found[2]["grey"]["h"], found[2]["binary"]["w"]) == (40, 60)
    with pytest.raises(Exception, match="90 or 270"):
        pages.turned(made, F.lit(180)).collect()
    read = pages.readings(made).filter("doc_id = 1").orderBy("attempt").collect()
    assert [r["strategy"] for r in read] == ["gris", "gris_rotada_180", "binaria"]
    assert bytes(read[1]["image"]["data"]) == p[::-1, ::-1].tobytes()


def test_files_connectors_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PNG").write_bytes(b"PAN 990")
    (tmp_path / "in" / "b.txt").write_bytes(b" ")
    table = files.read_files(spark, f"{tmp_path}/in", source="camera")
    assert {(r["filename"], r["content_type"], r["length"]) for r in table.collect()} == {("a.PNG", "image/png", 7), ("b.txt", None, 1)}

    def engine(batches):
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = content.decode().split()
                n = len(t)
                columns = [[doc] * n, [0] * n, [6] * n, list(range(n)), t, [90.0] * n, [100 * i for i in range(n)], [0] * n, [30] * n, [20] * n, [1] * n, [1] * n]
                kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.float64(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schemas.OCR_WORDS.names)

    words = files.recognise(table, engine)
    assert words.count() == 2
    files.write_responses(words.select("doc_id", F.lit(None).cast("string").alias("estado")), f"{tmp_path}/out")
    assert '"estado":null' in spark.read.text(f"{tmp_path}/out").collect()[0][0]


def test_stream(spark, tmp_path):
    rows = [(7, 0, 6, i, t, 90.0, 100 * i, 40 * i, 30, 20, 1, 1) for i, t in enumerate(["TIENDA", "TOTAL", "990"])]
    spark.createDataFrame(rows, schemas.OCR_WORDS).write.parquet(f"{tmp_path}/words")
    receipts.scan_stream(receipts.read_words(spark, f"{tmp_path}/words"), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["doc_id"], r["datos"]["total"]) for r in found] == [(7, 990.0)]
