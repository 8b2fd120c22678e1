"""Files, images and streams on generated fixtures."""

import datetime
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import stores
from tessera.sources import files, images
from tessera.streaming import listing, watch


def png(gray: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(r) for r in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


RISING = np.tile(np.arange(64) * 4, (64, 1))


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    (root / "sub/deep").mkdir(parents=True)
    (root / "a.png").write_bytes(png(RISING))
    (root / "sub/b.PNG").write_bytes(png(RISING[:, ::-1]))
    (root / "sub/deep/c.jpg").write_bytes(b"not an image")
    (root / ".hidden.png").write_bytes(png(RISING))
    (root / "notes.txt").write_text("x")
    return str(root)


def names(df):
    return {r.path.rsplit("/", 1)[1] for r in df.select("path").collect()}


def test_scan_and_walk(spark, library):
    assert names(files.scan(spark, library)) == {"a.png", "b.PNG", "c.jpg"}
    found, errors = files.walk(spark, library, library + "/none", include_hidden=True)
    assert names(found) == {"a.png", "b.PNG", "c.jpg", ".hidden.png"} and [r.kind for r in errors.collect()] == ["NotADirectory"]
    assert names(files.walk(spark, library, max_depth=1)[0]) == {"a.png"}
    assert names(files.walk(spark, library, max_depth=2, extensions=None)[0]) == {"a.png", "b.PNG", "notes.txt"}
    assert files.scan(spark, library, library + "/sub").count() == 3


def test_hashes_and_quality(spark, library):
    content = files.scan(spark, library, content=True)
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in images.hash_images(content).collect()}
    assert bytes(got["a.png"]) == b"\0" * 8 and bytes(got["b.PNG"]) == b"\xff" * 8 and got["c.jpg"] is None
    three = {r.path.rsplit("/", 1)[1]: r for r in images.hash_images(content, "fusion").collect()}
    assert len(three["a.png"].ahash) == len(three["a.png"].phash) == 8
    q = {r.path.rsplit("/", 1)[1]: r for r in images.image_quality(content).collect()}
    assert q["a.png"].contrast > 50 and q["c.jpg"].overall is None
    flat, board = images.quality(np.full((32, 32), 90.0)), images.quality((np.indices((64, 64)).sum(axis=0) % 2) * 255.0)
    assert flat[0] < 1 and flat[1] < 1 and abs(flat[2] - 90) < 5 and board[0] > 1000
    assert len(images.difference_hash(RISING.astype(float), 16)) == 32
    assert images.average_hash(np.full((9, 9), 7.0)) in (b"\0" * 8, b"\xff" * 8)


def test_exif():
    body = b"Canon\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 6, 50) + struct.pack("<HHII", 0x0100, 3, 1, 640) + b"\0" * 12 + b"\0" * 8 + body
    tags = images.exif(b"\xff\xd8" + b"\0" * 4 + b"Exif\0\0" + tiff)
    assert tags["raw_width"] == 640 and images.exif(b"nothing") == {}


def test_metadata_reader(spark, tmp_path):
    entry = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    body = b"Canon\0" + b"2024:01:15 10:11:12\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 4) + entry(0x010F, 2, 6, 62) + entry(0x0132, 2, 20, 68) + entry(0x0100, 3, 1, 640) + entry(0x0101, 4, 1, 480) + b"\0" * 4 + body
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + b"\0" * 4 + b"Exif\0\0" + tiff)
    (tmp_path / "b.jpg").write_bytes(b"nothing")
    got = {r.path.rpartition("/")[2]: r for r in images.read_metadata(files.scan(spark, str(tmp_path), content=True)).collect()}
    a, b = got["a.jpg"], got["b.jpg"]
    assert (a.make, a.changed, a.width, a.height) == ("Canon", "2024:01:15 10:11:12", 640, 480) and a.taken is None
    assert all(b[c] is None for c in ("make", "model", "software", "taken", "changed", "width", "height"))


def test_resize_equals_weighted_means():
    assert images.resize(np.full((50, 31), 7.0), 9, 8).tolist() == np.full((8, 9), 7.0).tolist()
    gray = np.random.default_rng(2).integers(0, 256, (12, 6)).astype(float)
    for y in range(4):
        for x in range(3):
            wy = np.array([max(0.0, 1 - abs(i - ((y + 0.5) * 3 - 0.5)) / 3) for i in range(12)])
            wx = np.array([max(0.0, 1 - abs(i - ((x + 0.5) * 2 - 0.5)) / 2) for i in range(6)])
            assert images.resize(gray, 3, 4)[y, x] == np.rint((wy / wy.sum()) @ gray @ (wx / wx.sum()))


def test_watches_are_listed_and_stopped(spark, library, tmp_path):
    query = watch.new_files(spark, library, content=False).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).start()
    assert "watched" in watch.watching(spark) and watch.unwatch(spark, "watched") and not query.isActive
    assert "watched" not in watch.watching(spark) and not watch.unwatch(spark, "watched")


def test_stream_equals_batch(spark, library, tmp_path):
    store = stores.hash_cache(spark, str(tmp_path / "cache"))
    stream = watch.new_files(spark, library, files_per_trigger=1)
    query = watch.hash_into(stream, images.hash_images, store, str(tmp_path / "check"))
    query.awaitTermination(120)
    batch = images.hash_images(files.scan(spark, library, content=True)).filter("hash IS NOT NULL")
    assert {r.path: r.hash for r in store.read().collect()} == {r.path: r.hash for r in batch.collect()} and store.read().count() == 2


def test_a_stream_of_pictures_of_every_format_is_hashed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = ["a.jpg", "b c+d.jpg", "e[1]{x}.jpeg", "f.png", "ü%20.gif"]
    for name in names:
        _write_picture(spark, folder / name, "jpg" if "jp" in name else name.rpartition(".")[2])
    (folder / "broken.jpg").write_bytes(b"no picture")
    store = stores.hash_cache(spark, str(tmp_path / "cache"))
    run = lambda: watch.hash_into(watch.new_files(spark, str(folder), files_per_trigger=2, content=False), watch.picture_hashes(), store, str(tmp_path / "check")).awaitTermination(200)
    run()
    batch = {r.path: r.hash for r in images.hash_images(images.read_images(spark, str(folder))).filter("hash IS NOT NULL").collect()}
    assert {r.path: r.hash for r in store.read().collect()} == batch and {p.rpartition("/")[2] for p in batch} == set(names)
    # A later file is hashed by the next run, and lookups of a listing find all of them.
    _write_picture(spark, folder / "late.jpg", "jpg", 32)
    run()
    listed = files.scan(spark, str(folder)).select("path", "size", "modified", F.lit("difference").alias("algorithm"))
    assert {r.path.rpartition("/")[2] for r in stores.cached(listed, store).filter("hash IS NOT NULL").collect()} == {*names, "late.jpg"}


def test_changes_on_a_stream(spark, tmp_path):
    src, moment = str(tmp_path / "seen"), lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", listing.STATE_STORE)
    out = tmp_path / "out"

    def batch(at, **sizes):
        rows = [(f"{p}.jpg", size, moment(size), moment(at)) for p, size in sizes.items()]
        spark.createDataFrame(rows, listing.SIGHTING).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(listing.SIGHTING).parquet(src)
        query = listing.change_events(stream, gone_after_ms=5_000).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
        return sorted((r.path[0], r.kind, r.size) for r in spark.read.schema(listing.CHANGE).parquet(str(out)).collect())

    try:
        first = batch(0, a=1, b=2)
        assert first == [("a", "create", 1), ("b", "create", 2)]
        assert batch(2, a=1, b=3) == sorted([*first, ("b", "modify", 3)])
        batch(4, a=1)  # b is not there, but not long enough
        third = batch(9, a=1)
        assert third == sorted([*first, ("b", "modify", 3), ("b", "remove", 3)])
        assert batch(10, a=1, b=7) == sorted([*third, ("b", "create", 7)])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_listings_on_a_stream(spark, library, tmp_path):
    rows = listing.sightings(spark, library, pause=0.0)
    query = rows.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("seen").select("seen").distinct().count() >= 2:
                break
    finally:
        query.stop()
    seen = spark.table("seen")
    assert names(seen) == {"a.png", "b.PNG", "c.jpg"} and seen.select("seen").distinct().count() >= 2


def test_a_missing_root_of_large_files_is_an_error(spark, library):
    assert names(files.large_file_candidates(spark, library)[0]) == {"a.png", "b.PNG", "c.jpg"}
    with pytest.raises(FileNotFoundError):
        files.large_file_candidates(spark, library, library + "/none")
    with pytest.raises(NotADirectoryError):
        files.large_file_candidates(spark, library + "/a.png")


def test_png_filters():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 7 * 3)).astype(np.int64)
    rows, before = b"", np.zeros(21, np.int64)
    for y, line in enumerate(pixels):
        kind, left = y % 5, np.concatenate([np.zeros(3, np.int64), line[:-3]])
        corner = np.concatenate([np.zeros(3, np.int64), before[:-3]])
        p = left + before - corner
        far = [abs(p - left), abs(p - before), abs(p - corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], before, corner))
        guess = [0 * line, left, before, (left + before) // 2, paeth][kind]
        rows += bytes([kind]) + bytes(((line - guess) & 255).astype(np.uint8))
        before = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert np.allclose(images.decode_png(data), pixels.reshape(9, 7, 3) @ np.array(images.LUMA))


def test_events(spark):
    t = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    raw = spark.createDataFrame([(["a.jpg", "n.txt"], "Create", t(0)), (["a.jpg"], "modify", t(300)), (["a.jpg"], "remove", t(2000)), (["a.jpg"], "access", t(2100))], "paths array<string>, kind string, ts timestamp")
    events = watch.normalise(raw)
    assert events.count() == 3
    assert sorted((r.events, r.kind) for r in watch.debounce(events, "path").collect()) == [(1, "remove"), (2, "modify")]
    assert watch.latest_state(events, "path", "ts").first().kind == "remove"
    progress = spark.createDataFrame([("s", 1, 5), ("s", 2, 3), ("s", 3, 7)], "k string, o int, v int")
    assert sorted(r.v for r in watch.running_maximum(progress, "k", "o", "v").collect()) == [5, 7]


def test_debounce_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.range(5).select(F.lit("a.jpg").alias("path"), F.lit("modify").alias("kind"), F.timestamp_millis(F.col("id") * 5000).alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("path string, kind string, ts timestamp").parquet(src)
    query = watch.debounce(stream, "path", "1 second", "1 second").writeStream.format("memory").queryName("bursts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert 3 <= spark.table("bursts").count() <= 5


def _write_picture(spark, path, kind, side=64):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(side, side, 1)
    for y in range(side):
        for x in range(side):
            picture.setRGB(x, y, (x * 3 << 16) | (y * 3 << 8) | (x ^ y))
    assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(path)))


def test_pictures_of_every_format_are_hashed_and_rated(spark, tmp_path):
    for kind in ("jpg", "png", "gif", "bmp"):
        _write_picture(spark, tmp_path / f"a.{kind}", kind)
    (tmp_path / "broken.jpg").write_bytes(b"no picture")
    rows = images.read_images(spark, str(tmp_path))
    prints = {r.path.rpartition("/")[2]: r.hash for r in images.hash_images(rows).collect()}
    assert prints["broken.jpg"] is None and len(prints) == 5
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    assert bits("a.png", "a.bmp") == 0 and bits("a.png", "a.jpg") <= 8 and bits("a.png", "a.gif") <= 12
    by_content = spark.read.format("binaryFile").load(str(tmp_path / "a.png")).select("path", "content")
    assert images.hash_images(by_content).first().hash == prints["a.png"]
    rated = {r.path.rpartition("/")[2]: r.brightness for r in images.image_quality(rows).collect()}
    assert rated["broken.jpg"] is None and abs(rated["a.png"] - rated["a.jpg"]) < 3
    three = images.hash_images(rows, "fusion").filter("path LIKE '%a.jpg'").first()
    assert all(three[c] is not None for c in ("ahash", "dhash", "phash"))


def test_links_that_lead_back_end(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.jpg").write_bytes(b"1")
    (tmp_path / "a" / "b" / "up").symlink_to(tmp_path / "a")
    found, errors = files.walk(spark, str(tmp_path), follow_symlinks=True)
    assert [r.path.rpartition("/")[2] for r in found.collect()] == ["x.jpg"]
    assert [r.kind for r in errors.collect()] == ["SymlinkCycle"]


def test_store_keeps_changes_and_whole_versions(spark, tmp_path):
    store = stores.lifetime_totals(spark, str(tmp_path / "totals"))
    store.most_changes = 2
    moment = lambda i: datetime.datetime(2024, 1, 1, 0, i)
    for i in range(7):
        store.upsert(spark.createDataFrame([("all", i, moment(i)), (f"n{i % 2}", i, moment(i))], stores.LIFETIME_SCHEMA))
    assert {(r.name, r.lifetime_bytes) for r in store.read().collect()} == {("all", 6), ("n0", 6), ("n1", 5)}
    assert store.remove(spark.createDataFrame([("n0",)], "name string")) == 1
    assert {r.name for r in store.read().collect()} == {"all", "n1"} and store.clear() == 2 and store.read().count() == 0
