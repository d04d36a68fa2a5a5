"""Image files: headers, guards, decoding, scaling, command line, stream."""

import struct
import zlib

import numpy as np
import pytest
from compare import assert_same, connect

from huescape import cli
from huescape.api import reports
from huescape.plans.catalogue import QUERIES, oracle_sql
from huescape.sources import fixtures
from huescape.sources import images as I
from huescape.streaming.images import watch


def png(path, rgb):
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def ramp(h=12, w=40):
    x = np.linspace(0, 255, w).astype(int)
    return np.stack([np.tile(x, (h, 1)), np.full((h, w), 60), np.tile(255 - x, (h, 1))], axis=2)


def test_pixels_are_as_written(spark, tmp_path):
    rgb = np.arange(24).reshape(2, 4, 3) * 10
    png(tmp_path / "a.png", rgb)
    pixels, paths = I.read_images(spark, str(tmp_path / "a.png"))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in pixels.collect()}
    assert got == {(y, x): tuple(rgb[y, x]) for y in range(2) for x in range(4)}
    assert paths.first().path.endswith("a.png")


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.read_images(spark, str(tmp_path / "none.png"))
    (tmp_path / "text.png").write_text("no image")
    with pytest.raises(ValueError):
        I.read_images(spark, str(tmp_path / "text.png"))
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 10_001, 1)
    (tmp_path / "wide.png").write_bytes(head)
    with pytest.raises(ValueError, match="too large"):
        I.read_images(spark, str(tmp_path / "wide.png"))
    (tmp_path / "thin.png").write_bytes(head[:16] + struct.pack(">II", 10_000, 10))
    with pytest.raises(ValueError, match="thin"):
        I.read_images(spark, str(tmp_path / "thin.png"))


def test_headers():
    assert I.header(b"GIF89a" + struct.pack("<HH", 3, 5)) == ("gif", 3, 5)
    assert I.header(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)) == ("bmp", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + b"\0" * 9
    assert I.header(jpeg) == ("jpeg", 30, 20)
    assert I.header(b"") is None


def test_downscale():
    assert I.scaled(512, 100) == (256, 50) and I.scaled(200, 100) == (200, 100)
    flat = I.downscale(np.full((300, 600, 3), 77, np.uint8))
    assert flat.shape == (128, 256, 3) and (flat == 77).all()
    x = np.linspace(0, 255, 512)
    smooth = I.downscale(np.repeat(np.tile(x, (8, 1))[:, :, None], 3, axis=2).astype(np.uint8))
    assert np.abs(smooth[0, 2:-2, 0].astype(float) - x[:512:2][2:-2]).max() < 3


def test_reports_and_command_line(spark, tmp_path, capsys):
    png(tmp_path / "a & b.png", ramp())
    row = reports(spark, str(tmp_path / "a & b.png")).first()
    assert "GRADIENTS:" in row.report and "OVERVIEW:" in row.report
    assert "&amp;" in row.html and "linear-gradient" in row.html
    png(tmp_path / "a.png", ramp())
    assert cli.main(["-i", str(tmp_path / "a.png"), "-o"], spark) == 0
    assert (tmp_path / "a-palette.html").read_text().startswith("<!DOCTYPE html>")
    out = capsys.readouterr().out
    assert "COLORS:" in out and out.endswith(f"Wrote {tmp_path / 'a-palette.html'}\n")
    assert cli.main(["-i", str(tmp_path / "none.png")], spark) == 1
    assert capsys.readouterr().err.startswith("Error: ")


def test_long_metadata(spark, tmp_path):
    """A JPEG whose size comes after a megabyte of other segments."""
    extra = b"".join(b"\xff\xe1" + struct.pack(">H", 65_535) + bytes(65_533) for _ in range(17))
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + extra + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30) + bytes(9))
    (tmp_path / "short.png").write_bytes(b"\x89PN")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.width, r.height) for r in I.inspect(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": ("jpeg", 30, 20), "short.png": (None, None, None)}


def test_scaling_against_whole_matrices():
    rgb = np.random.default_rng(2).integers(0, 256, (300, 700, 3)).astype(np.uint8)

    def matrix(size, new):
        at, w = I._taps(size, new)
        out = np.zeros((new, size))
        np.add.at(out, (np.arange(new)[:, None], at), w)
        return out

    to_bytes = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    wide = to_bytes(np.einsum("nw,hwc->hnc", matrix(700, 256), rgb.astype(float)))
    whole = to_bytes(np.einsum("nh,hwc->nwc", matrix(300, 109), wide))
    assert np.abs(I.downscale(rgb).astype(int) - whole.astype(int)).max() <= 1 and (I.downscale(rgb) == whole).mean() > 0.999


def test_stream(spark, tmp_path):
    """Every file is reported or rejected once, whatever the trigger, and a second run has nothing to do."""
    (tmp_path / "in").mkdir()
    for name in "abcde":
        png(tmp_path / "in" / f"{name}.png", ramp(4, 6))
    (tmp_path / "in" / "bad.png").write_text("no image")
    for trigger in ({"once": True}, {"availableNow": True}):
        place = tmp_path / next(iter(trigger))
        for _ in range(2):
            watch(spark, str(tmp_path / "in"), str(place), str(tmp_path / f"cp-{place.name}"), files=4, **trigger).awaitTermination(180)
        assert spark.read.parquet(str(place / "reports")).count() == 5
        assert [r.reason for r in spark.read.parquet(str(place / "rejects")).collect()] == ["not an image that can be read"]


def test_written_images(spark, tmp_path):
    """Files written by pixels are those written by hand; pixels that are missing are an error, and leave no image."""
    rgb = ramp(5, 9)
    rows = [(7, y, x, *map(int, rgb[y, x])) for y in range(5) for x in range(9)]
    schema = "image_id long, y long, x long, r long, g long, b long"
    assert fixtures.write_images(spark.createDataFrame(rows[::-1], schema), f"file://{tmp_path}/a") == 1
    png(tmp_path / "b.png", rgb)
    read = lambda p: sorted(tuple(r)[1:] for r in I.read_images(spark, str(p))[0].collect())
    assert read(tmp_path / "a" / "7.png") == read(tmp_path / "b.png")
    with pytest.raises(Exception, match="pixels missing"):
        fixtures.write_images(spark.createDataFrame(rows[1:], schema), f"file://{tmp_path}/c")
    assert not (tmp_path / "c" / "7.png").exists()
    assert fixtures.write_images(spark.createDataFrame([], schema), f"file://{tmp_path}/d") == 0


def _shared_id(rgb):
    """An image of 9 x 5 pixels, and two pixels more at places that it has."""
    rows = [(7, y, x, *map(int, rgb[y, x])) for y in range(5) for x in range(9)]
    return rows + [(7, 1, 2, 255, 255, 255), (7, 4, 7, 255, 250, 255)]


def test_images_that_share_an_id(spark, tmp_path):
    """The second pixel at a place goes to a second layer, of the same size and clear elsewhere."""
    schema = "image_id long, y long, x long, r long, g long, b long"
    assert fixtures.write_images(spark.createDataFrame(_shared_id(ramp(5, 9)), schema), f"file://{tmp_path}/a") == 1
    assert [(r.kind, r.width, r.height) for r in I.inspect(spark, str(tmp_path / "a")).collect()] == [("png", 9, 5)]
    r = spark.read.format("image").load(str(tmp_path / "a-more" / "1" / "7.png")).select("image.*").first()
    bgra = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
    assert bgra.shape == (5, 9, 4) and (bgra[:, :, 3] > 0).sum() == 2
    assert bgra[1, 2].tolist() == [255, 255, 255, 255] and bgra[4, 7].tolist() == [255, 250, 255, 255]


def test_files_of_shared_ids(spark, tmp_path):
    """image_files where the images of both kinds share ids, against its SQL."""
    _shared_tables(tmp_path)
    assert_same(QUERIES["image_files"](spark, str(tmp_path)), connect(str(tmp_path)), oracle_sql()["image_files"])


def test_pixels_of_shared_ids(spark, tmp_path):
    """image_pixels where the images of both kinds share ids, against its SQL; and every pixel of a layer comes back."""
    _shared_tables(tmp_path)
    assert_same(QUERIES["image_pixels"](spark, str(tmp_path)), connect(str(tmp_path)), oracle_sql()["image_pixels"])
    schema, rows = "image_id long, y long, x long, r long, g long, b long", _shared_id(ramp(5, 9))
    fixtures.write_images(spark.createDataFrame(rows, schema), f"file://{tmp_path}/a")
    got = I.read_images(spark, str(tmp_path / "a"), downscale=False, layers=fixtures.further(f"file://{tmp_path}/a"))[0].collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(r[1:] for r in rows)


def test_scaling_of_shared_ids(spark, tmp_path):
    """image_scaled where the images of both kinds share ids, against its SQL."""
    _shared_tables(tmp_path)
    assert_same(QUERIES["image_scaled"](spark, str(tmp_path)), connect(str(tmp_path)), oracle_sql()["image_scaled"])


def _shared_tables(folder):
    """Orders and events whose images (50 x 30 and 40 x 25 pixels) share the ids 1000 and 1001."""
    import duckdb

    duckdb.sql(f"COPY (SELECT 1500000 + i AS o_orderkey, CASE WHEN i % 7 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus FROM range(3000) t(i)) TO '{folder}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT i AS event_id, i * 13 % 400 / 1.5e0 AS value, i * 7 % 900 AS user_id, CASE WHEN i % 3 = 0 THEN 'view' ELSE 'purchase' END AS event_type FROM range(2000) t(i)) TO '{folder}/events.parquet'")
