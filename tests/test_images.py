"""Pictures on odd input."""

import zlib

import numpy as np

from facetflow.sources import images


def test_pictures_there_and_back(spark, tmp_path):
    rows = [("a", 0, 0, 1.4), ("a", 2, 1, 300.0), ("a", 1, 1, -5.0), ("a", 0, 1, 7.0), ("a", 0, 1, 9.0), ("a", 9, 9, 1.0), ("a", 1, 0, None), (None, 0, 0, 5.0), ("b", 0, 0, float("nan")), ("c", 2, 0, 255.0)]
    df = spark.createDataFrame(rows, "image string, ix int, iy int, v double")
    out = {r.file: r.n for r in images.write_png(df, str(tmp_path / "p"), 3, 2).collect()}
    assert out == {"a.png": 4, "c.png": 1}
    (tmp_path / "p" / "no.png").write_bytes(b"nothing")
    got = {(r.file, r.ix, r.iy): (r.r, r.g, r.b) for r in images.read_images(spark, str(tmp_path / "p")).collect()}
    want = {("a.png", x, y): (0,) * 3 for x in range(3) for y in range(2)} | {("c.png", x, y): (0,) * 3 for x in range(3) for y in range(2)}
    want |= {("a.png", 0, 0): (1,) * 3, ("a.png", 2, 1): (255,) * 3, ("a.png", 0, 1): (9,) * 3, ("c.png", 2, 0): (255,) * 3}
    assert got == want
    assert images.write_png(df.limit(0), str(tmp_path / "q"), 3, 2).count() == 0


def test_colours(spark, tmp_path):
    """A picture of two colours: lines from the top in the file, from the bottom in the table."""
    from struct import pack

    chunk = lambda kind, data: pack(">I", len(data)) + kind + data + pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(line) for line in ([10, 20, 30, 40, 50, 60], [1, 2, 3, 4, 5, 6]))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    got = {(r.ix, r.iy): (r.r, r.g, r.b) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 1): (10, 20, 30), (1, 1): (40, 50, 60), (0, 0): (1, 2, 3), (1, 0): (4, 5, 6)}
    assert images.png(np.zeros((1, 1), np.uint8))[:4] == b"\x89PNG"
