"""Image files as pixel tables and pixel tables as image files.

Spark's image source decodes a file where it is read; a frame is one row, so its pixels are one task's, and frames are as large as their
files are. Columns count from the left, rows from the bottom: the last line of the file is iy = 0.

Defined results: files that are no images are left out; grey pictures have three equal colours, transparency is left out; when written, cells that
are missing are black, values are rounded and held to 0 to 255, of several values of a cell the largest counts, and cells beside the picture
and rows without an image are left out; an empty table writes nothing, a folder without images gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship


def png(grey: np.ndarray) -> bytes:
    """A grey 8-bit PNG of lines from the top."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((grey.shape[0], grey.shape[1] + 1), np.uint8)  # a line begins with its filter: none
    lines[:, 1:] = grey
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_png(pixels: DataFrame, folder: str, nx: int, ny: int) -> DataFrame:
    """A file <image>.png of each image of pixels (image, ix, iy, v): file, n (pixels that it was given). A task that is run again writes the
    same files anew."""
    inside = pixels.where(F.col("image").isNotNull() & F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1) & ~F.isnan(F.col("v").cast("double")))
    cells = inside.groupBy(F.col("image").cast("string").alias("image"), (F.col("iy") * nx + F.col("ix")).cast("int").alias("at")).agg(F.max(F.col("v").cast("double")).alias("v")).where("v is not null")
    frames = cells.groupBy("image").agg(F.collect_list("at").alias("at"), F.collect_list(F.least(F.greatest(F.round("v"), F.lit(0.0)), F.lit(255.0))).alias("v"))

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(path, recursive=True)
        for batch in batches:
            for image, at, v in zip(batch.column("image").to_pylist(), batch.column("at"), batch.column("v")):
                grey = np.zeros(nx * ny, np.uint8)
                grey[at.values.to_numpy()] = v.values.to_numpy()
                part = f"{path}/_{image}-{TaskContext.get().taskAttemptId()}"
                with where.open_output_stream(part) as out:
                    out.write(png(grey.reshape(ny, nx)[::-1]))
                where.move(part, f"{path}/{image}.png")
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.png" for i in batch.column("image").to_pylist()], pa.string()), pa.array([len(a) for a in batch.column("at").to_pylist()], pa.int64())], ["file", "n"])

    ship(pixels.sparkSession)
    return cut(frames.mapInArrow(run, "file string, n long"), "images")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file, ix, iy, r, g, b (0 to 255) of every pixel of the images of a folder."""
    ship(spark)
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            for origin, height, width, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                p = np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, n)
                blue, green, red = (p[:, :, min(k, n - 1)] for k in range(3))
                x, y = np.meshgrid(np.arange(width), np.arange(height - 1, -1, -1))
                columns = [pa.array([origin.rsplit("/", 1)[-1]] * (height * width)), *(pa.array(c.ravel().astype(np.int32)) for c in (x, y, red, green, blue))]
                yield from pa.Table.from_arrays(columns, ["file", "ix", "iy", "r", "g", "b"]).to_batches(max_chunksize=1 << 16)

    return found.mapInArrow(run, "file string, ix int, iy int, r int, g int, b int")
