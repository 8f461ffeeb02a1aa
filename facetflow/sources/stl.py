"""Triangle meshes from STL files, binary or text: corners as rows, their normals, shared vertices and surfaces.

Defined results: an empty folder or a file without facets gives no rows; facets of which a number can't be read raise in binaries and are
left out of texts; equal corners of a mesh become one vertex, those of different meshes never do.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import mesh as op
from ..session import cut, dealt, ship

#: Layout of a binary file: a header, a count, and records of normal, three corners and two spare bytes.
_HEADER = 80
_RECORD = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("spare", "<u2")])
_NUMBERS = re.compile(rb"(?:normal|vertex)\s+(\S+)\s+(\S+)\s+(\S+)")
#: Facets of one batch of rows, and of one partition of a binary file.
BATCH, RANGE = 50_000, 1 << 20
COLUMNS = "mesh string, facet long, k int, x double, y double, z double, nx double, ny double, nz double"


def triangles(content: bytes) -> np.ndarray:
    """n x 4 x 3: the normal and the three corners of each facet. A file whose length doesn't fit its count is read as text."""
    if len(content) >= _HEADER + 4:
        count = int(np.frombuffer(content, "<u4", 1, _HEADER)[0])
        if len(content) == _HEADER + 4 + count * _RECORD.itemsize:
            r = np.frombuffer(content, _RECORD, count, _HEADER + 4)
            return np.concatenate((r["n"][:, None, :], r["v"]), axis=1).astype(float)
    found = np.array([[float(x) for x in m] for m in _NUMBERS.findall(content)]).reshape(-1, 3)
    if len(found) % 4:
        raise ValueError("a facet without a normal and three corners")
    return found.reshape(-1, 4, 3)


def read_stl(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """mesh (the file), facet, k, x, y, z, nx, ny, nz: a row for each corner, positions times scale. A file is read by one task;
    read_stl_text splits large texts, read_stl_binary large binaries."""

    def run(frames):
        for frame in frames:
            for mesh, content in zip(frame.path, frame.content):
                t = triangles(content)
                for at in range(0, len(t), BATCH):
                    part = t[at : at + BATCH]
                    xyz, normal = part[:, 1:].reshape(-1, 3) * scale, np.repeat(part[:, 0], 3, axis=0)
                    ids = np.repeat(np.arange(at, at + len(part)), 3)
                    yield pd.DataFrame({"mesh": mesh, "facet": ids, "k": np.tile([0, 1, 2], len(part)).astype("int32"), **dict(zip("xyz", xyz.T)), **dict(zip(("nx", "ny", "nz"), normal.T))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stl").load(path).select("path", "content")
    return files.mapInPandas(run, COLUMNS)


def read_stl_text(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """The columns of read_stl from text files, which Spark splits: a record ends at `endfacet`. facet rises within a mesh but has gaps."""
    t = spark.read.option("lineSep", "endfacet").text(path).select(F.col("_metadata.file_path").alias("mesh"), F.monotonically_increasing_id().alias("facet"), "value")
    three = r"(?:normal|vertex)\s+(\S+)\s+(\S+)\s+(\S+)"
    t = t.select("mesh", "facet", *(F.transform(F.regexp_extract_all("value", F.lit(three), F.lit(i + 1)), lambda x: x.try_cast("double")).alias(c) for i, c in enumerate("xyz")))
    t = t.where((F.size("x") == 4) & ~F.exists(F.concat("x", "y", "z"), lambda v: v.isNull()))
    corner = F.posexplode(F.array(*(F.struct(*(F.get(c, F.lit(k)).alias(c) for c in "xyz")) for k in (1, 2, 3))))
    t = t.select("mesh", "facet", *(F.get(c, F.lit(0)).alias("n" + c) for c in "xyz"), corner.alias("k", "p"))
    return t.select("mesh", "facet", "k", *((F.col("p." + c) * scale).alias(c) for c in "xyz"), "nx", "ny", "nz")


def write_stl_text(triangles: DataFrame, path: str) -> None:
    """Text files of triangles (mesh, facet, k = 0 to 2, x, y, z, nx, ny, nz), a facet a row, each in a solid of its mesh's name. A file
    is a mesh to the readers, so all facets of one stand in one file. Corners are dealt by mesh once, as numbers; texts are made where they are written."""
    number = lambda *cs: F.concat_ws(" ", *(F.col(c).cast("string") for c in cs))
    line = F.concat(F.lit("    vertex "), number(*"xyz"))
    corners = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("s")))), lambda r: r["s"]), "\n")
    f = triangles.repartition("mesh").groupBy("mesh", "facet").agg(corners.alias("corners"), *(F.first(c).alias(c) for c in ("nx", "ny", "nz")))
    name = F.col("mesh").cast("string")
    f.select(F.concat(F.lit("solid "), name, F.lit("\nfacet normal "), number("nx", "ny", "nz"), F.lit("\n  outer loop\n"), "corners", F.lit("\n  endloop\nendfacet\nendsolid "), name)).write.text(path)


def with_normals(triangles: DataFrame, again: bool = False) -> DataFrame:
    """triangles with the facets' normals from their corners, for all meshes if asked, else for those whose first facet has a normal of zero;
    the normal of a facet without area stays null then."""
    zero = (F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)
    first = triangles.groupBy("mesh").agg((F.lit(again) | F.min_by(zero, "facet")).alias("anew"))
    made = op.normals(triangles.select("mesh", "facet", "k", "x", "y", "z")).select("mesh", "facet", *(F.col(c).alias("m" + c) for c in ("nx", "ny", "nz")))
    j = triangles.join(first, "mesh").join(dealt(made), ["mesh", "facet"])
    return j.select("mesh", "facet", "k", "x", "y", "z", *(F.when(F.col("anew"), F.col("m" + c)).otherwise(F.col(c)).alias(c) for c in ("nx", "ny", "nz")))


def surfaces(triangles: DataFrame, angle: float) -> DataFrame:
    """mesh, facet, surface: triangles (with their normals) joined over shared edges where normals are within an angle. A vertex is named by the
    first corner at its place."""
    place = ["mesh", "x", "y", "z"]
    first = F.min(F.col("facet") * 3 + F.col("k")).over(Window.partitionBy(*place))
    corners = cut(triangles.select(*place, "facet", "k").dropna(subset=place).select("mesh", "facet", "k", first.alias("vid")), "named-corners")  # read for edges, and for facets without any
    normals = triangles.where("k = 0").select("mesh", "facet", "nx", "ny", "nz")
    return op.segments(corners, normals, angle)


class BinaryStl(DataSource):
    """The facets of binary STL files as a Spark source whose partitions are ranges of whole records after the header, so that many tasks read
    one file. Options: path (a folder or a file, any that pyarrow's file systems open), facets (records a partition), scale. Files whose length
    doesn't fit their count are no binaries and are left out; so are files that hold no facet."""

    @classmethod
    def name(cls) -> str:
        return "facetflow_binary_stl"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return BinaryStlReader(self.options)


class Records(InputPartition):
    def __init__(self, path: str, mesh: str, first: int, count: int):
        super().__init__(None)
        self.path, self.mesh, self.first, self.count = path, mesh, first, count


class BinaryStlReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.facets, self.scale = int(options.get("facets", RANGE)), float(options.get("scale", 1.0))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[Records]:
        from pyarrow import fs

        where, path = self._open()
        found = where.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".stl")), key=lambda f: f.path):
            if f.size < _HEADER + 4:
                continue
            with where.open_input_file(f.path) as data:
                count = int(np.frombuffer(data.read_at(4, _HEADER), "<u4")[0])
            if f.size == _HEADER + 4 + count * _RECORD.itemsize:
                out += [Records(f.path, f.path, at, min(self.facets, count - at)) for at in range(0, count, self.facets)]
        return out or [Records("", "", 0, 0)]

    def read(self, partition: Records):
        import pyarrow as pa

        if not partition.count:
            return
        where, _ = self._open()
        with where.open_input_file(partition.path) as data:
            for at in range(partition.first, partition.first + partition.count, BATCH):
                n = min(BATCH, partition.first + partition.count - at)
                r = np.frombuffer(data.read_at(n * _RECORD.itemsize, _HEADER + 4 + at * _RECORD.itemsize), _RECORD, n)
                xyz, normal = r["v"].reshape(-1, 3).astype(float) * self.scale, np.repeat(r["n"].astype(float), 3, axis=0)
                columns = [pa.array([partition.mesh] * (3 * n)), pa.array(np.repeat(np.arange(at, at + n), 3)), pa.array(np.tile(np.arange(3, dtype=np.int32), n)), *map(pa.array, (*xyz.T, *normal.T))]
                yield pa.RecordBatch.from_arrays(columns, ["mesh", "facet", "k", "x", "y", "z", "nx", "ny", "nz"])


def read_stl_binary(spark: SparkSession, path: str, scale: float = 1.0, facets: int = RANGE) -> DataFrame:
    """The columns of read_stl from binary files, each read by as many tasks as it has ranges of `facets` records."""
    ship(spark).dataSource.register(BinaryStl)
    return spark.read.format(BinaryStl.name()).options(path=path, scale=str(scale), facets=str(facets)).load()


def write_stl_binary(triangles: DataFrame, folder: str, files: int | None = None, facets: int = RANGE) -> DataFrame:
    """Binary files of triangles (mesh, facet, k = 0 to 2, x, y, z, nx, ny, nz) ordered by mesh and facet, cut in so many ranges, else in as many as
    Spark makes: file, n; files in the order of their names hold the triangles in order. A file holds at most so many facets, and a task holds one
    file; a task that is run again writes the same files anew. Numbers are stored in single precision; a normal that is null becomes zero."""
    corners = F.array_sort(F.collect_list(F.struct("k", "x", "y", "z")))
    normal = lambda c: F.coalesce(F.first(c).cast("float"), F.lit(0.0).cast("float"))
    rows = triangles.groupBy("mesh", "facet").agg(F.array(*(normal(c) for c in ("nx", "ny", "nz"))).alias("n"), F.flatten(F.transform(corners, lambda c: F.array(*(c[a].cast("float") for a in "xyz")))).alias("v"))
    rows = (rows.repartitionByRange(files, "mesh", "facet") if files else rows.repartitionByRange("mesh", "facet")).sortWithinPartitions("mesh", "facet").select("n", "v")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(path, recursive=True)
        context = TaskContext.get()
        held, size, made = [], 0, 0

        def write():
            r = np.zeros(size, _RECORD)
            r["n"] = np.concatenate([a for a, _ in held] or [np.empty((0, 3))])
            r["v"] = np.concatenate([b for _, b in held] or [np.empty((0, 3, 3))])
            name = f"part-{context.partitionId():06d}-{made:06d}.stl"
            with where.open_output_stream(f"{path}/_{name}-{context.taskAttemptId()}") as out:
                out.write(b"binary".ljust(_HEADER) + np.array([size], "<u4").tobytes())
                out.write(memoryview(r).cast("B") if size else b"")
            where.move(f"{path}/_{name}-{context.taskAttemptId()}", f"{path}/{name}")
            return pa_batch(name, size)

        for b in batches:
            n, v = b.column("n").flatten().to_numpy().reshape(-1, 3), b.column("v").flatten().to_numpy().reshape(-1, 3, 3)
            at = 0
            while at < len(n):
                end = min(len(n), at + facets - size)
                held.append((n[at:end], v[at:end]))
                size, at = size + end - at, end
                if size == facets:
                    yield write()
                    held, size, made = [], 0, made + 1
        if size or not made:
            yield write()

    return cut(rows.mapInArrow(run, "file string, n long"), "stl-files")


def pa_batch(name: str, n: int):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})
