"""Meshes from and to X3D text: one row a shape on reading, one text a mesh on writing. Numbers are split by Spark."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import frames
from ..operators.metadata import number_rows
from ..session import cut, dealt

_SHAPE = "doc string, shape int, name string, index string, point string, uv string, uv_index string, normal string, normal_index string, curvatures string, axes string, texture string, unit double, m array<double>"
#: Characters of texts that a task holds before it passes them on.
HELD = 4_000_000
_COLUMNS = [c.split()[0] for c in _SHAPE.split(", ")]


def _numbers(text: str | None, default: tuple) -> list[float]:
    found = [float(x) for x in (text or "").replace(",", " ").split()]
    return found or list(default)


def _turn(axis_angle: list[float]) -> np.ndarray:
    *axis, angle = axis_angle
    a, out = np.asarray(axis), np.eye(4)
    if (length := np.linalg.norm(a)) > 0:
        x, y, z = a / length
        k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        out[:3, :3] += np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)
    return out


def _move(v: list[float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = v
    return out


def _transform(e: ET.Element) -> np.ndarray:
    """A Transform node's matrix: the turn and the scale (along its own axes) are about its centre."""
    get = lambda name, *default: _numbers(e.get(name), default)
    centre, scale = get("center", 0, 0, 0), np.diag([*get("scale", 1, 1, 1), 1.0])
    own = _turn(get("scaleOrientation", 0, 0, 1, 0))
    return _move(get("translation", 0, 0, 0)) @ _move(centre) @ _turn(get("rotation", 0, 0, 1, 0)) @ own @ scale @ own.T @ _move([-c for c in centre])


def _shapes(doc: str, text: str):
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    named = {e.get("DEF"): e for e in root.iter() if e.get("DEF")}
    real = lambda e: named[e.get("USE")] if e.get("USE") else e
    part = lambda e, tag: next((real(x) for x in e if x.tag == tag), None)
    unit = next((float(e.get("conversionFactor", 1)) for e in root.iter() if e.tag == "unit" and e.get("category") == "length"), 1.0)
    waiting, count = [(root, np.diag([unit, unit, unit, 1.0]))], 0
    while waiting:
        e, m = waiting.pop()
        e = real(e)
        if e.tag == "Shape":
            faces, look = part(e, "IndexedFaceSet"), part(e, "Appearance")
            if faces is not None:
                points, uv = part(faces, "Coordinate"), part(faces, "TextureCoordinate")
                image = part(look, "ImageTexture") if look is not None else None
                value = lambda x, key: x.get(key) if x is not None else None
                normal, bent, axes = part(faces, "Normal"), part(faces, "PrincipalCurvatures"), part(faces, "CurvatureTangentAxes")
                yield doc, count, e.get("DEF"), faces.get("coordIndex", ""), value(points, "point") or "", value(uv, "point"), faces.get("texCoordIndex"), value(normal, "vector"), faces.get("normalIndex"), value(bent, "curvatures"), value(axes, "axes"), value(image, "url"), unit, m.ravel().tolist()
                count += 1
        elif e.tag != "IndexedFaceSet":
            m = m @ _transform(e) if e.tag == "Transform" else m
            waiting.extend((x, m) for x in reversed(e))


def shapes(docs: DataFrame) -> DataFrame:
    """doc, shape, name, index, point, uv, uv_index, normal, normal_index, curvatures, axes, texture, unit (metres a length), m (to the
    document's frame in metres) from (doc, text): one row a shape with faces.

    DEF and USE are followed, Transform nodes are composed. A null text has no shapes; broken XML or a USE of nothing raises. One
    document is held at a time; rows leave when some megabytes of texts are together."""

    def run(frames):
        held, size = [], 0
        for frame in frames:
            for doc, text in zip(frame.doc, frame.text):
                for row in _shapes(doc, text) if text is not None else ():
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str))
                    if size > HELD:
                        yield pd.DataFrame(held, columns=_COLUMNS)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=_COLUMNS)

    return docs.select(F.col("doc").cast("string"), "text").mapInPandas(run, _SHAPE)


def _key() -> Column:
    return F.struct("doc", "shape").alias("mesh")


def _number_columns(found: DataFrame, text: str, names: list[str]) -> DataFrame:
    """mesh, row and names: the numbers of a text column, so many a row; shapes without the text have no rows."""
    rows = number_rows(found.where(F.col(text).isNotNull()).select(_key(), F.col(text).alias("text")), len(names))
    return rows.groupBy("mesh", "row").agg(*(F.max(F.when(F.col("k") == i, F.col("value"))).alias(n) for i, n in enumerate(names)))


def vertices(found: DataFrame) -> DataFrame:
    """mesh (struct of doc and shape), vid, x, y, z in the document's frame."""
    found = cut(found, "shapes")
    rows = _number_columns(found, "point", ["x", "y", "z"]).withColumnRenamed("row", "vid")
    at = lambda i: sum((F.get("m", F.lit(4 * i + k)) * F.col(n) for k, n in enumerate("xyz")), F.get("m", F.lit(4 * i + 3)))
    return rows.join(dealt(found.select(_key(), "m")), "mesh").select("mesh", "vid", *(at(i).alias(n) for i, n in enumerate("xyz")))


def _corner_ids(found: DataFrame, text: str, name: str) -> DataFrame:
    """mesh, facet, k and the ids of an index text; only its -1 ends hold a minus."""
    words = lambda p: F.filter(F.split(p, r"[\s,]+"), lambda w: w != "")
    faces = F.filter(F.transform(F.split(text, "-1"), words), lambda ids: F.size(ids) > 0)
    f = found.select(_key(), F.posexplode(faces).alias("facet", "ids"))
    return f.select("mesh", "facet", F.posexplode("ids").alias("k", "id")).withColumn("id", F.col("id").cast("int")).withColumnRenamed("id", name)


def corners(found: DataFrame) -> DataFrame:
    """mesh, facet, k, vid, u, v, nx, ny, nz: every corner with its texture coordinate and its normal in the document's frame, null where the
    text has none. Without an index of their own both follow the vertices; an index without an entry for a corner gives null. Normals are
    turned by the inverse transposed map and have length 1."""
    found = cut(found, "shapes")
    own = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), "index")
    c = _corner_ids(found, "index", "vid")
    for text, name in (("uv_index", "uv_id"), ("normal_index", "normal_id")):
        c = c.join(dealt(_corner_ids(found.withColumn("one", own(text)), "one", name)), ["mesh", "facet", "k"], "left")
    c = c.join(dealt(_number_columns(found, "uv", ["u", "v"]).withColumnRenamed("row", "uv_id")), ["mesh", "uv_id"], "left")
    n = _number_columns(found, "normal", ["x", "y", "z"]).withColumnRenamed("row", "normal_id")
    n = n.join(dealt(found.select(_key(), frames.inverse(F.col("m")).alias("back"))), "mesh")
    turned = [sum((F.get("back", F.lit(4 * k + i)) * F.col(a) for k, a in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    n = n.select("mesh", "normal_id", *(e.alias(a) for a, e in zip(("nx", "ny", "nz"), vec.unit(turned))))
    return c.join(dealt(n), ["mesh", "normal_id"], "left").select("mesh", "facet", "k", "vid", "u", "v", "nx", "ny", "nz")


def curvatures(found: DataFrame) -> DataFrame:
    """mesh, vid, k1, k2 (one over metres), ax, ay, az, bx, by, bz: the principal curvatures of vertices and their tangents, turned by the
    document's map to length 1. Shapes without curvatures have no rows, curvatures without axes null axes."""
    found = cut(found, "shapes")
    k = _number_columns(found, "curvatures", ["k1", "k2"])
    t = _number_columns(found, "axes", ["px", "py", "pz", "qx", "qy", "qz"])
    j = k.join(dealt(t), ["mesh", "row"], "left").join(dealt(found.select(_key(), "m", "unit")), "mesh")
    turn = lambda p: vec.unit([sum((F.get("m", F.lit(4 * i + c)) * F.col(p + a) for c, a in enumerate("xyz")), F.lit(0.0)) for i in range(3)])
    ends = [e.alias(n + a) for n, p in (("a", "p"), ("b", "q")) for a, e in zip("xyz", turn(p))]
    return j.select("mesh", F.col("row").alias("vid"), (F.col("k1") / F.col("unit")).alias("k1"), (F.col("k2") / F.col("unit")).alias("k2"), *ends)


def packed(found: DataFrame) -> DataFrame:
    """mesh and its index array with -1 ends, as operators.mesh.packed_polygons takes it."""
    words = F.filter(F.split("index", r"[\s,]+"), lambda w: w != "")
    return found.select(F.struct("doc", "shape").alias("mesh"), F.transform(words, lambda w: w.cast("int")).alias("index"))


def _joined(values: Column, order: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, values.alias("s")))), lambda r: r["s"]), between)


def texts(corner_table: DataFrame, vertex_table: DataFrame, facet_normals: DataFrame | None = None, curvature_table: DataFrame | None = None) -> DataFrame:
    """mesh, text: one X3D text a mesh, faces and vertices in order. vid counts a mesh's vertices from 0, facet its facets from 0.

    With columns u and v each corner gets a texture coordinate of its own; facet_normals (mesh, facet, nx, ny, nz) gives one normal a facet;
    curvature_table (mesh, vid, k1, k2, ax .. bz) the curvatures of all vertices. A mesh's text is one value, so a mesh is as large as a value may be."""
    number = lambda c: F.col(c).cast("string")
    words = lambda *cs: F.concat_ws(" ", *map(number, cs))
    has_uv = "u" in corner_table.columns
    face = corner_table.groupBy("mesh", "facet").agg(_joined(number("vid"), "k", " ").alias("ids"), F.count("*").alias("n"), *([_joined(words("u", "v"), "k", ", ").alias("uv")] if has_uv else []))
    same = F.concat(F.array_join(F.array_repeat(number("facet"), F.col("n").cast("int")), " "), F.lit(" -1"))
    per = {"index": F.concat("ids", F.lit(" -1")), "normals": same}
    if has_uv:
        start = F.sum("n").over(Window.partitionBy("mesh").orderBy("facet")) - F.col("n")
        face = face.withColumn("start", start)
        ids = F.transform(F.sequence("start", F.col("start") + F.col("n") - 1), lambda x: x.cast("string"))
        per |= {"uv_ids": F.concat(F.array_join(ids, " "), F.lit(" -1"))}
    out = face.groupBy("mesh").agg(*(_joined(e, "facet", " ").alias(n) for n, e in per.items()), *([_joined(F.col("uv"), "facet", ", ").alias("uv")] if has_uv else []))
    out = out.join(dealt(vertex_table.groupBy("mesh").agg(_joined(words(*"xyz"), "vid", ", ").alias("point"))), "mesh")
    head, body = [F.lit('<X3D version="3.3"><Scene><Shape><IndexedFaceSet coordIndex="'), F.col("index")], [F.lit('"><Coordinate point="'), F.col("point"), F.lit('"/>')]
    if has_uv:
        head += [F.lit('" texCoordIndex="'), F.col("uv_ids")]
        body += [F.lit('<TextureCoordinate point="'), F.col("uv"), F.lit('"/>')]
    if facet_normals is not None:
        out = out.join(dealt(facet_normals.groupBy("mesh").agg(_joined(words("nx", "ny", "nz"), "facet", ", ").alias("vector"))), "mesh", "left")
        head += [F.lit('" normalIndex="'), F.col("normals")]
        body += [F.lit('<Normal vector="'), F.coalesce("vector", F.lit("")), F.lit('"/>')]
    if curvature_table is not None:
        bent = curvature_table.groupBy("mesh").agg(_joined(words("k1", "k2"), "vid", ", ").alias("bent"), _joined(words("ax", "ay", "az", "bx", "by", "bz"), "vid", ", ").alias("axes"))
        out = out.join(dealt(bent), "mesh", "left")
        more = F.concat(F.lit('<PrincipalCurvatures curvatures="'), "bent", F.lit('"/><CurvatureTangentAxes axes="'), "axes", F.lit('"/>'))
        body.append(F.coalesce(more, F.lit("")))
    return out.select("mesh", F.concat(*head, *body, F.lit("</IndexedFaceSet></Shape></Scene></X3D>")).alias("text"))
