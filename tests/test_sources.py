"""Mesh files and reference chains on small inputs."""

import numpy as np
import pytest

from facetflow.operators.metadata import reference_chain
from facetflow.sources.stl import _RECORD, read_stl, read_stl_text, with_normals


def test_binary_and_text_stl_give_the_same_facets(spark, tmp_path):
    rng = np.random.default_rng(3)
    r = np.zeros(7, _RECORD)
    r["n"], r["v"] = rng.random((7, 3)), rng.random((7, 3, 3))
    (tmp_path / "a.stl").write_bytes(b"solid?".ljust(80) + np.uint32(7).tobytes() + r.tobytes())
    line = lambda word, p: word + " " + " ".join(repr(float(x)) for x in p)
    facets = ["facet " + line("normal", n) + "\nouter loop\n" + "\n".join(line("vertex", p) for p in v) + "\nendloop\nendfacet" for n, v in zip(r["n"], r["v"])]
    (tmp_path / "b.stl").write_text("solid b\n" + "\n".join(facets) + "\nendsolid b\n")
    (tmp_path / "none.stl").write_text("solid none\nendsolid none\n")
    got = read_stl(spark, str(tmp_path), 2.0).toPandas().sort_values(["mesh", "facet", "k"])
    a, b = (got[got.mesh.str.endswith(n)].drop(columns="mesh").to_numpy() for n in ("a.stl", "b.stl"))
    assert len(got) == 42 and np.array_equal(a, b)
    assert np.allclose(a[:, 2:5].reshape(7, 3, 3), r["v"] * 2.0) and np.allclose(a[::3, 5:], r["n"])
    split = read_stl_text(spark, str(tmp_path / "b.stl"), 2.0).toPandas().sort_values(["facet", "k"])
    assert np.allclose(split[["x", "y", "z", "nx", "ny", "nz"]].to_numpy(), a[:, 2:].astype(float)) and read_stl_text(spark, str(tmp_path / "none.stl")).count() == 0
    kept, made = (with_normals(read_stl_text(spark, str(tmp_path / "b.stl")), again).toPandas().sort_values(["facet", "k"]) for again in (False, True))
    want = np.cross(r["v"][:, 1] - r["v"][:, 0], r["v"][:, 2] - r["v"][:, 1])
    assert np.allclose(kept[["nx", "ny", "nz"]].to_numpy()[::3], r["n"]) and np.allclose(made[["nx", "ny", "nz"]].to_numpy()[::3], want / np.linalg.norm(want, axis=1)[:, None], atol=1e-4)


def test_long_reference_chain_and_circle(spark):
    n = 11
    refs = spark.createDataFrame([(f"c{i}", f"c{i + 1}", f"{i}.") for i in range(n)], "channel string, target string, prefix string")
    got = {r["channel"]: (r["root"], r["prefix"]) for r in reference_chain(refs).collect()}
    assert got == {f"c{i}": (f"c{n}", "".join(f"{k}." for k in range(i, n))) for i in range(n)}
    circle = spark.createDataFrame([("a", "b", ""), ("b", "a", "")], refs.schema)
    with pytest.raises(ValueError):
        reference_chain(circle).collect()
