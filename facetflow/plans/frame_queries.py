"""Queries of coordinate frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import frames as op
from ..session import table
from .registry import query

R = lambda c: (F.round(c, 6) + 0.0)


def _edge(frame, parent, key):
    """A frame turned by key quarters about z and moved by (key % 7, 2, key % 3)."""
    turn = lambda values: F.get(F.array(*map(F.lit, values)), (key % 4).cast("int"))
    c, s, n = turn([1.0, 0.0, -1.0, 0.0]), turn([0.0, 1.0, 0.0, -1.0]), lambda x: F.lit(float(x))
    m = F.array(c, -s, n(0), (key % 7).cast("double"), s, c, n(0), n(2), n(0), n(0), n(1), (key % 3).cast("double"), n(0), n(0), n(0), n(1))
    return frame.alias("frame"), parent.alias("parent"), m.alias("m")


def _edges(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = table(spark, d, "customer").select(*_edge(name("C", "c_custkey"), name("N", "c_nationkey"), F.col("c_custkey")))
    n = table(spark, d, "nation").select(*_edge(name("N", "n_nationkey"), name("R", "n_regionkey"), F.col("n_nationkey")))
    r = table(spark, d, "region").select(*_edge(name("R", "r_regionkey"), F.lit("world"), F.col("r_regionkey")))
    return c.unionByName(n).unionByName(r)


def _turn_sql(source: str, key: str, out: str) -> str:
    q = f"{key} % 4"
    return f"{out} AS (SELECT * EXCLUDE (x, y, z), CASE {q} WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + {key} % 7 AS x, CASE {q} WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END + 2 AS y, z + {key} % 3 AS z FROM {source})"


_UP = f"a AS (SELECT c_custkey, n_nationkey, n_regionkey, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS z FROM customer JOIN nation ON n_nationkey = c_nationkey), {_turn_sql('a', 'c_custkey', 'b')}, {_turn_sql('b', 'n_nationkey', 'c')}, {_turn_sql('c', 'n_regionkey', 'e')}"


def _moved(df):
    p = vec.affine([F.get("m", F.lit(i)) for i in range(16)], (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return df.withColumns({n: R(x) for n, x in zip("xyz", p)})


@query("agg31_frames_to_root", f"WITH {_UP} SELECT 'C' || c_custkey AS frame, 'world' AS root, x, y, z, false AS ambiguous FROM e")
def frames_to_root(spark, d):
    """The point (1, 2, 3) of each customer's frame in the root's."""
    out = op.to_root(_edges(spark, d)).where("frame like 'C%'")
    return _moved(out).select("frame", "root", "x", "y", "z", "ambiguous")


@query("join12_frame_to_frame", f"WITH {_UP}, i AS (SELECT c_custkey, x - o_key % 7 AS x1, y - 2 AS y1, z - o_key % 3 AS z, o_key FROM (SELECT *, 4 - c_custkey % 5 AS o_key FROM e)) SELECT 'C' || c_custkey AS src, 'R' || o_key AS dst, CASE o_key % 4 WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN -x1 ELSE -y1 END + 0.0 AS x, CASE o_key % 4 WHEN 0 THEN y1 WHEN 1 THEN -x1 WHEN 2 THEN -y1 ELSE x1 END + 0.0 AS y, z + 0.0 AS z FROM i")
def frame_to_frame(spark, d):
    """The point (1, 2, 3) of each customer's frame in that of some region."""
    other = F.concat(F.lit("R"), (4 - F.col("c_custkey") % 5).cast("string"))
    pairs = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("src"), other.alias("dst"))
    return _moved(op.between(pairs, op.to_root(_edges(spark, d)))).select("src", "dst", "x", "y", "z")


@query("pred17_rigid", "SELECT p_partkey, p_size % 2 = 0 AS rigid FROM part")
def rigid(spark, d):
    """Turns about z by the key, stretched where the size is odd."""
    k, n = F.radians(F.col("p_partkey")), lambda x: F.lit(float(x))
    s = F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(1.01)
    m = F.array(F.cos(k) * s, -F.sin(k) * s, n(0), n(5), F.sin(k) * s, F.cos(k) * s, n(0), n(0), n(0), n(0), n(1), n(0), n(0), n(0), n(0), n(1))
    return table(spark, d, "part").select("p_partkey", op.is_rigid(m).alias("rigid"))
