"""Queries over measurement pixels and waveforms."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import vec
from ..operators import fusion as op
from ..operators import waves as wv
from ..operators.diffusion import diffuse, diffusion_steps
from ..session import table
from ..sources import fixtures as fx
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
FUSED = "fused AS (SELECT ix, iy, t, sum(w * v) / sum(w) AS v, sum(w) AS w FROM pixels WHERE w > 0 GROUP BY ALL)"


@query("agg18_fuse", f"WITH {fx.PIXELS_SQL}, {FUSED} SELECT ix, iy, t, round(v, 6) + 0.0 AS v, round(w, 6) + 0.0 AS w FROM fused")
def fuse(spark, d):
    return op.fuse(fx.pixels(spark, d)).select("ix", "iy", "t", R("v").alias("v"), R("w").alias("w"))


@query("agg17_normalize", f"WITH {fx.PIXELS_SQL}, a AS (SELECT ix, iy, t, sum(w * v) AS s, sum(w) AS w FROM pixels GROUP BY ALL) SELECT ix, iy, t, CASE WHEN w < 0.01 THEN 0.0 ELSE round(s / w, 6) END + 0.0 AS v FROM a")
def normalize(spark, d):
    return op.normalize(op.accumulate(fx.pixels(spark, d))).select("ix", "iy", "t", R("v").alias("v"))


@query("agg19_accumulate", f"WITH {fx.PIXELS_SQL} SELECT ix, iy, t, round(sum(w * v), 6) + 0.0 AS sum_wv, round(sum(w), 6) + 0.0 AS sum_w FROM pixels GROUP BY ALL")
def accumulate(spark, d):
    """Each shot added to what was there before it."""
    p = fx.pixels(spark, d)
    out = op.accumulate(p.where("shot = 0"))
    for s in range(1, 4):
        out = op.merge(out, op.accumulate(p.where(F.col("shot") == s)))
    return out.select("ix", "iy", "t", R("sum_wv").alias("sum_wv"), R("sum_w").alias("sum_w"))


@query("agg20_accumulate_stack", f"WITH {fx.PIXELS_SQL} SELECT ix, iy, t, CASE WHEN sum(w) < 0.01 THEN 0.0 ELSE round(sum(w * v) / sum(w), 6) END + 0.0 AS v, round(sum(w), 6) + 0.0 AS w FROM pixels GROUP BY ALL")
def accumulate_stack(spark, d):
    p = fx.pixels(spark, d)
    out = op.normalize(op.merge(*(op.accumulate(p.where(F.col("shot") == s)) for s in range(4))))
    return out.select("ix", "iy", "t", R("v").alias("v"), R("sum_w").alias("w"))


@query("agg21_subtract_early_average", f"WITH {fx.PIXELS_SQL}, {FUSED} SELECT ix, iy, t, round(v - avg(v) FILTER (t <= 3) OVER (PARTITION BY ix, iy), 6) + 0.0 AS v FROM fused")
def subtract(spark, d):
    return op.subtract_early_average(op.fuse(fx.pixels(spark, d)), 3).select("ix", "iy", "t", R("v").alias("v"))


@query("agg22_weight_drift", f"WITH {fx.PIXELS_SQL}, {FUSED}, w0 AS (SELECT ix, iy, w AS w0 FROM fused WHERE t = 1), f AS (SELECT DISTINCT t FROM fused WHERE t <> 1), g AS (SELECT * FROM w0, f), j AS (SELECT t, coalesce(w0, 0) - coalesce(w, 0) AS d FROM g FULL JOIN (SELECT ix, iy, t, w FROM fused WHERE t <> 1) s USING (ix, iy, t)) SELECT t, round(sqrt(sum(d * d)) / (SELECT sqrt(sum(w0 * w0)) FROM w0), 6) AS drift FROM j GROUP BY t")
def drift(spark, d):
    return op.weight_drift(op.fuse(fx.pixels(spark, d))).select("t", R("drift").alias("drift"))


NEXT = "a AS (SELECT shot + 1 AS pair, ix, iy, t, avg(v) AS a, 1 AS o FROM pixels WHERE shot < 3 GROUP BY ALL), b AS (SELECT shot AS pair, ix, iy, t, avg(v) AS b, 1 AS n FROM pixels WHERE shot > 0 GROUP BY ALL)"
PAIRED = ("pair", *op.CELL)


def _consecutive(spark, d):
    """(old, new): the mean rasters of all shots, each paired with the one after it; the pair is named by the later."""
    p = fx.pixels(spark, d).groupBy("shot", *op.CELL).agg(F.avg("v").alias("v"))
    return p.where("shot < 3").withColumn("pair", F.col("shot") + 1).drop("shot"), p.where("shot > 0").withColumnRenamed("shot", "pair")


@query("join20_overlap", f"WITH {fx.PIXELS_SQL}, {NEXT} SELECT pair, ix, iy, t, CASE WHEN o IS NULL THEN 'only_new' WHEN n IS NULL THEN 'only_old' ELSE 'both' END AS kind FROM a FULL JOIN b USING (pair, ix, iy, t)")
def overlap(spark, d):
    return op.overlap(*_consecutive(spark, d), cell=PAIRED)


@query("join24_compare", f"WITH {fx.PIXELS_SQL}, {NEXT}, j AS (SELECT pair, a, b, coalesce(a, 0) - coalesce(b, 0) AS d FROM a FULL JOIN b USING (pair, ix, iy, t)) SELECT pair, count(*) FILTER (a IS DISTINCT FROM b) AS n_differ, round(sqrt(sum(d * d)) / sqrt(sum(a * a)), 6) AS relative FROM j GROUP BY pair")
def compare(spark, d):
    return op.compare(*_consecutive(spark, d), cell=PAIRED, by=("pair",)).select("pair", "n_differ", R("relative").alias("relative"))


@query("set03_mask_difference", f"WITH {fx.PIXELS_SQL}, {NEXT} SELECT pair, ix, iy, t FROM b EXCEPT SELECT pair, ix, iy, t FROM a")
def only_new(spark, d):
    old, new = _consecutive(spark, d)
    return new.select(*PAIRED).subtract(old.select(*PAIRED))


@query("set03_mask_intersection", f"WITH {fx.PIXELS_SQL}, {NEXT} SELECT pair, ix, iy, t FROM b INTERSECT SELECT pair, ix, iy, t FROM a")
def both(spark, d):
    old, new = _consecutive(spark, d)
    return new.select(*PAIRED).intersect(old.select(*PAIRED))


@query("join22_shared_parameter", "WITH m AS (SELECT o_custkey AS specimen, o_orderkey AS measurement, o_orderpriority AS param FROM orders), ok AS (SELECT specimen, count(DISTINCT param) AS n_params FROM m GROUP BY specimen) SELECT specimen, measurement, l_linenumber AS file, n_params, n_params = 1 AS usable FROM m JOIN ok USING (specimen) JOIN lineitem ON l_orderkey = measurement")
def shared(spark, d):
    """Customers as specimens, orders as measurements, line items as their files."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("specimen"), F.col("o_orderkey").alias("measurement"), F.col("o_orderpriority").alias("param"))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("measurement"), F.col("l_linenumber").alias("file"))
    return op.measurement_files(m, f)


@query("pred12_present_pixels", f"WITH {fx.PIXELS_SQL} SELECT shot, count(*) AS n, round(sum(v), 6) AS total FROM pixels WHERE ix % 29 <> 0 GROUP BY shot")
def present(spark, d):
    p = fx.pixels(spark, d).withColumn("v", F.when(F.col("ix") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return p.where(op.present(F.col("v"))).groupBy("shot").agg(F.count("*").alias("n"), R(F.sum("v")).alias("total"))


@query("agg29_frame_range", f"WITH {fx.PIXELS_SQL} SELECT t, min(CASE WHEN ix % 29 <> 0 THEN v END) AS lo, max(CASE WHEN ix % 29 <> 0 THEN v END) AS hi, count(*) FILTER (ix % 29 = 0) AS n_missing FROM pixels GROUP BY t")
def frame_range(spark, d):
    p = fx.pixels(spark, d).withColumn("v", F.when(F.col("ix") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return op.frame_range(p, "t")


FRAME = ("shot", "t")


@query("agg35_dense_raster", f"WITH {fx.PIXELS_SQL}, r AS (SELECT shot, t, ix, iy, sum(v) AS v FROM pixels GROUP BY ALL) SELECT f.shot, f.t, (i % 32)::INTEGER AS ix, (i // 32)::INTEGER AS iy, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT shot, t FROM pixels) f CROSS JOIN range(1024) g(i) LEFT JOIN r ON r.shot = f.shot AND r.t = f.t AND r.ix = i % 32 AND r.iy = i // 32")
def dense(spark, d):
    p = fx.pixels(spark, d).groupBy(*FRAME, "ix", "iy").agg(F.sum("v").alias("v"))
    return op.dense(p, 32, 32, frame=FRAME).select(*FRAME, "ix", "iy", "v")


@query("agg36_hit_count", f"WITH {fx.PIXELS_SQL} SELECT shot, count(*) FILTER (w > 0) AS hits, count(*) AS pixels, count(DISTINCT ix * 32 + iy) AS cells FROM pixels GROUP BY shot")
def hits(spark, d):
    return fx.pixels(spark, d).groupBy("shot").agg(F.count_if(F.col("w") > 0).alias("hits"), F.count("*").alias("pixels"), F.countDistinct(F.col("ix") * 32 + F.col("iy")).alias("cells"))


GRID = f"WITH {fx.PIXELS_SQL}, r AS (SELECT shot, t, ix, iy, max(v) AS v FROM pixels GROUP BY ALL), g AS (SELECT f.shot, f.t, (i % 32)::INTEGER AS ix, (i // 32)::INTEGER AS iy, coalesce(r.v, 0.0) AS v FROM (SELECT DISTINCT shot, t FROM pixels) f CROSS JOIN range(1024) q(i) LEFT JOIN r ON r.shot = f.shot AND r.t = f.t AND r.ix = i % 32 AND r.iy = i // 32)"
ERODE = "least(m, coalesce(lag(m) OVER r, false), coalesce(lead(m) OVER r, false), coalesce(lag(m) OVER c, false), coalesce(lead(m) OVER c, false))"
WINDOWS = "WINDOW r AS (PARTITION BY shot, t, iy ORDER BY ix), c AS (PARTITION BY shot, t, ix ORDER BY iy)"


def _grid(spark, d):
    return op.dense(fx.pixels(spark, d).groupBy(*FRAME, "ix", "iy").agg(F.max("v").alias("v")), 32, 32, frame=FRAME)


#: Depths from values, some missing, and what a plane through each pixel predicts for the next ones.
DEPTH = "d AS (SELECT shot, t, ix, iy, CASE WHEN v = 13 THEN NULL ELSE 100 + v END AS z, (v - 25) / 10 AS dx, (ix - 16) / 8.0::DOUBLE AS dy FROM g)"
NEAR = "s AS (SELECT *, lag(z) OVER r AS l, lead(z) OVER r AS n, lag(z) OVER c AS u, lead(z) OVER c AS e FROM d " + WINDOWS + ")"
AGREE = " AND ".join(f"coalesce(abs(atan2({p}, z / {f}.0::DOUBLE) - atan2({a}, z / {q}.0::DOUBLE)) < pi() / 5, false)" for p, f, a, q in (("dx", 20, "z - n", 20), ("dx", 20, "l - z", 20), ("dy", 25, "z - e", 25), ("dy", 25, "u - z", 25)))


@query("win03_slope_mismatch", f"{GRID}, {DEPTH}, {NEAR} SELECT shot, t, ix, iy, NOT ({AGREE}) AS m FROM s")
def mismatch(spark, d):
    v = F.col("v")
    g = _grid(spark, d).select(*FRAME, "ix", "iy", F.when(v == 13, F.lit(float("nan"))).otherwise(100 + v).alias("z"), ((v - 25) / 10).alias("dx"), ((F.col("ix") - 16) / 8.0).alias("dy"))
    return op.slope_mismatch(g, (20.0, 25.0), FRAME)


@query("win04_opening", f"{GRID}, m0 AS (SELECT shot, t, ix, iy, v >= 5 AS m FROM g), m1 AS (SELECT shot, t, ix, iy, {ERODE} AS m FROM m0 {WINDOWS}) SELECT shot, t, ix, iy, {ERODE.replace('least', 'greatest')} AS m FROM m1 {WINDOWS}")
def opening(spark, d):
    return op.opened(_grid(spark, d).select(*FRAME, "ix", "iy", (F.col("v") >= 5).alias("m")), FRAME)


def _scalar(name, sql, expr, src=fx.PIXELS_SQL, frm="pixels", keys=("shot", "ix", "iy", "t", "v")):
    """A scalar function over all rows of a fixture."""

    @query(name, f"WITH {src} SELECT {', '.join(keys)}, {sql} AS out FROM {frm}")
    def run(spark, d):
        return {"pixels": fx.pixels, "waves": fx.waves, "lines": fx.lines}[frm](spark, d).select(*keys, expr(F.col("v")).alias("out"))

    return run


V = "CASE WHEN ix % 29 = 0 THEN NULL ELSE v END"  # every 29th column is missing; in Spark NaN
_v = lambda v: F.when(F.col("ix") % 29 == 0, F.lit(float("nan"))).otherwise(v)
for bits, a, b in ((8, 1, 255), (16, 10, 65535)):
    code = f"(CASE WHEN {V} IS NULL THEN 0 WHEN v < 10 THEN {a} WHEN v > 40 THEN {b} ELSE floor((v - 10) / (40.0::DOUBLE - 10) * {b - a} + {a}) END)::INTEGER"
    _scalar(f"sf20_quantize{bits}", code, lambda v, bits=bits: sc.quantize(_v(v), 10, 40, bits))
    _scalar(f"sf21_dequantize{bits}", f"round(CASE WHEN {code} <> 0 THEN ({code} - {a}) / {b - a}.0::DOUBLE * 30 + 10 END, 6)", lambda v, bits=bits: F.round(sc.dequantize(sc.quantize(_v(v), 10, 40, bits), 10, 40, bits), 6))
_scalar("sf22_invert", "255 - v::INTEGER", lambda v: sc.invert(v.cast("int")))
_scalar("sf23_normalize", "round((v - 25) / 10 + 0.5, 6)", lambda v: F.round(sc.normalize(v, 25, 10), 6))
_scalar("sf24_scale", "round((v - 4.3) / 2.0, 6)", lambda v: F.round(sc.scale(v, 4.3, 2.0), 6))
_scalar("sf26_pixel_to_physical", "round(-1.5 + ix * 0.25, 6)", lambda v: F.round(sc.pixel_to_physical(F.col("ix"), -1.5, 0.25), 6))
_scalar("sf27_physical_to_pixel", "31 - floor((v - 1) / 1.6::DOUBLE + 0.5)::INTEGER", lambda v: sc.physical_to_pixel(v, 1, 1.6, 32))
_scalar("sf31_reverse_y", "31 - iy", lambda v: sc.reverse(F.col("iy"), 32))
_scalar("sf16_dots_per_inch", "round(0.0254 / nullif((v - 1) / 1000, 0), 6)", lambda v: F.round(sc.dots_per_inch((v - 1) / 1000), 6))
_scalar("sf17_layer_text", "printf('Depth = %f mm', v)", lambda v: sc.layer_text(v))
_scalar("sf18_layer_depth", "[0.0::DOUBLE, 4.5, 3.0, 2.5, 1.0][t]", lambda v: sc.layer_depth(F.col("t") - 1, F.array(*(F.lit(x) for x in (1.0, 2.5, 3.0, 4.5)))))
_scalar("top05_layers_from_the_deepest", "[4.5::DOUBLE, 3.0, 2.5, 1.0][t]", lambda v: sc.layer_depth(F.col("t").cast("int"), F.array(*(F.lit(x) for x in (1.0, 2.5, 3.0, 4.5)))))
_scalar("sf33_ortho_matrix", "array_to_string([round(1 / v, 6) + 0.0, 0.0, round(-ix / v, 6) + 0.0, 0.0, 2.0, round(-2.0 * iy, 6) + 0.0], ',')", lambda v: F.array_join(F.transform(sc.orthographic_matrix(v, F.col("ix"), F.lit(0.5), F.col("iy")), lambda x: (F.round(x, 6) + 0.0).cast("string")), ","))
_scalar("vec20_raised_cosine", f"round(CASE WHEN v * 0.2 * {0.4 * math.pi / math.sqrt(2)!r}::DOUBLE > pi() THEN 0 ELSE 0.5 + 0.5 * cos(v * 0.2 * {0.4 * math.pi / math.sqrt(2)!r}::DOUBLE) END, 6)", lambda v: F.round(sc.raised_cosine(v * 0.2), 6))
A, B = "ix - 15.5", "iy - 15.5"
COS = f"least(1.0::DOUBLE, abs(({A}) * 0.6 + v * 0.8) / sqrt(({A}) * ({A}) + ({B}) * ({B}) + v * v))"
_scalar("vec14_incidence_weight", f"round(CASE WHEN acos({COS}) > {math.radians(67.5)!r}::DOUBLE THEN 0 ELSE cos(acos({COS}) * 4 / 3) END, 5) + 0.0", lambda v: F.round(sc.incidence_weight(vec.unit((F.col("ix") - 15.5, F.col("iy") - 15.5, v)), (F.lit(0.6), F.lit(0.0), F.lit(0.8)))[1], 5) + 0.0)


@query("sf30_slice", f"WITH {fx.PIXELS_SQL} SELECT shot, ((ix - 2) // 3)::INTEGER AS ix, iy - 2 AS iy, t, v FROM pixels WHERE ix BETWEEN 2 AND 28 AND (ix - 2) % 3 = 0 AND iy >= 2")
def sliced(spark, d):
    """Every third column from 2 to 29 (the rest of a step left out), and the last 30 rows by bounds that count from the end and go beyond it."""
    x, nx, _ = sc.slice_axis(F.col("ix"), 32, 2, -2, 3)
    y, ny, _ = sc.slice_axis(F.col("iy"), 32, -30, 99)
    return fx.pixels(spark, d).where(x & y).select("shot", nx.alias("ix"), ny.alias("iy"), "t", "v")


@query("join13_bilinear_resample", f"""WITH {fx.PIXELS_SQL}, {FUSED}, f AS (SELECT ix, iy, t, v FROM fused), o AS (SELECT DISTINCT t, (i % 32)::INTEGER AS ox, (i // 32)::INTEGER AS oy FROM f, range(1024) g(i)),
s AS (SELECT t, ox, oy, 15.5 + (ox - 15.5) * (1 + 0.02 * ((ox - 15.5) / 16) * ((ox - 15.5) / 16) + 0.02 * ((oy - 15.5) / 16) * ((oy - 15.5) / 16)) AS sx, 15.5 + (oy - 15.5) * (1 + 0.02 * ((ox - 15.5) / 16) * ((ox - 15.5) / 16) + 0.02 * ((oy - 15.5) / 16) * ((oy - 15.5) / 16)) AS sy FROM o),
k AS (SELECT t, ox, oy, floor(sx)::INTEGER + dx AS ix, floor(sy)::INTEGER + dy AS iy, CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS c FROM s, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) z(dx, dy))
SELECT k.t, ox, oy, round(sum(c * v), 6) + 0.0 AS v, count(*) AS taps FROM k JOIN f USING (ix, iy, t) GROUP BY k.t, ox, oy""")
def resample(spark, d):
    """Lens undistortion: each output pixel's four source taps, joined to the frame by cell."""
    f = op.fuse(fx.pixels(spark, d)).select("ix", "iy", "t", "v")
    n = spark.range(1024).select((F.col("id") % 32).cast("int").alias("ox"), F.expr("cast(id div 32 as int)").alias("oy"))
    x, y = (F.col("ox") - 15.5) / 16, (F.col("oy") - 15.5) / 16
    bend = 1 + 0.02 * x * x + 0.02 * y * y
    n = n.withColumns({"sx": 15.5 + (F.col("ox") - 15.5) * bend, "sy": 15.5 + (F.col("oy") - 15.5) * bend})
    fx_, fy_ = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    tap = lambda dx, dy: F.struct((F.floor("sx") + dx).cast("int").alias("ix"), (F.floor("sy") + dy).cast("int").alias("iy"), ((fx_ if dx else 1 - fx_) * (fy_ if dy else 1 - fy_)).alias("c"))
    taps = n.select("ox", "oy", F.explode(F.array(*(tap(a, b) for a in (0, 1) for b in (0, 1)))).alias("p")).select("ox", "oy", "p.*")
    return f.join(F.broadcast(taps), ["ix", "iy"]).groupBy("t", "ox", "oy").agg(R(F.sum(F.col("c") * F.col("v"))).alias("v"), F.count("*").alias("taps"))


@query("win08_sample_time", f"WITH {fx.WAVES_SQL} SELECT wf, i, round(5.0 + (i - 1) * 0.25, 6) AS at FROM waves")
def sample_time(spark, d):
    return fx.waves(spark, d).select("wf", "i", R(5.0 + (F.col("i") - 1) * 0.25).alias("at"))


#: The analytic signal in SQL: the imaginary part is a circular convolution with the transform's kernel.
ANALYTIC = f"wn AS (SELECT wf, count(*) AS n FROM waves GROUP BY wf), z AS (SELECT a.wf, a.i, any_value(a.t) AS t, any_value(a.v) AS re, sum(b.v * (CASE WHEN a.i = b.i THEN 0 WHEN n % 2 = 0 THEN CASE WHEN abs(a.i - b.i) % 2 = 1 THEN 2.0::DOUBLE / n / tan(pi() * (a.i - b.i) / n) ELSE 0 END ELSE (1 / tan(pi() * (a.i - b.i) / n) - cos(pi() * (a.i - b.i)) / sin(pi() * (a.i - b.i) / n)) / n END)) AS im FROM waves a JOIN waves b USING (wf) JOIN wn USING (wf) GROUP BY a.wf, a.i)"
FACE = "f AS (SELECT wf, i, t, (wf % 16 + q % 3 - 1)::INTEGER AS iu, (wf // 16 % 16 + q // 3 - 1)::INTEGER AS iv, re, im, exp(-((q % 3 - 1) * (q % 3 - 1) + (q // 3 - 1) * (q // 3 - 1)) / 1.0::DOUBLE) AS w FROM z, range(9) g(q)), s AS (SELECT iu, iv, i, sum(w * re) AS re, sum(w * im) AS im, sum(w) AS w FROM f GROUP BY ALL)"


def _analytic(spark, d):
    return wv.analytic(fx.waves(spark, d))


def _stack(spark, d):
    """Each waveform on a 3 x 3 transducer face at a place of its own, all of them summed by cell and sample."""
    z = _analytic(spark, d).select("wf", "i", (F.col("wf") % 16).alias("cu"), F.expr("wf div 16 % 16").alias("cv"), "re", "im")
    return wv.accumulate_contacts(wv.on_face(z, 3, 3.0))


@query("agg23_analytic", f"WITH {fx.WAVES_SQL}, {ANALYTIC} SELECT wf, i, round(re, 6) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM z")
def analytic(spark, d):
    return _analytic(spark, d).select("wf", "i", R("re").alias("re"), R("im", 5).alias("im"))


@query("agg26_contact_stack", f"WITH {fx.WAVES_SQL}, {ANALYTIC}, {FACE} SELECT iu, iv, i, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, round(w, 6) AS validity FROM s")
def contact_stack(spark, d):
    return _stack(spark, d).select("iu", "iv", "i", R("re", 4).alias("re"), R("im", 4).alias("im"), R("validity").alias("validity"))


@query("agg24_envelope", f"WITH {fx.WAVES_SQL}, {ANALYTIC}, {FACE} SELECT iu, iv, i, round(sqrt(re * re + im * im) / w, 4) AS env FROM s")
def envelope(spark, d):
    return wv.envelope(_stack(spark, d)).select("iu", "iv", "i", R("env", 4).alias("env"))


@query("agg25_cscan_gate", f"WITH {fx.WAVES_SQL}, {ANALYTIC}, {FACE} SELECT iu, iv, round(max(sqrt(re * re + im * im) / w), 4) AS peak, count(*) AS n FROM s WHERE 0.5::DOUBLE + (i - 1) * 0.25::DOUBLE BETWEEN 2 AND 12.5 GROUP BY ALL")
def cscan(spark, d):
    """Samples stand a quarter second apart, from half a second on."""
    e = wv.envelope(_stack(spark, d)).withColumn("at", 0.5 + (F.col("i") - 1) * 0.25)
    return wv.gate_peak(e, 2.0, 12.5, "iu", "iv").select("iu", "iv", R("peak", 4).alias("peak"), "n")


@query("join21_reference_waveform", f"WITH {fx.WAVES_SQL}, r AS (SELECT i, v AS v0 FROM waves WHERE wf = (SELECT min(wf) FROM waves)) SELECT wf, count(*) AS n, round(sum(v * v0), 4) AS dot FROM waves JOIN r USING (i) GROUP BY wf")
def reference(spark, d):
    w = fx.waves(spark, d)
    first = w.agg(F.min("wf").alias("wf"))
    r = w.join(F.broadcast(first), "wf").select("i", F.col("v").alias("v0"))
    return w.join(r, "i").groupBy("wf").agg(F.count("*").alias("n"), R(F.sum(F.col("v") * F.col("v0")), 4).alias("dot"))


@query("agg23_gate_energy", f"WITH {fx.WAVES_SQL}, {ANALYTIC}, e AS (SELECT wf, sum(re * re + im * im) FILTER (i BETWEEN 5 AND 50) AS e FROM z GROUP BY wf), r AS (SELECT e AS e0 FROM e WHERE wf = (SELECT min(wf) FROM waves)), c AS (SELECT wf, 1 - e / e0 AS c FROM e, r) SELECT wf, round(c, 5) + 0.0 AS c, round(CASE WHEN c < 0.1 THEN 0 WHEN c < 0.4 THEN c * c / 0.4 ELSE c END, 5) + 0.0 AS validity FROM c")
def gate_energy(spark, d):
    """The waveform of the smallest user is the one without contact."""
    z = _analytic(spark, d)
    none = z.agg(F.min("wf").alias("wf"))
    return wv.contact_weight(z, z.join(F.broadcast(none), "wf"), 5, 50).select("wf", R("c", 5).alias("c"), R("validity", 5).alias("validity"))


@query("sf32_face_validity", f"WITH {fx.WAVES_SQL} SELECT wf, i, (q % 3)::INTEGER AS fx, (q // 3)::INTEGER AS fy, round(v * exp(-((q % 3 - 1) * (q % 3 - 1) + (q // 3 - 1) * (q // 3 - 1)) / 0.444), 6) + 0.0 AS v FROM waves, range(9) g(q)")
def face(spark, d):
    """A waveform spread over a 3 x 3 face with Gaussian validity; the face is a constant, so nothing but waveforms is dealt out."""
    w = fx.waves(spark, d).withColumn("q", F.explode(F.array(*[F.lit(i) for i in range(9)])))
    x, y = F.col("q") % 3, F.expr("q div 3")
    return w.select("wf", "i", x.cast("int").alias("fx"), y.cast("int").alias("fy"), R(F.col("v") * F.exp(-((x - 1) * (x - 1) + (y - 1) * (y - 1)) / 0.444)).alias("v"))


@query("top03_ranked_samples", f"WITH {fx.WAVES_SQL} SELECT wf, i, v FROM waves QUALIFY row_number() OVER (PARTITION BY wf ORDER BY v DESC, i) <= 3")
def ranked(spark, d):
    w = Window.partitionBy("wf").orderBy(F.desc("v"), "i")
    return fx.waves(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("wf", "i", "v")


def _diffusion_sql(steps: int, dt: float, rx: float, ry: float) -> str:
    """The steps one after another; outside reads as the edge itself."""
    w = "WINDOW r AS (PARTITION BY shot, t, iy ORDER BY ix), c AS (PARTITION BY shot, t, ix ORDER BY iy)"
    out = [f"{GRID}, q0 AS (SELECT shot, t, ix, iy, v AS upper, 25.0::DOUBLE AS v FROM g)"]
    for k in range(steps):
        out.append(f"c{k} AS MATERIALIZED (SELECT shot, t, ix, iy, upper, least(v, upper) AS v FROM q{k})")
        out.append(f"q{k + 1} AS MATERIALIZED (SELECT shot, t, ix, iy, upper, v + {dt!r}::DOUBLE * ((coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) - 2 * v) * {rx!r}::DOUBLE + (coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 2 * v) * {ry!r}::DOUBLE) AS v FROM c{k} {w})")
    return ", ".join(out) + f" SELECT shot, t, ix, iy, round(v, 5) + 0.0 AS v FROM q{steps}"


@query("win05_diffusion", _diffusion_sql(*diffusion_steps(3.0, 2.0)))
def diffusion(spark, d):
    """Weights of 25 held under each frame's values, blurred over 3 pixels along rows and 2 along columns, in tiles."""
    g = op.dense(fx.pixels(spark, d).groupBy(*FRAME, "ix", "iy").agg(F.max("v").alias("v")), 32, 32, frame=FRAME)
    g = g.select(*FRAME, "ix", "iy", F.col("v").alias("upper"), F.lit(25.0).alias("v"))
    return diffuse(g, 32, 32, 3.0, 2.0, tile=16, frame=FRAME).select(*FRAME, "ix", "iy", R("v", 5).alias("v"))
