"""Stencil, resampling, registration and structural-similarity queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql, integer_sql
from stratavox.catalogue.registry import query
from stratavox.functions import kernels
from stratavox.operators import metrics, pairing, planes, register, resample, wavelet
from stratavox.operators.layout import slices_to_voxels

V = "WITH " + fx.VOXELS_SQL
E = "WITH " + fx.EVENTS_SQL
KEY = "volume_id, z, x, y"


def _vox(slices):
    return slices_to_voxels(slices).withColumn("v", F.round("v", 6) + 0.0)


def border_sql(i: str, n: int, mode: str) -> str:
    if mode == "replicate":
        return f"greatest(0, least({n - 1}, {i}))"
    if mode == "wrap":
        return f"((({i}) % {n}) + {n}) % {n}"
    period = 2 * (n - 1) if mode in ("mirror", "reflect") else 2 * n
    j = f"(((({i}) % {period}) + {period}) % {period})"
    return f"CASE WHEN {j} < {n} THEN {j} ELSE {2 * (n - 1) if mode in ('mirror', 'reflect') else 2 * n - 1} - {j} END"


def conv_sql(kernel: str, size: int, border: str, n: int = 8, flip: bool = True, source: str = "voxels", name: str = "conv") -> str:
    """CTE of a stencil; ``kernel`` has columns ky, kx, w."""
    c = size // 2 if flip else (size - 1) // 2
    sx = f"o.x - (ky - {c})" if flip else f"o.x + (ky - {c})"
    sy = f"o.y - (kx - {c})" if flip else f"o.y + (kx - {c})"
    return f"""{name}_at AS (SELECT o.x, o.y, {border_sql(sx, n, border)} AS sx, {border_sql(sy, n, border)} AS sy, w FROM (SELECT a.range AS x, b.range AS y FROM range(0,{n}) a, range(0,{n}) b) o, {kernel}),
{name} AS (SELECT s.volume_id, s.z, CAST(a.x AS INT) AS x, CAST(a.y AS INT) AS y, sum(a.w*s.v) AS v FROM {name}_at a JOIN {source} s ON s.x=a.sx AND s.y=a.sy GROUP BY ALL)"""


def unit_kernel(name: str, size: int, expr: str) -> str:
    """CTE of a normalised kernel given by an expression in ky, kx."""
    return f"""{name}_raw AS (SELECT ky, kx, {expr} AS w FROM (SELECT a.range AS ky, b.range AS kx FROM range(0,{size}) a, range(0,{size}) b)),
{name} AS (SELECT ky, kx, w/sum(w) OVER () AS w FROM {name}_raw)"""


def table_kernel(name: str, k: np.ndarray) -> str:
    """CTE of a literal kernel."""
    rows = ", ".join(f"({y},{x},CAST({float(w)!r} AS DOUBLE))" for (y, x), w in np.ndenumerate(k))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(ky, kx, w))"


DONE = "SELECT volume_id, z, x, y, round(v,6) + 0.0 AS v FROM {t}"

# An asymmetric test kernel.
SKEW = np.array([[0.1, 0.2, 0.05], [0.0, 0.3, 0.15], [0.05, 0.1, 0.05]])

for _mode in ("wrap", "mirror", "replicate"):

    def _convolve(spark, sf, mode=_mode):
        return _vox(planes.convolve(fx.slices(spark, sf), SKEW, mode))

    query(f"r16_convolve_{_mode}", f"{V}, {table_kernel('k', SKEW)}, {conv_sql('k', 3, _mode)} {DONE.format(t='conv')}")(_convolve)


@query("r16_blur", f"{V}, {table_kernel('k', SKEW)}, {conv_sql('k', 3, 'replicate', flip=False)} {DONE.format(t='conv')}")
def r16_blur(spark, sf):
    return _vox(planes.blur(fx.slices(spark, sf), SKEW))


ISO = unit_kernel("iso", 5, "exp(-((ky-2)*(ky-2)+(kx-2)*(kx-2))/(2*1.3*1.3::DOUBLE))")


@query("r17_isotropic", f"{V}, {ISO}, {conv_sql('iso', 5, 'mirror')} {DONE.format(t='conv')}")
def r17_isotropic(spark, sf):
    return _vox(planes.convolve(fx.slices(spark, sf), kernels.kernel_table("isotropic", size=5, sigma=1.3), "mirror"))


def _turned(dx: str, dy: str, angle: float, e1: float, e2: float) -> str:
    c, s = f"cos({angle!r}::DOUBLE)", f"sin({angle!r}::DOUBLE)"
    along, across = f"(({dx})*{c}+({dy})*{s})", f"(({dx})*{s}-({dy})*{c})"
    return f"exp(-0.5*({along}*{along}/{e1!r}+{across}*{across}/{e2!r}))"


@query(
    "r17_anisotropic",
    f"{V}, {unit_kernel('k', 5, _turned('kx-2.5+0.5', 'ky-2.5+0.5', 0.7, 3.0, 0.8))}, {conv_sql('k', 5, 'mirror')} {DONE.format(t='conv')}",
)
def r17_anisotropic(spark, sf):
    k = kernels.kernel_table("anisotropic", size=5, theta=0.7, l1=3.0, l2=0.8)
    return _vox(planes.convolve(fx.slices(spark, sf), k, "mirror"))


@query(
    "r17_random_shape",
    f"{V}, {unit_kernel('k', 5, _turned('kx-1.5', 'ky-1.5', 0.3 * np.pi, 0.6 + 0.2 * 9.4, 0.6 + 0.7 * 9.4))}, {conv_sql('k', 5, 'mirror')} {DONE.format(t='conv')}",
)
def r17_random_shape(spark, sf):
    """Drawn eigenvalues and angle for scale 2, given as uniform numbers."""
    k = kernels.kernel_table("random", size=5, scale=2, u=(0.2, 0.7, 0.3))
    return _vox(planes.convolve(fx.slices(spark, sf), k, "mirror"))


@query(
    "r17_laplacian",
    f"""{V}, k AS (SELECT ky, kx, CASE WHEN ky=1 AND kx=1 THEN -4/1.2::DOUBLE WHEN ky=1 OR kx=1 THEN 0.8/1.2::DOUBLE ELSE 0.2/1.2::DOUBLE END AS w FROM (SELECT a.range AS ky, b.range AS kx FROM range(0,3) a, range(0,3) b)),
{conv_sql('k', 3, 'mirror')} {DONE.format(t='conv')}""",
)
def r17_laplacian(spark, sf):
    return _vox(planes.convolve(fx.slices(spark, sf), kernels.kernel_table("laplacian", alpha=0.2), "mirror"))


@query(
    "r17_double_scale",
    f"""{V}, {unit_kernel('b', 3, 'exp(-((ky-1)*(ky-1)+(kx-1)*(kx-1))/(2*0.8*0.8::DOUBLE))')},
big AS (SELECT 2*p.ky+q.ky-1 AS ky, 2*p.kx+q.kx-1 AS kx, sum(p.w*q.w) AS w FROM b p, b q GROUP BY ALL),
k AS (SELECT ky, kx, w/sum(w) OVER () AS w FROM big WHERE ky BETWEEN 0 AND 4 AND kx BETWEEN 0 AND 4), {conv_sql('k', 5, 'mirror')} {DONE.format(t='conv')}""",
)
def r17_double_scale(spark, sf):
    k = kernels.kernel_table("double", k=kernels.isotropic_gaussian(3, 0.8))
    return _vox(planes.convolve(fx.slices(spark, sf), k, "mirror"))


SHIFT1 = """u AS (SELECT range AS o, greatest(0, least({n}-1, range+{off})) AS u FROM range(0,{n})),
s1 AS (SELECT o, CAST(floor(u) AS INT) AS i, 1-(u-floor(u)) AS w FROM u UNION ALL SELECT o, least(CAST(floor(u) AS INT)+1, {n}-1), u-floor(u) FROM u),
sw AS (SELECT o, i, sum(w) AS w FROM s1 GROUP BY ALL)"""


@query(
    "r17_shifted",
    f"""{V}, {ISO}, {SHIFT1.format(n=5, off=1.5)}, m AS (SELECT a.o AS ky, b.o AS kx, sum(a.w*b.w*iso.w) AS w FROM iso JOIN sw a ON a.i=iso.ky JOIN sw b ON b.i=iso.kx GROUP BY ALL),
k AS (SELECT ky, kx, w/sum(w) OVER () AS w FROM m), {conv_sql('k', 5, 'mirror')} {DONE.format(t='conv')}""",
)
def r17_shifted(spark, sf):
    k = kernels.kernel_table("shifted", k=kernels.isotropic_gaussian(5, 1.3), scale=4)
    return _vox(planes.convolve(fx.slices(spark, sf), k, "mirror"))


def apply_sql(rows: str, cols: str, source: str = "voxels", name: str = "res") -> str:
    """CTE that applies weight tables (o, i, w) to both plane axes."""
    return f"""{name} AS (SELECT s.volume_id, s.z, CAST(a.o AS INT) AS x, CAST(b.o AS INT) AS y, sum(a.w*b.w*s.v) AS v FROM {source} s JOIN {rows} a ON a.i=s.x JOIN {cols} b ON b.i=s.y GROUP BY ALL)"""


def linear_sql(name: str, n: int, m: int) -> str:
    u = f"greatest((range+0.5)*{n}/{m}::DOUBLE-0.5, 0)"
    return f"""{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT range AS o, CAST(floor({u}) AS INT) AS i, 1-({u}-floor({u})) AS w FROM range(0,{m})
UNION ALL SELECT range, least(CAST(floor({u}) AS INT)+1, {n - 1}), {u}-floor({u}) FROM range(0,{m})) GROUP BY ALL)"""


CUBIC = "CASE WHEN abs({t}) <= 1 THEN ({a}+2)*power(abs({t}),3)-({a}+3)*power(abs({t}),2)+1 WHEN abs({t}) < 2 THEN {a}*power(abs({t}),3)-5*{a}*power(abs({t}),2)+8*{a}*abs({t})-4*{a} ELSE 0 END"


def cubic_sql(name: str, n: int, m: int, corners: bool = False) -> str:
    u = f"(range*{n - 1}/{m - 1}::DOUBLE)" if corners else f"((range+0.5)*{n}/{m}::DOUBLE-0.5)"
    return f"""{name}_t AS (SELECT range AS o, {u} AS u, CAST(floor({u}) AS INT)+k AS tap FROM range(0,{m}), (SELECT unnest([-1,0,1,2]) AS k)),
{name} AS (SELECT o, greatest(0, least({n - 1}, tap)) AS i, sum({CUBIC.format(t="(u-tap)", a="(-0.75)")}) AS w FROM {name}_t GROUP BY ALL)"""


def matlab_sql(name: str, n: int, scale: float) -> str:
    m = int(np.ceil(n * scale))
    s = min(scale, 1.0)
    u = f"((range+1)/{scale!r}::DOUBLE+0.5*(1-1/{scale!r}::DOUBLE))"
    width = 4 / s
    return f"""{name}_t AS (SELECT range AS o, {u} AS u, CAST(floor({u}-{width / 2!r}::DOUBLE) AS INT)+k AS tap FROM range(0,{m}), (SELECT unnest(range(0,{int(np.ceil(width)) + 2})) AS k)),
{name}_w AS (SELECT o, CASE WHEN tap < 1 THEN 1-tap WHEN tap > {n} THEN {2 * n + 1}-tap ELSE tap END - 1 AS i, {CUBIC.format(t=f"({s!r}::DOUBLE*(u-tap))", a="(-0.5)")} AS w FROM {name}_t),
{name} AS (SELECT o, i, sum(w)/(SELECT sum(w) FROM {name}_w p WHERE p.o=q.o) AS w FROM {name}_w q GROUP BY o, i)"""


@query("r18_shift_pixel", f"{V}, {SHIFT1.format(n=8, off=0.5)}, {apply_sql('sw', 'sw')} {DONE.format(t='res')}")
def r18_shift_pixel(spark, sf):
    return _vox(planes.shift_pixel(fx.slices(spark, sf), 2))


@query("r14_blur_downsample", f"{V}, k AS (SELECT a.range AS ky, b.range AS kx, ([1,2,1])[a.range+1]*([1,2,1])[b.range+1]/16.0::DOUBLE AS w FROM range(0,3) a, range(0,3) b), {conv_sql('k', 3, 'reflect', flip=False)} SELECT volume_id, z, x//2 AS x, y//2 AS y, round(v,6) + 0.0 AS v FROM conv WHERE x%2=0 AND y%2=0")
def r14_blur_downsample(spark, sf):
    return _vox(planes.blur_downsample(fx.slices(spark, sf), 3, "reflect", 2))


@query("r14_blur_downsample_even", f"{V}, k AS (SELECT a.range AS ky, b.range AS kx, ([1,3,3,1])[a.range+1]*([1,3,3,1])[b.range+1]/64.0::DOUBLE AS w FROM range(0,4) a, range(0,4) b), {conv_sql('k', 4, 'replicate', flip=False)} SELECT volume_id, z, x//2 AS x, y//2 AS y, round(v,6) + 0.0 AS v FROM conv WHERE x%2=0 AND y%2=0")
def r14_blur_downsample_even(spark, sf):
    return _vox(planes.blur_downsample(fx.slices(spark, sf), 4, "replicate", 2))


PADS = {"reflect": "reflect", "replicate": "replicate", "symmetric": "symmetric", "zero": "zero"}


def _pad_sql(mode: str) -> str:
    grid = "p AS (SELECT CAST(range AS INT) AS o, {b} AS i FROM range(-3, 11))"
    if mode == "zero":
        return f"""{V}, {grid.format(b="range")} SELECT t.volume_id, t.z, a.o+3 AS x, b.o+3 AS y, round(coalesce(s.v,0),6) + 0.0 AS v FROM (SELECT DISTINCT volume_id, z FROM stack) t, p a JOIN p b ON true
LEFT JOIN voxels s ON s.volume_id=t.volume_id AND s.z=t.z AND s.x=a.i AND s.y=b.i"""
    return f"""{V}, {grid.format(b=border_sql("range", 8, mode))} SELECT volume_id, z, a.o+3 AS x, b.o+3 AS y, round(v,6) + 0.0 AS v FROM voxels s JOIN p a ON a.i=s.x JOIN p b ON b.i=s.y"""


for _mode in PADS:

    def _pad(spark, sf, mode=_mode):
        return _vox(planes.pad(fx.slices(spark, sf), 3, mode))

    query(f"t21_pad_{_mode}", _pad_sql(_mode))(_pad)


def zlinear_sql(m: str) -> str:
    return f"""n AS (SELECT volume_id, max(z)+1 AS nz FROM stack GROUP BY volume_id),
u AS (SELECT volume_id, nz, o, greatest((o+0.5)*nz/({m})::DOUBLE-0.5, 0) AS u FROM (SELECT volume_id, nz, CAST(unnest(range(0, CAST({m} AS INT))) AS INT) AS o FROM n)),
zw AS (SELECT volume_id, o, least(CAST(floor(u) AS INT), nz-1) AS i, 1-(u-floor(u)) AS w FROM u UNION ALL SELECT volume_id, o, least(CAST(floor(u) AS INT)+1, nz-1), u-floor(u) FROM u),
rz AS (SELECT s.volume_id, o AS z, x, y, sum(w*v) AS v FROM voxels s JOIN zw ON zw.volume_id=s.volume_id AND zw.i=s.z GROUP BY ALL)"""


@query("r1_resample_z", f"{V}, {zlinear_sql('nz*8')} {DONE.format(t='rz')}")
def r1_resample_z(spark, sf):
    """Eightfold in z only."""
    return _vox(resample.resample(fx.slices(spark, sf), scale=(8, 1, 1)))


@query("r1_resample_xyz", f"{V}, {zlinear_sql('floor(nz*0.5)')}, {linear_sql('wx', 8, 12)}, {linear_sql('wy', 8, 6)}, {apply_sql('wx', 'wy', 'rz')} {DONE.format(t='res')}")
def r1_resample_xyz(spark, sf):
    return _vox(resample.resample(fx.slices(spark, sf), scale=(0.5, 1.5, 0.75)))


@query("r1_resample_size_cast", f"{V}, {linear_sql('wx', 8, 5)}, i AS (SELECT volume_id, z, x, y, trunc(v*1000) AS v FROM voxels), {apply_sql('wx', 'wx', 'i')} SELECT volume_id, z, x, y, CAST(trunc(round(v,9)) AS INT) AS v FROM res")
def r1_resample_size_cast(spark, sf):
    """z kept by -1; integer volume, truncated back to integers."""
    whole = fx.slices(spark, sf).withColumn("data", F.transform("data", lambda v: (v * 1000).cast("int").cast("double")))
    out = resample.resample(whole, size=(-1, 5, 5))
    exact = out.withColumn("data", F.transform("data", lambda v: F.round(v, 9).cast("int")))
    return slices_to_voxels(exact)


@query("r2_upsample_to_cube", f"{V}, {zlinear_sql('12')}, {linear_sql('wx', 8, 12)}, {apply_sql('wx', 'wx', 'rz')} {DONE.format(t='res')}")
def r2_upsample_to_cube(spark, sf):
    return _vox(resample.upsample_to_cube(fx.slices(spark, sf), 12))


@query("r3_resize_bicubic_aa", f"{V}, {matlab_sql('w', 8, 0.5)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r3_resize_bicubic_aa(spark, sf):
    return _vox(planes.resize_bicubic_aa(fx.slices(spark, sf), 0.5))


@query("r3_resize_bicubic_up", f"{V}, {matlab_sql('w', 8, 1.5)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r3_resize_bicubic_up(spark, sf):
    return _vox(planes.resize_bicubic_aa(fx.slices(spark, sf), 1.5))


@query("r4_resize_nearest_labels", f"{V}, a AS (SELECT range AS o, range*8//5 AS i FROM range(0,5)), b AS (SELECT range AS o, range*8//11 AS i FROM range(0,11)) SELECT volume_id, z, CAST(a.o AS INT) AS x, CAST(b.o AS INT) AS y, round(v,6) + 0.0 AS v FROM voxels JOIN a ON a.i=x JOIN b ON b.i=y")
def r4_resize_nearest_labels(spark, sf):
    return _vox(planes.resize_nearest_labels(fx.slices(spark, sf), (5, 11)))


@query("r5_resize_bicubic_corners", f"{V}, {cubic_sql('w', 8, 12, True)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r5_resize_bicubic_corners(spark, sf):
    return _vox(planes.resize(fx.slices(spark, sf), "cubic", (12, 12), align_corners=True))


@query("r5_resize_bicubic", f"{V}, {cubic_sql('w', 8, 11)}, {cubic_sql('w2', 8, 6)}, {apply_sql('w', 'w2')} {DONE.format(t='res')}")
def r5_resize_bicubic(spark, sf):
    return _vox(planes.resize(fx.slices(spark, sf), "cubic", (11, 6)))


@query("r6_resize_stages", f"{V}, {linear_sql('w8', 8, 4)}, {linear_sql('w4', 4, 2)}, {apply_sql('w8', 'w8', name='first')}, {apply_sql('w4', 'w4', 'first')} {DONE.format(t='res')}")
def r6_resize_stages(spark, sf):
    return _vox(planes.resize_stages(fx.slices(spark, sf), "linear", 0.5, 2))


@query(
    "r6_resize_and_stack",
    f"{V}, low AS (SELECT volume_id, z, x//2 AS x, y//2 AS y, v FROM voxels WHERE x%2=0 AND y%2=0), {linear_sql('w', 4, 8)}, {apply_sql('w', 'w', 'low', name='up')} SELECT volume_id, z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(f.v,6) + 0.0 AS first, round(u.v,6) + 0.0 AS second FROM voxels f JOIN up u USING (volume_id, z, x, y)",
)
def r6_resize_and_stack(spark, sf):
    """Every second pixel as the image of low resolution, brought back to full size beside the original."""
    slices = fx.slices(spark, sf)
    low = planes.map_planes(slices, lambda b: b[:, ::2, ::2])
    cells = planes.resize_and_stack(slices, low).select("volume_id", "z", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.slice("data", 2 * i + 1, 2))).alias("i", "p"))
    value = lambda k: F.round(F.col("p")[k], 6) + 0.0
    return cells.select("volume_id", "z", F.expr("CAST(i DIV w AS INT)").alias("x"), F.expr("CAST(i % w AS INT)").alias("y"), value(0).alias("first"), value(1).alias("second"))


@query("r6_resize_area", f"{V}, w AS (SELECT a.range AS o, b.range AS i, 1.0::DOUBLE/(-(-((a.range+1)*8)//5) - a.range*8//5 + CASE WHEN ((a.range+1)*8)%5 > 0 THEN 1 ELSE 0 END) AS w FROM range(0,5) a, range(0,8) b WHERE b.range >= a.range*8//5 AND b.range*5 < (a.range+1)*8), {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r6_resize_area(spark, sf):
    return _vox(planes.resize(fx.slices(spark, sf), "area", (5, 5)))


@query("r6_resize_rounded", f"{V}, {linear_sql('w', 8, 6)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r6_resize_rounded(spark, sf):
    """round(8 * 0.7) = 6 cells per side."""
    return _vox(planes.resize_rounded(fx.slices(spark, sf), "linear", 0.7))


@query("r22_resize_square", f"{V}, {linear_sql('w', 8, 13)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def r22_resize_square(spark, sf):
    return _vox(planes.resize_square(fx.slices(spark, sf), 13))


@query(
    "r23_resize_short_side",
    f"WITH {fx.STACK_SQL}, wide AS (SELECT volume_id, z, CAST((i-1)//16 AS INT) AS x, CAST((i-1)%16 AS INT) AS y, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT volume_id, z, embedding, unnest(range(1,65)) AS i FROM stack)), {cubic_sql('w', 4, 6)}, {cubic_sql('w2', 16, 24)}, {apply_sql('w', 'w2', 'wide')} {DONE.format(t='res')}",
)
def r23_resize_short_side(spark, sf):
    """The vectors as 4 x 16 images; the short side becomes 6."""
    wide = fx.slices(spark, sf).withColumns({"h": F.lit(4), "w": F.lit(16)})
    return _vox(planes.resize_short_side(wide, 6))


@query(
    "r24_batch_resize",
    f"""{V}, b AS (SELECT volume_id, CASE WHEN volume_id <= 4 THEN 48 ELSE {integer_sql(17, "batchsize", "0", "3", "volume_id")}*16+16 END AS m FROM (SELECT DISTINCT volume_id FROM stack)),
t AS (SELECT m, o, (o+0.5)*8/m::DOUBLE-0.5 AS u, CAST(floor((o+0.5)*8/m::DOUBLE-0.5) AS INT)+k AS tap FROM (SELECT DISTINCT m, unnest(range(0,m)) AS o FROM b), (SELECT unnest([-1,0,1,2]) AS k)),
w AS (SELECT m, o, greatest(0, least(7, tap)) AS i, sum({CUBIC.format(t="(u-tap)", a="(-0.75)")}) AS w FROM t GROUP BY ALL),
r AS (SELECT s.volume_id, s.z, b.m, a.o AS x, c.o AS y, sum(a.w*c.w*s.v) AS v FROM voxels s JOIN b USING (volume_id) JOIN w a ON a.m=b.m AND a.i=s.x JOIN w c ON c.m=b.m AND c.i=s.y GROUP BY ALL)
SELECT volume_id, z, CAST(m AS INT) AS h, CAST(m AS INT) AS w, CAST(count(*)*3 AS INT) AS n, round(sum(v*(x+1))*3,6) + 0.0 AS checksum FROM r GROUP BY ALL""",
)
def r24_batch_resize(spark, sf):
    """One size per batch (here a volume); three equal channels."""
    out = planes.batch_resize(fx.slices(spark, sf), F.col("volume_id"), 16, 48, seed=17)
    cells = out.select("volume_id", "z", "h", "w", F.posexplode("data").alias("i", "v"))
    row = F.floor(F.col("i") / (F.col("w") * 3)) + 1
    return cells.groupBy("volume_id", "z", "h", "w").agg(
        F.count(F.lit(1)).cast("int").alias("n"), (F.round(F.sum(F.col("v") * row), 6) + 0.0).alias("checksum")
    )


def _pyramid_sql() -> str:
    parts, selects = [], []
    for level in (1, 2, 3, 6):
        k = 24 // level
        parts.append(f"pool{level} AS (SELECT volume_id, z, x//{k} AS x, y//{k} AS y, avg(v) AS v FROM event_voxels GROUP BY ALL)")
        parts.append(linear_sql(f"w{level}", level, 24))
        parts.append(apply_sql(f"w{level}", f"w{level}", f"pool{level}", f"back{level}"))
        selects.append(f"round(b{level}.v,6) + 0.0 AS p{level}")
    joins = " ".join(f"JOIN back{n} b{n} ON b{n}.volume_id=e.volume_id AND b{n}.z=e.z AND b{n}.x=e.x AND b{n}.y=e.y" for n in (1, 2, 3, 6))
    parts = [p.replace("FROM event_voxels", "FROM ev") for p in parts]
    return f"{E}, ev AS (SELECT volume_id, z, x, y, v*0.7310585786300049 AS v FROM event_voxels), {', '.join(parts)} SELECT e.volume_id, e.z, e.x, e.y, round(e.v,6) + 0.0 AS v, {', '.join(selects)} FROM ev e {joins}"


@query("r12_pyramid_pool", _pyramid_sql())
def r12_pyramid_pool(spark, sf):
    scaled = fx.event_slices(spark, sf).withColumn("data", F.transform("data", lambda v: v * 0.7310585786300049))
    out = planes.pyramid_pool(scaled)
    names = ["data", "p1", "p2", "p3", "p6"]
    cells = out.select("volume_id", "z", "w", F.posexplode(F.arrays_zip(*names)).alias("i", "c"))
    return cells.select(
        "volume_id",
        "z",
        F.expr("CAST(i DIV w AS INT)").alias("x"),
        F.expr("CAST(i % w AS INT)").alias("y"),
        *[(F.round(F.col("c")[n], 6) + 0.0).alias("v" if n == "data" else n) for n in names],
    )


HAAR = ((0.5, 0.5), (0.5, -0.5))


@query(
    "r19_dwt2",
    f"""{V}, m AS (SELECT unnest([0,0,1,1]) AS m, unnest([0,1,0,1]) AS t, unnest([0.5,0.5,0.5,-0.5])::DOUBLE AS w),
l1 AS (SELECT volume_id, z, a.m AS m1, b.m AS m2, x//2 AS x, y//2 AS y, 2*sum(a.w*b.w*v) AS v FROM voxels JOIN m a ON a.t=x%2 JOIN m b ON b.t=y%2 GROUP BY ALL),
l2 AS (SELECT volume_id, z, a.m AS m1, b.m AS m2, x//2 AS x, y//2 AS y, 2*sum(a.w*b.w*v) AS v FROM l1 JOIN m a ON a.t=x%2 JOIN m b ON b.t=y%2 WHERE m1=0 AND m2=0 GROUP BY ALL)
SELECT 1 AS level, volume_id, z, m1, m2, x, y, round(v,6) + 0.0 AS v FROM l1 UNION ALL SELECT 2, volume_id, z, m1, m2, x, y, round(v,6) + 0.0 FROM l2""",
)
def r19_dwt2(spark, sf):
    return _vox(wavelet.dwt2(fx.slices(spark, sf), HAAR, 2))


@query("r20_invdwt2", f"{V} SELECT volume_id, z, x, y, round(v*2,6) + 0.0 AS v FROM voxels")
def r20_invdwt2(spark, sf):
    """Coefficients plus themselves, rebuilt: twice the image."""
    c = wavelet.dwt2(fx.slices(spark, sf), HAAR, 2)
    return _vox(wavelet.invdwt2(wavelet.combine(c, c, "+"), HAAR, 2, (8, 8)))


CORR = """ref AS (SELECT volume_id, x, y, v FROM voxels WHERE z=0),
corr AS (SELECT i.volume_id, i.z, i.x-r.x AS dy, i.y-r.y AS dx, sum(i.v*r.v) AS c FROM voxels i JOIN ref r ON i.volume_id=r.volume_id GROUP BY ALL),
peak AS (SELECT volume_id, z, dy, dx, c FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY c DESC, dy, dx) AS rn FROM corr) WHERE rn=1)"""


@query("a1_slice_shifts", f"{V}, {CORR} SELECT volume_id, z, CAST(dy AS DOUBLE) AS dy, CAST(dx AS DOUBLE) AS dx FROM peak")
def a1_slice_shifts(spark, sf):
    return register.slice_shifts(fx.slices(spark, sf))


MEAN_REF = CORR.replace("SELECT volume_id, x, y, v FROM voxels WHERE z=0", "SELECT volume_id, x, y, avg(v) AS v FROM voxels GROUP BY ALL")


@query("a1_slice_shifts_mean", f"{V}, {MEAN_REF} SELECT volume_id, z, CAST(dy AS DOUBLE) AS dy, CAST(dx AS DOUBLE) AS dx FROM peak")
def a1_slice_shifts_mean(spark, sf):
    return register.slice_shifts(fx.slices(spark, sf), "mean")


FINE = """near AS (SELECT p.volume_id, p.z, p.dy, p.dx, p.c, max(CASE WHEN c.dy=p.dy-1 AND c.dx=p.dx THEN c.c END) AS up, max(CASE WHEN c.dy=p.dy+1 AND c.dx=p.dx THEN c.c END) AS down,
max(CASE WHEN c.dx=p.dx-1 AND c.dy=p.dy THEN c.c END) AS l, max(CASE WHEN c.dx=p.dx+1 AND c.dy=p.dy THEN c.c END) AS r FROM peak p JOIN corr c ON c.volume_id=p.volume_id AND c.z=p.z GROUP BY ALL),
fine AS (SELECT volume_id, z, dy + coalesce(0.5*(up-down)/nullif(up-2*c+down,0),0) AS dy, dx + coalesce(0.5*(l-r)/nullif(l-2*c+r,0),0) AS dx FROM near)"""


@query("a2_subpixel_refine", f"{V}, {CORR}, {FINE} SELECT volume_id, z, round(dy,6) + 0.0 AS dy, round(dx,6) + 0.0 AS dx FROM fine")
def a2_subpixel_refine(spark, sf):
    out = register.slice_shifts(fx.slices(spark, sf), subpixel=True)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("dy", "dx")})


A3_SQL = (
    f"""{V}, {CORR}, {FINE}, spots AS (SELECT f.volume_id, f.z, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, a.range+round(dy,6) AS sx, b.range+round(dx,6) AS sy FROM fine f, range(0,8) a, range(0,8) b),
tap AS (SELECT *, floor(sx)+p AS tx, floor(sy)+q AS ty, CASE p WHEN 0 THEN 1-(sx-floor(sx)) ELSE sx-floor(sx) END * CASE q WHEN 0 THEN 1-(sy-floor(sy)) ELSE sy-floor(sy) END AS w FROM spots, (SELECT unnest([0,0,1,1]) AS p, unnest([0,1,0,1]) AS q))
SELECT t.volume_id, t.z, t.x, t.y, round(CASE WHEN bool_and(sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7) THEN sum(w*coalesce(s.v,0)) ELSE -1 END,6) + 0.0 AS v FROM tap t LEFT JOIN voxels s ON s.volume_id=t.volume_id AND s.z=t.z AND s.x=t.tx AND s.y=t.ty GROUP BY ALL"""
)


@query("a3_apply_shift", A3_SQL)
def a3_apply_shift(spark, sf):
    """Each slice moved back by its measured subpixel displacement; -1 outside."""
    slices = fx.slices(spark, sf)
    shifts = register.slice_shifts(slices, subpixel=True).withColumns({c: F.round(c, 6) for c in ("dy", "dx")})
    placed = slices.join(shifts, ["volume_id", "z"])
    return _vox(planes.apply_shift(placed, None, sign=-1, fill=-1.0).select(*slices.columns))


@query("a3_align", A3_SQL)
def a3_align(spark, sf):
    """The same measured and moved in one pass."""
    return _vox(register.align(fx.slices(spark, sf), subpixel=True, fill=-1.0, digits=6))


@query("a1_slice_shifts_large", f"{E}, {CORR.replace('voxels', 'event_voxels')} SELECT volume_id, z, CAST(dy AS DOUBLE) AS dy, CAST(dx AS DOUBLE) AS dx FROM peak")
def a1_slice_shifts_large(spark, sf):
    """Slices of 24 x 24, beyond the size of direct sums: correlation by Fourier transform."""
    return register.slice_shifts(fx.event_slices(spark, sf))


def event_pairs(spark, sf, squash: float):
    """Even and odd days of each user block as [0, squash) levels."""
    level = lambda v: squash * v / (v + 50.0)
    levels = fx.event_slices(spark, sf).withColumn("data", F.transform("data", level))
    return pairing.slice_pairs(*pairing.interleaved_pair(levels))


SSIM_W = "g AS (SELECT range AS k, exp(-(range-5)*(range-5)/(2*1.5*1.5::DOUBLE)) AS w FROM range(0,11)), gn AS (SELECT k, w/(SELECT sum(w) FROM g) AS w FROM g)"


@query(
    "m4_ssim",
    f"""{E}, {SSIM_W}, lv AS (SELECT volume_id, z, x, y, 255*v/(v+50) AS v FROM event_voxels),
p AS (SELECT a.volume_id, a.z//2 AS z, a.x, a.y, a.v AS a, b.v AS b FROM lv a JOIN lv b ON a.volume_id=b.volume_id AND b.z=a.z+1 AND a.x=b.x AND a.y=b.y WHERE a.z%2=0),
r AS (SELECT volume_id, z, x-k AS x, y, sum(w*a) AS a, sum(w*b) AS b, sum(w*a*a) AS aa, sum(w*b*b) AS bb, sum(w*a*b) AS ab FROM p, gn WHERE x-k BETWEEN 0 AND 13 GROUP BY ALL),
c AS (SELECT volume_id, z, x, y-k AS y, sum(w*a) AS a, sum(w*b) AS b, sum(w*aa) AS aa, sum(w*bb) AS bb, sum(w*ab) AS ab FROM r, gn WHERE y-k BETWEEN 0 AND 13 GROUP BY ALL)
SELECT volume_id, z, round(avg((2*a*b+6.5025)*(2*(ab-a*b)+58.5225)/((a*a+b*b+6.5025)*(aa-a*a+bb-b*b+58.5225))),6) AS ssim FROM c GROUP BY ALL""",
)
def m4_ssim(spark, sf):
    out = planes.ssim(event_pairs(spark, sf, 255.0))
    return out.select("volume_id", "z", F.round("ssim", 6).alias("ssim"))


def _ms_ssim_sql() -> str:
    """Three scales of 5-tap windows on 30 x 24 planes; 2 x 2 means between, odd lengths padded by a counted zero."""
    ctes = [
        "g AS (SELECT range AS k, exp(-(range-2)*(range-2)/(2*1.5*1.5::DOUBLE)) AS w FROM range(0,5)), gn AS (SELECT k, w/(SELECT sum(w) FROM g) AS w FROM g)",
        "p0 AS (SELECT volume_id, x AS hour, z AS r, y AS c, 2*v/(v+50)-1 AS a, (2*v/(v+50)-1)*0.9 AS b FROM event_voxels)",
    ]
    h, w, parts = 30, 24, []
    c1, c2 = 0.02**2, 0.06**2
    for level in range(3):
        sums = "sum(gn.w*a) AS a, sum(gn.w*b) AS b, sum(gn.w*{aa}) AS aa, sum(gn.w*{bb}) AS bb, sum(gn.w*{ab}) AS ab"
        ctes.append(f"u{level} AS (SELECT volume_id, hour, r-k AS r, c, {sums.format(aa='a*a', bb='b*b', ab='a*b')} FROM p{level}, gn WHERE r-k BETWEEN 0 AND {h - 5} GROUP BY ALL)")
        ctes.append(f"w{level} AS (SELECT volume_id, hour, r, c-k AS c, {sums.format(aa='aa', bb='bb', ab='ab')} FROM u{level}, gn WHERE c-k BETWEEN 0 AND {w - 5} GROUP BY ALL)")
        contrast = f"(2*(ab-a*b)+{c2!r}::DOUBLE)/(aa-a*a+bb-b*b+{c2!r}::DOUBLE)"
        value = contrast if level < 2 else f"(2*a*b+{c1!r}::DOUBLE)/(a*a+b*b+{c1!r}::DOUBLE)*{contrast}"
        ctes.append(f"s{level} AS (SELECT volume_id, hour, greatest(avg({value}),0) AS s FROM w{level} GROUP BY ALL)")
        parts.append(f"power(s{level}.s, {planes.MS_WEIGHTS[level]!r}::DOUBLE)")
        if level < 2:
            ctes.append(f"p{level + 1} AS (SELECT volume_id, hour, (r+{h % 2})//2 AS r, (c+{w % 2})//2 AS c, sum(a)/4 AS a, sum(b)/4 AS b FROM p{level} GROUP BY ALL)")
            h, w = (h + 2 * (h % 2) - 2) // 2 + 1, (w + 2 * (w % 2) - 2) // 2 + 1
    return f"{E}, {', '.join(ctes)} SELECT volume_id, hour, round({'*'.join(parts)},6) AS ms_ssim FROM s0 JOIN s1 USING (volume_id, hour) JOIN s2 USING (volume_id, hour)"


@query("m5_ms_ssim", _ms_ssim_sql())
def m5_ms_ssim(spark, sf):
    """Depth x user planes of each hour against a dimmed copy, three scales, in windows of eight of thirty slices."""
    levels = fx.event_slices(spark, sf).withColumn("data", F.transform("data", lambda v: 2.0 * v / (v + 50.0) - 1.0))
    dimmed = levels.withColumn("data", F.transform("data", lambda v: v * 0.9))
    scored = planes.ms_ssim_depth(pairing.slice_pairs(levels, dimmed), win=5, rows=8, sizes=fx.event_sizes(spark, sf))
    return scored.select("volume_id", F.col("x").alias("hour"), F.round("ms_ssim", 6).alias("ms_ssim"))


@query(
    "m2_down_up_l1",
    f"""{V}, {zlinear_sql('nz*2')}, rz2 AS (SELECT volume_id, z, x, y, v FROM rz), u2 AS (SELECT volume_id, nz, CAST(unnest(range(0, nz)) AS INT) AS o FROM n),
d AS (SELECT u2.volume_id, o AS z, x, y, avg(v) AS v FROM u2 JOIN rz2 ON rz2.volume_id=u2.volume_id AND rz2.z IN (2*o, 2*o+1) GROUP BY ALL)
SELECT volume_id, round(avg(abs(d.v-s.v)),6) AS l1 FROM d JOIN voxels s USING (volume_id, z, x, y) GROUP BY ALL""",
)
def m2_down_up_l1(spark, sf):
    """Twice as deep and back, against the original."""
    slices = fx.slices(spark, sf)
    out = metrics.l1_l2(pairing.voxel_pairs(resample.down_up(slices, 2), slices), ["volume_id"])
    return out.select("volume_id", F.round("l1", 6).alias("l1"))


@query(
    "t14_rotate",
    f"""{V}, g AS (SELECT volume_id, radians(({draw_sql(15, "angle", "volume_id")}*2-1)*45) AS a FROM (SELECT DISTINCT volume_id FROM stack)),
spots AS (SELECT volume_id, CAST(p.range AS INT) AS x, CAST(q.range AS INT) AS y, 3.5+(p.range-3.5)*cos(a)+(q.range-3.5)*sin(a) AS sx, 3.5-(p.range-3.5)*sin(a)+(q.range-3.5)*cos(a) AS sy FROM g, range(0,8) p, range(0,8) q),
tap AS (SELECT *, CAST(floor(sx)+p AS INT) AS tx, CAST(floor(sy)+q AS INT) AS ty, CASE p WHEN 0 THEN 1-(sx-floor(sx)) ELSE sx-floor(sx) END * CASE q WHEN 0 THEN 1-(sy-floor(sy)) ELSE sy-floor(sy) END AS w FROM spots, (SELECT unnest([0,0,1,1]) AS p, unnest([0,1,0,1]) AS q)),
b AS (SELECT volume_id, x, y, w, {border_sql("tx", 8, "reflect")} AS tx, {border_sql("ty", 8, "reflect")} AS ty FROM tap)
SELECT s.volume_id, s.z, b.x, b.y, round(sum(w*s.v),6) + 0.0 AS v FROM b JOIN voxels s ON s.volume_id=b.volume_id AND s.x=b.tx AND s.y=b.ty GROUP BY ALL""",
)
def t14_rotate(spark, sf):
    return _vox(planes.rotate(fx.slices(spark, sf), seed=15))
