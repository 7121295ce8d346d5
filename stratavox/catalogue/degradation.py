"""Noise, degradation and user-function queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql
from stratavox.catalogue.registry import query
from stratavox.catalogue.stencils import CUBIC, DONE, ISO, V, _vox, apply_sql, border_sql, conv_sql, matlab_sql
from stratavox.functions import fields, kernels
from stratavox.operators import degrade, planes, user
from stratavox.operators.layout import slices_to_voxels

GAUSS = f"sqrt(-2*ln(1-{draw_sql(19, 'noise/r', 'volume_id', 'z', 'x', 'y')}))*cos(6.283185307179586*{draw_sql(19, 'noise/a', 'volume_id', 'z', 'x', 'y')})"


def summary(df, *extra):
    """Size, mean and extremes of each image."""
    mean = F.aggregate("data", F.lit(0.0), lambda acc, v: acc + v) / F.size("data")
    return df.select(
        "volume_id",
        "z",
        "h",
        "w",
        F.round(mean, 6).alias("mean"),
        F.round(F.array_min("data").cast("double"), 6).alias("low"),
        F.round(F.array_max("data").cast("double"), 6).alias("high"),
        *extra,
    )


@query(
    "d1_add_noise",
    f"{V}, s AS (SELECT volume_id, stddev_pop(v) AS sd FROM voxels GROUP BY volume_id) SELECT volume_id, z, x, y, round(v+0.1*sd*{GAUSS},6) + 0.0 AS v FROM voxels JOIN s USING (volume_id)",
)
def d1_add_noise(spark, sf):
    out = degrade.add_noise(fx.voxels(spark, sf), 0.1, seed=19)
    return out.withColumn("v", F.round("v", 6) + 0.0)


def _numbers(text: str) -> str:
    return "[" + ",".join(text.split()) + "]"


def _step_draw(seed: int, step: int, word: int) -> str:
    digest = f"md5(concat_ws(':', '{seed}:step:{step}:{word // 4}', concat_ws('/', CAST(volume_id AS VARCHAR), CAST(z AS VARCHAR))))"
    return f"(CAST(concat('0x', substr({digest}, {8 * (word % 4) + 1}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


IMAGE_KEY = "concat_ws('/', CAST(volume_id AS VARCHAR), CAST(z AS VARCHAR))"
SUMMARY = "SELECT volume_id, z, 24 AS h, 24 AS w, round(avg(v),6) AS mean, round(min(v),6) + 0.0 AS low, round(max(v),6) + 0.0 AS high FROM {src} GROUP BY ALL"


def _word(seed: int) -> str:
    """The word behind an image's noise fields."""
    return f"CAST(concat('0x', substr(md5(concat_ws(':', '{seed}:noise', {IMAGE_KEY})), 1, 8)) AS BIGINT)"


def _uniform_sql(src: str, out: str, word: str, place: str, stream: str | int) -> str:
    """``src`` with a uniform number per row, mixed from word, place and stream."""
    low, halves = fields.LOW_32, "xor(_x, (_x >> 16))"
    mixed = f"SELECT * REPLACE (({halves} * {fields.MIX}) & {low} AS _x) FROM"
    begun = f"SELECT *, (({word}) + (({place}) + 1) * {fields.PLACE}) & {low} AS _x FROM {src}"
    placed = f"SELECT * REPLACE (({halves} + (((({stream}) + 1) * {fields.STREAM}) & {low})) & {low} AS _x) FROM ({mixed} ({mixed} ({begun})))"
    return f"(SELECT * EXCLUDE (_x), (CAST({halves} AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS {out} FROM ({mixed} ({mixed} ({placed}))))"


def _normal_sql(src: str, out: str, word: str, place: str) -> str:
    both = _uniform_sql(_uniform_sql(src, "_r", word, place, 0), "_a", word, place, 1)
    return f"(SELECT * EXCLUDE (_r, _a), sqrt(-2.0::DOUBLE * ln(_r)) * cos(2 * pi() * _a) AS {out} FROM {both})"


def _poisson_sql(name: str, src: str, out: str, mean: str, word: str, place: str, keys: str) -> str:
    """CTEs that end in ``name``: ``src`` with a Poisson number per row, by inversion or by transformed rejection."""
    small = _uniform_sql(f"(SELECT * FROM {src} WHERE {mean} < {fields.LARGE_MEAN})", "_u", word, place, 0)
    steps = f"list_transform(range(0, {fields.INVERSION_STEPS}), lambda i: {{'i': i, 'p': exp(-{mean}), 'c': exp(-{mean}), 'k': 0}})"
    after = f"{{'i': b.i, 'p': a.p * {mean} / b.i, 'c': a.c + a.p * {mean} / b.i, 'k': a.k + CASE WHEN _u > a.c THEN 1 ELSE 0 END}}"
    tries = f"(SELECT *, unnest(range(0, {fields.ATTEMPTS})) AS _t FROM {src} WHERE {mean} >= {fields.LARGE_MEAN})"
    first = f"{fields.FIRST_ATTEMPT} + 2 * _t"
    drawn = _uniform_sql(_uniform_sql(tries, "_u", word, place, first), "_v", word, place, f"{first} + 1")
    hat = f"SELECT *, 0.931::DOUBLE + 2.53::DOUBLE * sqrt({mean}) AS _b FROM {drawn}"
    hat = f"SELECT *, -0.059::DOUBLE + 0.02483::DOUBLE * _b AS _c, 0.5::DOUBLE - abs(_u - 0.5::DOUBLE) AS _room FROM ({hat})"
    hat = f"SELECT *, floor((2 * _c / _room + _b) * (_u - 0.5::DOUBLE) + {mean} + 0.43::DOUBLE) AS _k FROM ({hat})"
    below = f"ln(_v) + ln(1.1239::DOUBLE + 1.1328::DOUBLE / (_b - 3.4::DOUBLE)) - ln(_c / (_room * _room) + _b) <= -{mean} + greatest(_k, 0) * ln({mean}) - lgamma(greatest(_k, 0) + 1)"
    fits = f"(_room >= 0.07 AND _v <= 0.9277::DOUBLE - 3.6224::DOUBLE / (_b - 2)) OR (_k >= 0 AND NOT (_room < 0.013 AND _v > _room) AND {below})"
    return f"""{name}_small AS (SELECT * EXCLUDE (_u), CAST(list_reduce({steps}, lambda a, b: {after}).k AS DOUBLE) AS {out} FROM {small}),
{name}_large AS (SELECT {keys}, arg_min(_k, _t) FILTER (WHERE {fits}) AS _k FROM ({hat}) GROUP BY ALL),
{name} AS (SELECT * FROM {name}_small UNION ALL BY NAME SELECT s.*, coalesce(_k, floor(s.{mean})) AS {out} FROM {src} s JOIN {name}_large USING ({keys}))"""


def _two_part_sql(seed: int, gaussian: float, poisson: float) -> str:
    """Noise of the volume's deviation, then shot noise; the second field has the next word."""
    at = "x * 24 + y"
    img = f"img AS (SELECT volume_id, z, x, y, v, {_word(seed)} AS w0, 0.1::DOUBLE AS rate FROM event_voxels)"
    src, turn = "img", 0
    if gaussian:
        img += f", sd AS (SELECT volume_id, stddev_pop(v) AS sd FROM event_voxels GROUP BY volume_id), nz AS (SELECT * REPLACE (v + {gaussian!r}::DOUBLE * sd * n AS v) FROM {_normal_sql('img', 'n', 'w0', at)} JOIN sd USING (volume_id))"
        src, turn = "nz", 1
    word = f"(w0 + {turn} * {fields.TURN}) & {fields.LOW_32}"
    means = f"mn AS (SELECT *, greatest(v, 0) * {poisson!r}::DOUBLE AS mean FROM {src})"
    shot = _poisson_sql("shot", "mn", "k", "mean", word, at, "volume_id, z, x, y")
    done = f"done AS (SELECT volume_id, z, v + k / {poisson!r}::DOUBLE - greatest(v, 0) AS v FROM shot)"
    return f"WITH {fx.EVENTS_SQL}, {img}, {means}, {shot}, {done} {SUMMARY.format(src='done')}"


@query("d1_add_shot_noise", _two_part_sql(19, 0.0, 0.1))
def d1_add_shot_noise(spark, sf):
    return summary(degrade.add_shot_noise(fx.event_slices(spark, sf), 0.1, seed=19))


@query("d1_two_part_noise", _two_part_sql(19, 0.1, 0.1))
def d1_two_part_noise(spark, sf):
    return summary(degrade.add_two_part_noise(fx.event_slices(spark, sf), 0.1, 0.1, seed=19))


def _colour_mix_sql(high: int) -> str:
    """Per image of ``im``: the root f of the absolute covariance, by its eigenvalues (l1, l2, l3) and Lagrange's formula."""
    drawn = _uniform_sql("(SELECT volume_id, z, w0, unnest(range(0, 12)) AS i FROM im)", "m", "w0", "i", degrade.COLOUR_STREAM)
    pivot = ", ".join(f"max(m) FILTER (WHERE i = {i}) AS m{i}" for i in range(12))
    dot = lambda a, b: " + ".join(f"{a}{r} * {b}{r}" for r in range(3))
    columns = ", ".join(f"m{3 * r + j} AS {'abc'[j]}{r}" for j in range(3) for r in range(3))
    e1 = ", ".join(f"a{r} / sqrt({dot('a', 'a')}) AS p{r}" for r in range(3))
    v2 = ", ".join(f"b{r} - ({dot('p', 'b')}) * p{r} AS u{r}" for r in range(3))
    e2 = ", ".join(f"u{r} / sqrt({dot('u', 'u')}) AS q{r}" for r in range(3))
    v3 = ", ".join(f"c{r} - ({dot('p', 'c')}) * p{r} - ({dot('q', 'c')}) * q{r} AS t{r}" for r in range(3))
    e3 = ", ".join(f"t{r} / sqrt({dot('t', 't')}) AS s{r}" for r in range(3))
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    cov = ", ".join(
        f"abs(pow({high} / 255.0::DOUBLE, 2) * ({' + '.join(f'{chr(112 + i) if i < 2 else chr(115)}{r} * m{9 + r} * {chr(112 + j) if j < 2 else chr(115)}{r}' for r in range(3))})) AS k{i}{j}"
        for i, j in pairs
    )
    square = {f"{i}{j}": " + ".join(f"k{min(i, r)}{max(i, r)} * k{min(r, j)}{max(r, j)}" for r in range(3)) for i, j in pairs}
    entries = ", ".join(f"al * ({square[f'{i}{j}']}) + be * k{i}{j}{' + ga' if i == j else ''} AS f{i}{j}" for i, j in pairs)
    return f"""mx0 AS (SELECT volume_id, z, {pivot} FROM {drawn} GROUP BY ALL),
mx1 AS (SELECT *, {columns} FROM mx0), mx2 AS (SELECT *, {e1} FROM mx1), mx3 AS (SELECT *, {v2} FROM mx2), mx4 AS (SELECT *, {e2} FROM mx3), mx5 AS (SELECT *, {v3} FROM mx4), mx6 AS (SELECT *, {e3} FROM mx5),
mx7 AS (SELECT volume_id, z, {cov} FROM mx6), mx8 AS (SELECT *, (k00 + k11 + k22) / 3 AS mid FROM mx7),
mx9 AS (SELECT *, sqrt((pow(k00 - mid, 2) + pow(k11 - mid, 2) + pow(k22 - mid, 2) + 2 * (k01 * k01 + k02 * k02 + k12 * k12)) / 6) AS wide FROM mx8),
mx10 AS (SELECT *, acos(greatest(least(((k00 - mid) * ((k11 - mid) * (k22 - mid) - k12 * k12) - k01 * (k01 * (k22 - mid) - k12 * k02) + k02 * (k01 * k12 - (k11 - mid) * k02)) / (2 * wide * wide * wide), 1), -1)) / 3 AS ph FROM mx9),
mx11 AS (SELECT *, mid + 2 * wide * cos(ph) AS l1, mid + 2 * wide * cos(ph + 2 * pi() / 3) AS l3 FROM mx10), mx12 AS (SELECT *, 3 * mid - l1 - l3 AS l2 FROM mx11),
mx13 AS (SELECT *, sqrt(abs(l1)) / ((l1 - l2) * (l1 - l3)) AS g1, sqrt(abs(l2)) / ((l2 - l1) * (l2 - l3)) AS g2, sqrt(abs(l3)) / ((l3 - l1) * (l3 - l2)) AS g3 FROM mx12),
mx14 AS (SELECT *, g1 + g2 + g3 AS al, -(g1 * (l2 + l3) + g2 * (l1 + l3) + g3 * (l1 + l2)) AS be, g1 * l2 * l3 + g2 * l1 * l3 + g3 * l1 * l2 AS ga FROM mx13),
colour AS (SELECT volume_id, z, {entries} FROM mx14)"""


def _noise_sql(seed: int, speckle: bool, low: int = 2, high: int = 25) -> str:
    level = f"{low} + least(CAST(floor(u0 * {high - low + 1}) AS INT), {high - low})"
    im = f"im AS (SELECT *, {level} AS level FROM (SELECT volume_id, z, {_step_draw(seed, 0, 0)} AS u0, {_step_draw(seed, 0, 1)} AS u1, {_word(seed)} AS w0 FROM (SELECT DISTINCT volume_id, z FROM rgb_sums)))"
    cells = "(SELECT volume_id, z, x, y, ch, v, u1, level, w0 FROM event_rgb JOIN im USING (volume_id, z))"
    drawn = _normal_sql(cells, "n", "w0", "CASE WHEN u1 < 0.4 THEN x * 24 + y ELSE (x * 24 + y) * 3 + ch END")
    wide = ", ".join(f"max({c}) FILTER (WHERE ch = {k}) AS {c}{k}" for c in "vn" for k in range(3))
    f = lambda i, j: f"f{min(i, j)}{max(i, j)}"
    noise = ", ".join(f"CASE WHEN u1 > 0.6 OR u1 < 0.4 THEN n{k} * (level / 255.0::DOUBLE) ELSE {' + '.join(f'n{i} * {f(i, k)}' for i in range(3))} END" for k in range(3))
    out = "v + v * n" if speckle else "v + n"
    return f"""WITH {fx.EVENT_RGB_SQL}, {im}, {_colour_mix_sql(high)},
px AS (SELECT volume_id, z, x, y, u1, level, {wide} FROM {drawn} GROUP BY ALL),
el AS (SELECT volume_id, z, unnest([v0, v1, v2]) AS v, unnest([{noise}]) AS n FROM px JOIN colour USING (volume_id, z)),
done AS (SELECT volume_id, z, greatest(least({out}, 1), 0) AS v FROM el) {SUMMARY.format(src='done')}"""


@query("d2_gaussian_noise", _noise_sql(2, speckle=False))
def d2_gaussian_noise(spark, sf):
    return summary(degrade.gaussian_noise(fx.event_rgb(spark, sf), seed=2))


@query("d3_speckle_noise", _noise_sql(3, speckle=True))
def d3_speckle_noise(spark, sf):
    return summary(degrade.speckle_noise(fx.event_rgb(spark, sf), seed=3))


def _shot_sql(seed: int) -> str:
    byte = "greatest(least(round_even(round(({v})*255,9),0),255),0)/255"
    im = f"im AS (SELECT *, pow(10, 2 * u0 + 2) AS counts FROM (SELECT volume_id, z, {_step_draw(seed, 0, 0)} AS u0, {_step_draw(seed, 0, 1)} AS u1, {_word(seed)} AS w0 FROM (SELECT DISTINCT volume_id, z FROM rgb_sums)))"
    held = f"held AS (SELECT volume_id, z, x, y, ch, {byte.format(v='v')} AS v, u1, counts, w0 FROM event_rgb JOIN im USING (volume_id, z))"
    colours = _poisson_sql("cs", "cm", "k", "mean", "w0", "(x * 24 + y) * 3 + ch", "volume_id, z, x, y, ch")
    grays = _poisson_sql("gs", "gm", "k", "mean", "w0", "x * 24 + y", "volume_id, z, x, y")
    level = byte.format(v="0.299::DOUBLE*max(v) FILTER (WHERE ch = 0) + 0.587::DOUBLE*max(v) FILTER (WHERE ch = 1) + 0.114::DOUBLE*max(v) FILTER (WHERE ch = 2)")
    return f"""WITH {fx.EVENT_RGB_SQL}, {im}, {held},
cm AS (SELECT *, v * counts AS mean FROM held WHERE u1 < 0.5), {colours},
g AS (SELECT volume_id, z, x, y, counts, w0, {level} AS gray FROM held WHERE u1 >= 0.5 GROUP BY ALL), gm AS (SELECT *, gray * counts AS mean FROM g), {grays},
done AS (SELECT volume_id, z, greatest(least(k / counts, 1), 0) AS v FROM cs
 UNION ALL SELECT held.volume_id, held.z, greatest(least(held.v + (k / gs.counts - gray), 1), 0) FROM held JOIN gs USING (volume_id, z, x, y)) {SUMMARY.format(src='done')}"""


@query("d4_poisson_noise", _shot_sql(4))
def d4_poisson_noise(spark, sf):
    return summary(degrade.poisson_noise(fx.event_rgb(spark, sf), seed=4))


def coder_mixes() -> tuple[list[str], list[str]]:
    """The coder's channels from r, g, b, and the colours from c0, c1, c2."""

    def mix(rows, names):
        return [" + ".join(f"({w!r}::DOUBLE)*{n}" for w, n in zip(row, names)) for row in rows]

    return mix(degrade.TO_YCC.tolist(), "rgb"), mix(np.linalg.inv(degrade.TO_YCC).tolist(), ("c0", "c1", "c2"))


def _dct_sql(seed: int) -> str:
    """Forward and inverse cosine transform as four weighted sums over 8-blocks, quantised between."""
    (y, cb, cr), (r, g, b) = coder_mixes()
    quant = f"greatest(least(floor((CASE WHEN c=0 THEN ({_numbers(degrade.LUMA)})[k*8+l+1] ELSE ({_numbers(degrade.CHROMA)})[k*8+l+1] END*percent+50)/100),255),1)"
    return f"""WITH {fx.EVENT_RGB_SQL}, lv AS (SELECT volume_id, z, x, y, max(CASE WHEN ch=0 THEN v END) AS r, max(CASE WHEN ch=1 THEN v END) AS g, max(CASE WHEN ch=2 THEN v END) AS b
 FROM (SELECT volume_id, z, x, y, ch, round_even(round(v*255,9),0) AS v FROM event_rgb) GROUP BY ALL),
q AS (SELECT volume_id, z, CASE WHEN q < 50 THEN 5000.0::DOUBLE/q ELSE 200-2*q END AS percent FROM (SELECT volume_id, z, 30+least(CAST(floor({_step_draw(seed, 0, 0)}*66) AS INT),65) AS q FROM (SELECT DISTINCT volume_id, z FROM rgb_sums))),
y3 AS (SELECT volume_id, z, x, y, unnest([0,1,2]) AS c, unnest([{y}-128, {cb}, {cr}]) AS v FROM lv),
basis AS (SELECT a.range AS k, b.range AS i, cos((2*b.range+1)*a.range*pi()/16)/2*CASE WHEN a.range=0 THEN 1/sqrt(2) ELSE 1 END AS w FROM range(0,8) a, range(0,8) b),
f1 AS (SELECT volume_id, z, c, x//8 AS bx, k, y, sum(w*v) AS v FROM y3 JOIN basis ON i=x%8 GROUP BY ALL),
f2 AS (SELECT volume_id, z, c, bx, f1.k, y//8 AS bq, basis.k AS l, sum(w*v) AS v FROM f1 JOIN basis ON i=y%8 GROUP BY ALL),
h AS (SELECT volume_id, z, c, bx, k, bq, l, round_even(round(v/{quant},9),0)*{quant} AS v FROM f2 JOIN q USING (volume_id, z)),
b1 AS (SELECT volume_id, z, c, bx*8+i AS x, bq, l, sum(w*v) AS v FROM h JOIN basis USING (k) GROUP BY ALL),
b2 AS (SELECT volume_id, z, c, x, bq*8+i AS y, sum(w*v) AS v FROM b1 JOIN basis ON basis.k=l GROUP BY ALL),
o AS (SELECT volume_id, z, x, y, max(CASE WHEN c=0 THEN v+128 END) AS c0, max(CASE WHEN c=1 THEN v END) AS c1, max(CASE WHEN c=2 THEN v END) AS c2 FROM b2 GROUP BY ALL),
p AS (SELECT volume_id, z, unnest([{r}, {g}, {b}]) AS v FROM o), lim AS (SELECT volume_id, z, greatest(least(round_even(round(v,9),0),255),0)/255 AS v FROM p)
SELECT volume_id, z, 24 AS h, 24 AS w, round(avg(v),6) AS mean, round(min(v),6) + 0.0 AS low, round(max(v),6) AS high FROM lim GROUP BY ALL"""


@query("d5_dct_quantize_noise", _dct_sql(5))
def d5_dct_quantize_noise(spark, sf):
    return summary(degrade.dct_quantize_noise(fx.event_rgb(spark, sf), seed=5))


def _drawn(seed: int, words: int) -> str:
    """``u0``, ``u1`` ... of every colour image."""
    numbers = ", ".join(f"{_step_draw(seed, 0, k)} AS u{k}" for k in range(words))
    return f"(SELECT volume_id, z, {numbers} FROM (SELECT DISTINCT volume_id, z FROM rgb_sums))"


def _blur_sql(seed: int, sf: int) -> str:
    """A kernel per image, applied under mirrored borders."""
    wide, narrow = 4.0 + sf, 2.0 + 0.2 * sf
    theta = "u2 * pi()"
    im = f"""im AS (SELECT *, 2 * (2 + least(CAST(floor(u1 * 10) AS INT), 9)) + 3 AS size, greatest({wide!r}::DOUBLE * u3, 1e-6::DOUBLE) AS l1, greatest({wide!r}::DOUBLE * u4, 1e-6::DOUBLE) AS l2, greatest({narrow!r}::DOUBLE * u3, 1e-6::DOUBLE) AS sigma FROM {_drawn(seed, 5)}),
im2 AS (SELECT *, l1 * pow(cos({theta}), 2) + l2 * pow(sin({theta}), 2) AS m0, l1 * pow(sin({theta}), 2) + l2 * pow(cos({theta}), 2) AS m1, (l1 - l2) * sin({theta}) * cos({theta}) AS m2 FROM im),
kr AS (SELECT *, ky - (size - 1) / 2.0::DOUBLE AS gy, kx - (size - 1) / 2.0::DOUBLE AS gx, m0 * m1 - m2 * m2 AS det FROM im2, (SELECT a.range AS ky, b.range AS kx FROM range(0, 25) a, range(0, 25) b) WHERE ky < size AND kx < size),
kw AS (SELECT volume_id, z, size, ky, kx, u0, CASE WHEN u0 < 0.5 THEN exp(-0.5::DOUBLE * (gx * gx * m1 - 2 * gx * gy * m2 + gy * gy * m0) / det) ELSE exp(-(gy * gy + gx * gx) / (2 * sigma * sigma)) END AS w FROM kr),
kc AS (SELECT * REPLACE (CASE WHEN u0 >= 0.5 AND w < 2.220446049250313e-16::DOUBLE * max(w) OVER (PARTITION BY volume_id, z) THEN 0 ELSE w END AS w) FROM kw),
k AS (SELECT volume_id, z, ky - size // 2 AS ky, kx - size // 2 AS kx, w / sum(w) OVER (PARTITION BY volume_id, z) AS w FROM kc)"""
    spots = f"spots AS (SELECT a.range AS x, t.range - 12 AS k, {border_sql('(a.range - (t.range - 12))', 24, 'mirror')} AS sx FROM range(0, 24) a, range(0, 25) t)"
    px = "px AS (SELECT volume_id, z, x, y, max(v) FILTER (WHERE ch = 0) AS r, max(v) FILTER (WHERE ch = 1) AS g, max(v) FILTER (WHERE ch = 2) AS b FROM event_rgb GROUP BY ALL)"
    # The rows of the kernel first: sources of one column share their place.
    out = """o AS (SELECT k.volume_id, k.z, p.x, q.x AS y, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b FROM k JOIN spots p ON p.k = k.ky JOIN spots q ON q.k = k.kx
 JOIN px ON px.volume_id = k.volume_id AND px.z = k.z AND px.x = p.sx AND px.y = q.sx GROUP BY ALL)"""
    return f"WITH {fx.EVENT_RGB_SQL}, {im}, {spots}, {px}, {out}, done AS (SELECT volume_id, z, unnest([r, g, b]) AS v FROM o) {SUMMARY.format(src='done')}"


@query("d6_blur_random", _blur_sql(6, 4))
def d6_blur_random(spark, sf):
    return summary(degrade.blur_random(fx.event_rgb(spark, sf), 4, seed=6))


def _resize_sql(seed: int, sf: int) -> str:
    """Weights of every method and size from 24 cells, then a drawn method and size per image."""
    least = 0.5 / sf
    factor = f"CASE WHEN u0 > 0.8 THEN 1 + u1 WHEN u0 < 0.7 THEN {least!r}::DOUBLE + u1 * {1 - least!r}::DOUBLE ELSE 1.0::DOUBLE END"
    im = f"im AS (SELECT volume_id, z, CAST(floor(({factor}) * 24) AS INT) AS m, least(CAST(floor(u2 * 3) AS INT), 2) AS how FROM {_drawn(seed, 3)})"
    # how: 0 linear, 1 cubic, 2 shares of covered cells (linear when enlarging).
    weights = f"""sz AS (SELECT DISTINCT m, CASE WHEN how = 2 AND m >= 24 THEN 0 ELSE how END AS how FROM im), ou AS (SELECT m, how, unnest(range(0, m)) AS o FROM sz),
pos AS (SELECT *, (o + 0.5::DOUBLE) * 24 / m - 0.5::DOUBLE AS u FROM ou),
lin AS (SELECT m, how, o, greatest(u, 0) AS u FROM pos WHERE how = 0),
wl AS (SELECT m, how, o, least(CAST(floor(u) AS INT), 23) AS i, 1 - (u - least(floor(u), 23)) AS w FROM lin UNION ALL SELECT m, how, o, least(CAST(floor(u) AS INT) + 1, 23), u - least(floor(u), 23) FROM lin),
cu AS (SELECT m, how, o, u, CAST(floor(u) AS INT) + t.k AS tap FROM pos, (SELECT unnest([-1, 0, 1, 2]) AS k) t WHERE how = 1),
wc AS (SELECT m, how, o, greatest(0, least(23, tap)) AS i, {CUBIC.format(t="(u-tap)", a="(-0.75::DOUBLE)")} AS w FROM cu),
cv AS (SELECT m, how, o, p, greatest(least((o + 1) * 24.0::DOUBLE / m, p + 1) - greatest(o * 24.0::DOUBLE / m, p), 0) AS w FROM ou, (SELECT range AS p FROM range(0, 24)) WHERE how = 2),
wv AS (SELECT m, how, o, p AS i, w / sum(w) OVER (PARTITION BY m, o) AS w FROM cv),
wt AS (SELECT m, how, o, i, sum(w) AS w FROM (SELECT * FROM wl UNION ALL SELECT * FROM wc UNION ALL SELECT * FROM wv) GROUP BY ALL)"""
    return f"""WITH {fx.EVENT_RGB_SQL}, {im}, {weights}, im2 AS (SELECT volume_id, z, m, CASE WHEN how = 2 AND m >= 24 THEN 0 ELSE how END AS how FROM im),
a AS (SELECT volume_id, z, m, how, wt.o AS x, y, ch, sum(w * v) AS v FROM event_rgb JOIN im2 USING (volume_id, z) JOIN wt USING (m, how) WHERE wt.i = x GROUP BY ALL),
b AS (SELECT volume_id, z, m, x, wt.o AS y, ch, greatest(least(sum(w * v), 1), 0) AS v FROM a JOIN wt USING (m, how) WHERE wt.i = y GROUP BY ALL)
SELECT volume_id, z, m AS h, m AS w, round(avg(v),6) + 0.0 AS mean, round(min(v),6) + 0.0 AS low, round(max(v),6) + 0.0 AS high FROM b GROUP BY ALL"""


@query("d7_resize_random", _resize_sql(7, 4))
def d7_resize_random(spark, sf):
    return summary(degrade.resize_random(fx.event_rgb(spark, sf), 4, seed=7))


SHARP_K = """tap_raw AS (SELECT range AS k, exp(-(range-3)*(range-3)/(2*1.4*1.4::DOUBLE)) AS w FROM range(0,7)), tap AS (SELECT k, w/(SELECT sum(w) FROM tap_raw) AS w FROM tap_raw),
k7 AS (SELECT a.k AS ky, b.k AS kx, a.w*b.w AS w FROM tap a, tap b)"""


@query(
    "d8_sharpen",
    f"""{V}, {SHARP_K}, img AS (SELECT volume_id, z, x, y, (v+0.5) AS v FROM voxels), {conv_sql('k7', 7, 'mirror', source='img', name='smooth')},
mask AS (SELECT volume_id, z, x, y, CASE WHEN abs(i.v-s.v)*255 > 10 THEN 1.0 ELSE 0.0 END AS v, i.v AS img, i.v-s.v AS res FROM img i JOIN smooth s USING (volume_id, z, x, y)),
{conv_sql('k7', 7, 'mirror', source='mask', name='soft')}
SELECT volume_id, z, x, y, round(soft.v*greatest(least(img+0.5*res,1),0)+(1-soft.v)*img,6) + 0.0 AS v FROM mask JOIN soft USING (volume_id, z, x, y)""",
)
def d8_sharpen(spark, sf):
    bright = fx.slices(spark, sf).withColumn("data", F.transform("data", lambda v: v + 0.5))
    return _vox(planes.sharpen(bright, 0.5, 6, 10.0))


@query("d9_bicubic_degradation", f"{V}, {matlab_sql('w', 8, 0.5)}, {apply_sql('w', 'w')} {DONE.format(t='res')}")
def d9_bicubic_degradation(spark, sf):
    return _vox(degrade.bicubic_degradation(fx.slices(spark, sf), 2))


@query("d10_srmd_degradation", f"{V}, {ISO}, {conv_sql('iso', 5, 'wrap')}, {matlab_sql('w', 8, 0.5)}, {apply_sql('w', 'w', 'conv')} {DONE.format(t='res')}")
def d10_srmd_degradation(spark, sf):
    return _vox(degrade.srmd_degradation(fx.slices(spark, sf), kernels.isotropic_gaussian(5, 1.3), 2))


@query("d11_dpsr_degradation", f"{V}, {ISO}, {matlab_sql('w', 8, 0.5)}, {apply_sql('w', 'w')}, {conv_sql('iso', 5, 'wrap', n=4, source='res')} {DONE.format(t='conv')}")
def d11_dpsr_degradation(spark, sf):
    return _vox(degrade.dpsr_degradation(fx.slices(spark, sf), kernels.isotropic_gaussian(5, 1.3), 2))


@query("d12_classical_degradation", f"{V}, {ISO}, {conv_sql('iso', 5, 'wrap')} SELECT volume_id, z, x//2 AS x, y//2 AS y, round(v,6) + 0.0 AS v FROM conv WHERE x%2=0 AND y%2=0")
def d12_classical_degradation(spark, sf):
    return _vox(degrade.classical_degradation(fx.slices(spark, sf), kernels.isotropic_gaussian(5, 1.3), 2))


@query("u2_parallel_apply", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v*v)),6) AS energy FROM embeddings")
def u2_parallel_apply(spark, sf):
    """A user function over chunks of vectors, one value per vector, order key kept."""
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")

    def energy(chunk, worker_id):
        import numpy as np

        total = (np.stack(chunk["embedding"].to_numpy()).astype(float) ** 2).sum(axis=1)
        return chunk.assign(energy=total.round(6))[["vec_id", "energy"]]

    return user.parallel_apply(rows, energy, 8, "vec_id long, energy double", order="vec_id", pass_worker=True)


@query("u3_transforms_fn", f"{V} SELECT volume_id, z, x-2 AS x, y-2 AS y, round(v*2,6) + 0.0 AS v FROM voxels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5")
def u3_transforms_fn(spark, sf):
    """A caller's transform in place of the default sample preparation."""
    from stratavox.operators.tiling import center_crop

    def mine(df):
        return center_crop(df, 4, 4).withColumn("v", F.round(F.col("v") * 2, 6) + 0.0)

    return user.prepare_samples(fx.voxels(spark, sf), transforms=mine)


@query("u5_score_model", f"{V} SELECT volume_id, z, CAST(x//4 AS INT) AS x, CAST(y//4 AS INT) AS y, round(avg(v),6) + 0.0 AS v FROM voxels GROUP BY ALL")
def u5_score_model(spark, sf):
    """A model that encodes each slice to the means of its quarters, loaded once per task."""

    def load():
        import numpy as np

        weights = np.kron(np.eye(2), np.full((1, 4), 0.25))
        return lambda batch: np.einsum("hy,bcyx,wx->bchw", weights, batch, weights)

    coded = user.score_model(fx.slices(spark, sf), load)
    return slices_to_voxels(coded).withColumn("v", F.round("v", 6) + 0.0)
