"""Degradation recipes and their SQL: a recursive query whose turns each play every image's own next action."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.degradation import IMAGE_KEY, _colour_mix_sql, _normal_sql, _numbers, _poisson_sql, _step_draw, _word, coder_mixes, summary
from stratavox.catalogue.geometry import draw_sql, integer_sql
from stratavox.catalogue.registry import query
from stratavox.catalogue.stencils import CUBIC
from stratavox.functions import fields
from stratavox.operators import degrade

SIDE = 24
RGB = ("r", "g", "b")
BYTE = "greatest(least(round_even(round(({v})*255,9),0),255),0)/255"


def order_sql(low: int, high: int, seed: int, stream: str) -> str:
    """The integers low ... high - 1 in the order of keyed draws."""
    tagged = ", ".join(f"{{'u': {draw_sql(seed, f'{stream}/{i}', IMAGE_KEY)}, 'i': {i}}}" for i in range(low, high))
    return f"list_transform(list_sort([{tagged}]), lambda e: e.i)"


def mixed_turns(seed: int) -> str:
    """Opening, seven shuffled actions with the shrink before the fit, closing."""
    a, b = degrade.SHRINK, degrade.FIT
    swapped = f"list_transform(o, lambda i: CASE i WHEN {a} THEN {b} WHEN {b} THEN {a} ELSE i END)"
    ordered = f"(SELECT CASE WHEN list_position(o, {b}) < list_position(o, {a}) THEN {swapped} ELSE o END FROM (SELECT {order_sql(0, 7, seed, 'order')} AS o))"
    return f"list_concat([7], list_concat({ordered}, [8]))"


def two_round_turns(seed: int, shuffle: float) -> str:
    """Thirteen actions, all of them or only those of the noise shuffled, then the closing ones."""
    parts = f"list_concat(list_concat([0, 1], {order_sql(2, 6, seed, 'order2')}), list_concat([6, 7, 8], {order_sql(9, 13, seed, 'order9')}))"
    return f"list_concat(CASE WHEN {draw_sql(seed, 'shuffle', IMAGE_KEY)} < {shuffle} THEN {order_sql(0, 13, seed, 'order')} ELSE {parts} END, [13, 14])"


def _mirror(i: str, n: str) -> str:
    """Place of any row or column under borders that do not repeat the edge."""
    j = f"((({i}) % (2 * {n} - 2)) + (2 * {n} - 2)) % (2 * {n} - 2)"
    return f"CASE WHEN {n} = 1 THEN 0 WHEN {j} < {n} THEN {j} ELSE 2 * {n} - 2 - {j} END"


def _resampling_sql(chance: float) -> str:
    """``resized``: images whose turn is a change of size, by weights of each (size, new size, method)."""
    grown = "CASE WHEN u0 > 0.8 THEN 1 + u1 WHEN u0 < 0.7 THEN 0.5::DOUBLE / sf + u1 * (1 - 0.5::DOUBLE / sf) ELSE 1.0::DOUBLE END"
    target = f"""CASE kind WHEN 'fit' THEN base // sf WHEN 'rescale' THEN CAST(floor(({grown}) * m) AS INT) WHEN 'shrink' THEN CAST(floor(m / (1 + u1 * (2 * sf - 1))) AS INT)
 ELSE CASE WHEN u0 < 0.5 THEN m // 2 ELSE (m + 1) // 2 END END"""
    drawn = "least(CAST(floor((CASE kind WHEN 'fit' THEN u0 WHEN 'halve' THEN u1 ELSE u2 END) * 3) AS INT), 2)"
    # how: 0 linear, 1 cubic, 2 shares of covered cells (linear when enlarging), 3 the widened cubic at half size.
    return f"""rs0 AS (SELECT volume_id, z, m, {target} AS n, CASE WHEN kind = 'halve' AND u0 >= 0.5 THEN 3 ELSE {drawn} END AS how FROM act WHERE kind IN ('fit', 'rescale', 'halve') OR (kind = 'shrink' AND u0 < {chance})),
rs AS (SELECT volume_id, z, m, n, CASE WHEN how = 2 AND n >= m THEN 0 ELSE how END AS how FROM rs0),
ou AS (SELECT m, n, how, unnest(range(0, n)) AS o FROM (SELECT DISTINCT m, n, how FROM rs)),
pos AS (SELECT *, (o + 0.5::DOUBLE) * m / n - 0.5::DOUBLE AS u FROM ou),
lin AS (SELECT m, n, how, o, greatest(u, 0) AS u, least(CAST(floor(greatest(u, 0)) AS INT), m - 1) AS low FROM pos WHERE how = 0),
cut AS (SELECT m, n, how, o, u, CAST(floor(u) AS INT) + k AS tap FROM pos, (SELECT unnest([-1, 0, 1, 2]) AS k) WHERE how = 1),
cov AS (SELECT m, n, how, o, p, greatest(least((o + 1) * m / n::DOUBLE, p + 1) - greatest(o * m / n::DOUBLE, p), 0) AS w FROM (SELECT *, unnest(range(0, m)) AS p FROM ou WHERE how = 2)),
wid AS (SELECT m, n, how, o, 2 * (o + 1) - 0.5::DOUBLE AS u, CAST(floor(2 * (o + 1) - 4.5::DOUBLE) AS INT) + k AS tap FROM ou, (SELECT unnest(range(0, 10)) AS k) WHERE how = 3),
wir AS (SELECT m, n, how, o, (((tap - 1) % (2 * m)) + 2 * m) % (2 * m) AS j, {CUBIC.format(t='(0.5::DOUBLE * (u - tap))', a='(-0.5::DOUBLE)')} AS w FROM wid),
wt AS (SELECT m, n, how, o, i, sum(w) AS w FROM (
 SELECT m, n, how, o, low AS i, 1 - (u - low) AS w FROM lin UNION ALL SELECT m, n, how, o, least(low + 1, m - 1), u - low FROM lin
 UNION ALL SELECT m, n, how, o, greatest(0, least(m - 1, tap)), {CUBIC.format(t='(u-tap)', a='(-0.75::DOUBLE)')} FROM cut
 UNION ALL SELECT m, n, how, o, p, w / sum(w) OVER (PARTITION BY m, n, o) FROM cov
 UNION ALL SELECT m, n, how, o, CASE WHEN j < m THEN j ELSE 2 * m - 1 - j END, w / sum(w) OVER (PARTITION BY m, n, o) FROM wir) GROUP BY ALL),
ra AS (SELECT volume_id, z, rs.m, rs.n, rs.how, wt.o AS x, y, {', '.join(f'sum(w * {c}) AS {c}' for c in RGB)} FROM now JOIN rs USING (volume_id, z) JOIN wt ON wt.m = rs.m AND wt.n = rs.n AND wt.how = rs.how AND wt.i = x GROUP BY ALL),
resized AS (SELECT volume_id, z, ra.n AS m, x, wt.o AS y, {', '.join(f'greatest(least(sum(w * {c}), 1), 0) AS {c}' for c in RGB)} FROM ra JOIN wt ON wt.m = ra.m AND wt.n = ra.n AND wt.how = ra.how AND wt.i = y GROUP BY ALL)"""


def _filter_sql(chance: float, light: bool) -> str:
    """``filtered``: blurs of a drawn kernel, and shrinks by a shifted kernel and striding."""
    part = 4 if light else 1
    span = "CASE WHEN u0 < 0.5 THEN 10 ELSE 3 END" if light else "10"
    pick = f"2 + least(CAST(floor(u1 * ({span})) AS INT), ({span}) - 1)"
    size = f"({pick}) + 3" if light else f"2 * ({pick}) + 3"
    width = f"(4.0::DOUBLE + sf) / {part}"
    theta = "u2 * pi()"
    return f"""bl AS (SELECT *, {size} AS size, greatest({width} * u3, 1e-6::DOUBLE) AS l1, greatest({width} * u4, 1e-6::DOUBLE) AS l2, u0 < 0.5 AS slant, greatest((2.0::DOUBLE + 0.2::DOUBLE * sf) / {part} * u3, 1e-6::DOUBLE) AS sigma FROM act WHERE kind = 'blur'
 UNION ALL BY NAME SELECT *, 25 AS size, 1.0::DOUBLE AS l1, 1.0::DOUBLE AS l2, false AS slant, 0.1::DOUBLE + u1 * (0.6::DOUBLE * sf - 0.1::DOUBLE) AS sigma FROM act WHERE kind = 'shrink' AND u0 >= {chance}),
bl2 AS (SELECT *, l1 * pow(cos({theta}), 2) + l2 * pow(sin({theta}), 2) AS m0, l1 * pow(sin({theta}), 2) + l2 * pow(cos({theta}), 2) AS m1, (l1 - l2) * sin({theta}) * cos({theta}) AS m2 FROM bl),
kr AS (SELECT *, ky - (size - 1) / 2.0::DOUBLE AS gy, kx - (size - 1) / 2.0::DOUBLE AS gx, m0 * m1 - m2 * m2 AS det FROM bl2, (SELECT a.range AS ky, b.range AS kx FROM range(0, 25) a, range(0, 25) b) WHERE ky < size AND kx < size),
kw AS (SELECT volume_id, z, m, kind, sf, size, ky, kx, slant, CASE WHEN slant THEN exp(-0.5::DOUBLE * (gx * gx * m1 - 2 * gx * gy * m2 + gy * gy * m0) / det) ELSE exp(-(gy * gy + gx * gx) / (2 * sigma * sigma)) END AS w FROM kr),
kc AS (SELECT * REPLACE (CASE WHEN NOT slant AND w < 2.220446049250313e-16::DOUBLE * max(w) OVER (PARTITION BY volume_id, z) THEN 0 ELSE w END AS w) FROM kw),
sh AS (SELECT sf, o, least(o + (sf - 1) * 0.5::DOUBLE, 24) AS u FROM (SELECT DISTINCT sf FROM act), (SELECT unnest(range(0, 25)) AS o)),
sw AS (SELECT sf, o, i, sum(w) AS w FROM (SELECT sf, o, CAST(floor(u) AS INT) AS i, 1 - (u - floor(u)) AS w FROM sh UNION ALL SELECT sf, o, least(CAST(floor(u) AS INT) + 1, 24), u - floor(u) FROM sh) GROUP BY ALL),
km AS (SELECT volume_id, z, m, 1 AS st, size, ky, kx, w FROM kc WHERE kind = 'blur'
 UNION ALL SELECT volume_id, z, m, kc.sf, size, p.o, q.o, sum(p.w * q.w * kc.w) FROM kc JOIN sw p ON p.sf = kc.sf AND p.i = ky JOIN sw q ON q.sf = kc.sf AND q.i = kx WHERE kind = 'shrink' GROUP BY ALL),
k AS (SELECT volume_id, z, m, st, ky - size // 2 AS ky, kx - size // 2 AS kx, coalesce(w / nullif(sum(w) OVER (PARTITION BY volume_id, z), 0), 0) AS w FROM km),
places AS (SELECT m, st, unnest(range(0, (m + st - 1) // st)) AS x FROM (SELECT DISTINCT m, st FROM k)),
spots AS (SELECT m, st, x, d, {_mirror('x * st - d', 'm')} AS sx FROM places, (SELECT unnest(range(-12, 13)) AS d)),
f0 AS (SELECT k.volume_id, k.z, k.m, k.st, p.x, q.x AS y, {', '.join(f'sum(w * {c}) AS {c}' for c in RGB)} FROM k JOIN spots p ON p.m = k.m AND p.st = k.st AND p.d = k.ky JOIN spots q ON q.m = k.m AND q.st = k.st AND q.d = k.kx
 JOIN now ON now.volume_id = k.volume_id AND now.z = k.z AND now.x = p.sx AND now.y = q.sx GROUP BY ALL),
filtered AS (SELECT volume_id, z, (f0.m + st - 1) // st AS m, x, y, {', '.join(f"CASE WHEN kind = 'shrink' THEN greatest(least({c}, 1), 0) ELSE {c} END AS {c}" for c in RGB)} FROM f0 JOIN act USING (volume_id, z))"""


def _noise_part_sql(low: int, high: int) -> str:
    """``noised``: normal noise added or multiplied; ``im`` holds the images whose channels are correlated."""
    level = f"{low} + least(CAST(floor(u0 * {high - low + 1}) AS INT), {high - low})"
    cells = "(SELECT volume_id, z, now.m, x, y, kind, u1, level, w0, unnest([0, 1, 2]) AS ch, unnest([r, g, b]) AS v0 FROM now JOIN nz USING (volume_id, z))"
    held = f"(SELECT * EXCLUDE (v0), CASE WHEN kind = 'speckle' THEN greatest(least(v0, 1), 0) ELSE v0 END AS v FROM {cells})"
    drawn = _normal_sql(held, "n", "w0", "CASE WHEN u1 < 0.4 THEN x * m + y ELSE (x * m + y) * 3 + ch END")
    wide = ", ".join(f"max({c}) FILTER (WHERE ch = {k}) AS {c}{k}" for c in "vn" for k in range(3))
    mixed = [" + ".join(f"n{i} * f{min(i, k)}{max(i, k)}" for i in range(3)) for k in range(3)]
    noise = ", ".join(f"CASE WHEN u1 > 0.6 OR u1 < 0.4 THEN n{k} * (level / 255.0::DOUBLE) ELSE {mixed[k]} END AS e{k}" for k in range(3))
    out = ", ".join(f"greatest(least(v{k} + CASE WHEN kind = 'speckle' THEN v{k} ELSE 1 END * e{k}, 1), 0) AS {c}" for k, c in enumerate(RGB))
    return f"""nz AS (SELECT volume_id, z, kind, u1, {level} AS level, (w0 + wi * {fields.TURN}) & {fields.LOW_32} AS w0 FROM act WHERE kind IN ('noise', 'speckle')),
im AS (SELECT volume_id, z, w0 FROM nz WHERE u1 >= 0.4 AND u1 <= 0.6), {_colour_mix_sql(high)},
npx AS (SELECT volume_id, z, m, x, y, kind, u1, level, {wide} FROM {drawn} GROUP BY ALL),
nel AS (SELECT *, {noise} FROM npx LEFT JOIN colour USING (volume_id, z)),
noised AS (SELECT volume_id, z, m, x, y, {out} FROM nel)"""


def _shot_part_sql() -> str:
    """``shot``: Poisson noise of the colours or of their gray value."""
    gray = BYTE.format(v="0.299::DOUBLE*p0 + 0.587::DOUBLE*p1 + 0.114::DOUBLE*p2")
    bytes_ = ", ".join(f"{BYTE.format(v=c)} AS p{k}" for k, c in enumerate(RGB))
    pivot = ", ".join(f"max(greatest(least(k / counts, 1), 0)) FILTER (WHERE ch = {k}) AS {c}" for k, c in enumerate(RGB))
    out = ", ".join(f"greatest(least(p{k} + (k / counts - gray), 1), 0) AS {c}" for k, c in enumerate(RGB))
    return f"""po AS (SELECT volume_id, z, u1, pow(10, 2 * u0 + 2) AS counts, (w0 + wi * {fields.TURN}) & {fields.LOW_32} AS w0 FROM act WHERE kind = 'shot'),
ph AS (SELECT volume_id, z, now.m, x, y, u1, counts, w0, {bytes_} FROM now JOIN po USING (volume_id, z)),
pc AS (SELECT volume_id, z, m, x, y, counts, w0, unnest([0, 1, 2]) AS ch, unnest([p0, p1, p2]) AS v FROM ph WHERE u1 < 0.5),
cm AS (SELECT *, v * counts AS mean FROM pc), {_poisson_sql('cs', 'cm', 'k', 'mean', 'w0', '(x * m + y) * 3 + ch', 'volume_id, z, x, y, ch')},
pg AS (SELECT *, {gray} AS gray FROM ph WHERE u1 >= 0.5), gm AS (SELECT *, gray * counts AS mean FROM pg), {_poisson_sql('gs', 'gm', 'k', 'mean', 'w0', 'x * m + y', 'volume_id, z, x, y')},
shot AS (SELECT volume_id, z, m, x, y, {pivot} FROM cs GROUP BY ALL UNION ALL SELECT volume_id, z, m, x, y, {out} FROM gs)"""


def _coder_part_sql(low: int, high: int) -> str:
    """``coded``: the coder's cosine blocks of whole eights, edges repeated."""
    (y, cb, cr), back = coder_mixes()
    quant = f"greatest(least(floor((CASE WHEN c=0 THEN ({_numbers(degrade.LUMA)})[k*8+l+1] ELSE ({_numbers(degrade.CHROMA)})[k*8+l+1] END*percent+50)/100),255),1)"
    levels = ", ".join(f"round_even(round(greatest(least({c}, 1), 0)*255,9),0) AS {c}" for c in RGB)
    out = ", ".join(f"greatest(least(round_even(round({e},9),0),255),0)/255 AS {c}" for c, e in zip(RGB, back))
    return f"""q0 AS (SELECT volume_id, z, m, {low} + least(CAST(floor(u0 * {high - low + 1}) AS INT), {high - low}) AS q FROM act WHERE kind = 'coder'),
q AS (SELECT volume_id, z, m, CASE WHEN q < 50 THEN 5000.0::DOUBLE / q ELSE 200 - 2 * q END AS percent FROM q0),
side AS (SELECT m, unnest(range(0, (m + 7) // 8 * 8)) AS o FROM (SELECT DISTINCT m FROM q)),
lv AS (SELECT volume_id, z, q.m, p.o AS x, s2.o AS y, {levels} FROM q JOIN side p ON p.m = q.m JOIN side s2 ON s2.m = q.m JOIN now USING (volume_id, z) WHERE now.x = least(p.o, q.m - 1) AND now.y = least(s2.o, q.m - 1)),
y3 AS (SELECT volume_id, z, x, y, unnest([0,1,2]) AS c, unnest([{y}-128, {cb}, {cr}]) AS v FROM lv),
f1 AS (SELECT volume_id, z, c, x//8 AS bx, k, y, sum(w*v) AS v FROM y3 JOIN basis ON i=x%8 GROUP BY ALL),
f2 AS (SELECT volume_id, z, c, bx, f1.k, y//8 AS bq, basis.k AS l, sum(w*v) AS v FROM f1 JOIN basis ON i=y%8 GROUP BY ALL),
h AS (SELECT volume_id, z, c, bx, k, bq, l, round_even(round(v/{quant},9),0)*{quant} AS v FROM f2 JOIN q USING (volume_id, z)),
b1 AS (SELECT volume_id, z, c, bx*8+i AS x, bq, l, sum(w*v) AS v FROM h JOIN basis USING (k) GROUP BY ALL),
b2 AS (SELECT volume_id, z, c, x, bq*8+i AS y, sum(w*v) AS v FROM b1 JOIN basis ON basis.k=l GROUP BY ALL),
o AS (SELECT volume_id, z, x, y, max(v+128) FILTER (WHERE c=0) AS c0, max(v) FILTER (WHERE c=1) AS c1, max(v) FILTER (WHERE c=2) AS c2 FROM b2 GROUP BY ALL),
coded AS (SELECT volume_id, z, m, x, y, {out} FROM o JOIN q USING (volume_id, z) WHERE x < m AND y < m)"""


KINDS = {
    degrade.blur: "blur",
    degrade.rescale: "rescale",
    degrade.shrink: "shrink",
    degrade.fit: "fit",
    degrade.halve: "halve",
    degrade.keep: "keep",
    degrade.NOISE: "noise",
    degrade.SHOT: "shot",
    degrade.SPECKLE: "speckle",
    degrade.CODER: "coder",
}


def recipe_sql(recipe: degrade.Recipe, turns: str, sf: int, seed: int, start: str) -> str:
    """CTEs that end in ``played`` (volume_id, z, m, x, y, r, g, b); ``start`` ends in ``img`` with the same columns but m."""
    actions = [*recipe.shuffled, *recipe.opening, *recipe.closing]
    of = {KINDS[a.step]: a for a in actions}
    chance = of["shrink"].params[0] if "shrink" in of else 1.0
    kinds = []
    for i, action in enumerate(actions):
        kind = KINDS[action.step]
        taken = [f"u7 < {action.chance}"] * (action.chance < 1) + ["sf = 4"] * (kind == "halve")
        kinds.append(f"WHEN {i} THEN " + (f"CASE WHEN {' AND '.join(taken)} THEN '{kind}' ELSE 'keep' END" if taken else f"'{kind}'"))
    uniforms = ", ".join(_step_draw(seed, i, j) for i in range(len(actions)) for j in range(degrade.DRAWS_PER_STEP))
    parts = [_resampling_sql(chance), _filter_sql(chance, bool(of["blur"].params)), _noise_part_sql(*(of["noise"].params or (2, 25))), _coder_part_sql(*(of["coder"].params or (30, 95)))]
    made = ["resized", "filtered", "noised", "coded"]
    if "shot" in of:
        parts.append(_shot_part_sql())
        made.append("shot")
    each = f"SELECT volume_id, z, m, x, y, {', '.join(RGB)} FROM"
    changed = " UNION ALL ".join(f"{each} {name}" for name in made)
    return f"""{start},
basis AS (SELECT a.range AS k, b.range AS i, cos((2*b.range+1)*a.range*pi()/16)/2*CASE WHEN a.range=0 THEN 1/sqrt(2) ELSE 1 END AS w FROM range(0,8) a, range(0,8) b),
dr AS MATERIALIZED (SELECT volume_id, z, {_word(seed)} AS w0, {turns} AS turns, [{uniforms}] AS us FROM (SELECT DISTINCT volume_id, z FROM img)),
s AS (SELECT CAST(0 AS BIGINT) AS t, volume_id, z, CAST({SIDE} AS BIGINT) AS m, CAST({SIDE} AS BIGINT) AS base, CAST({sf} AS BIGINT) AS sf, CAST(0 AS BIGINT) AS wi, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM img
UNION ALL (WITH now AS (SELECT * FROM s WHERE t < {len(actions)}),
heads AS (SELECT DISTINCT t, volume_id, z, m, base, sf, wi FROM now),
a1 AS (SELECT *, turns[t + 1] AS a FROM heads JOIN dr USING (volume_id, z)),
a2 AS (SELECT * EXCLUDE (turns, us), {', '.join(f'us[a * 8 + {j + 1}] AS u{j}' for j in range(8))} FROM a1),
act AS (SELECT *, CASE a {' '.join(kinds)} END AS kind FROM a2),
{(',' + chr(10)).join(parts)},
held AS (SELECT volume_id, z, now.m, x, y, r, g, b FROM now JOIN act USING (volume_id, z) WHERE kind = 'keep')
SELECT act.t + 1, volume_id, z, e.m, CASE WHEN kind = 'shrink' THEN act.m ELSE base END, CASE WHEN kind = 'halve' THEN 2 ELSE sf END, CASE WHEN kind IN ('noise', 'speckle', 'shot') THEN wi + 1 ELSE wi END, x, y, r, g, b
 FROM ({changed} UNION ALL {each} held) e JOIN act USING (volume_id, z))),
played AS (SELECT volume_id, z, m, x, y, r, g, b FROM s WHERE t = {len(actions)})"""


COLOURS = "img AS (SELECT volume_id, z, x, y, max(v) FILTER (WHERE ch=0) AS r, max(v) FILTER (WHERE ch=1) AS g, max(v) FILTER (WHERE ch=2) AS b FROM {src} GROUP BY ALL)"
BYTES = f"{fx.EVENT_RGB_SQL}, whole AS (SELECT * REPLACE (round_even(v*255,0)/255.0::DOUBLE AS v) FROM event_rgb), {COLOURS.format(src='whole')}"
ROUNDED = "round(avg(v),6) + 0.0 AS mean, round(min(v),6) + 0.0 AS low, round(max(v),6) + 0.0 AS high"


def whole_sql(recipe: degrade.Recipe, seed: int, sf: int) -> str:
    """Byte images, played and given back as bytes."""
    cells = "SELECT volume_id, z, m, round_even(unnest([r, g, b])*255,0) AS v FROM played"
    return f"WITH RECURSIVE {recipe_sql(recipe, mixed_turns(seed), sf, seed, BYTES)} SELECT volume_id, z, CAST(m AS INT) AS h, CAST(m AS INT) AS w, {ROUNDED} FROM ({cells}) GROUP BY ALL"


def patch_sql(recipe: degrade.Recipe, turns: str, seed: int, sf: int, size: int, start: str) -> str:
    """The drawn window of the played image, and the sum of the window of the large one that belongs to it."""
    room = f"({SIDE // sf} - {size} + 1)"
    at = f"place AS (SELECT volume_id, z, {integer_sql(seed, 'lq/x', '0', room, IMAGE_KEY)} AS top, {integer_sql(seed, 'lq/y', '0', room, IMAGE_KEY)} AS beside FROM dr)"
    inside = lambda f: f"x >= top*{f} AND x < (top+{size})*{f} AND y >= beside*{f} AND y < (beside+{size})*{f}"
    low = f"low AS (SELECT volume_id, z, unnest([r, g, b]) AS v FROM played JOIN place USING (volume_id, z) WHERE {inside(1)})"
    high = f"big AS (SELECT volume_id, z, CAST(3*count(*) AS INT) AS hq_cells, round(sum(r+g+b),6) + 0.0 AS hq_sum FROM img JOIN place USING (volume_id, z) WHERE {inside(sf)} GROUP BY ALL)"
    return f"""WITH RECURSIVE {recipe_sql(recipe, turns, sf, seed, start)}, {at}, {low}, {high}
SELECT volume_id, z, {size} AS h, {size} AS w, {ROUNDED}, any_value(hq_cells) AS hq_cells, any_value(hq_sum) AS hq_sum FROM low JOIN big USING (volume_id, z) GROUP BY volume_id, z"""


def patches(df):
    total = F.round(F.aggregate("hq", F.lit(0.0), lambda acc, v: acc + v), 6) + 0.0
    return summary(df, F.size("hq").alias("hq_cells"), total.alias("hq_sum"))


def byte_images(spark, sf):
    return fx.event_rgb(spark, sf).withColumn("data", F.transform("data", lambda v: F.rint(v * 255.0)))


def sharpened_sql() -> str:
    """Unsharp mask with a window of 51 cells, wider than the image: weights of (place, source)."""
    both = lambda src, name: (
        f"{name}_a AS (SELECT volume_id, z, o AS x, y, {', '.join(f'sum(w*{c}) AS {c}' for c in RGB)} FROM {src} JOIN sm ON i = x GROUP BY ALL), "
        f"{name} AS (SELECT volume_id, z, x, o AS y, {', '.join(f'sum(w*{c}) AS {c}' for c in RGB)} FROM {name}_a JOIN sm ON i = y GROUP BY ALL)"
    )
    res = ", ".join(f"c.{c} - s.{c} AS d{c}, c.{c} AS {c}0, CASE WHEN abs(c.{c} - s.{c})*255 > 10 THEN 1.0::DOUBLE ELSE 0 END AS {c}" for c in RGB)
    out = ", ".join(f"soft.{c}*greatest(least({c}0 + 0.5::DOUBLE*d{c}, 1), 0) + (1 - soft.{c})*{c}0 AS {c}" for c in RGB)
    return f"""{fx.EVENT_RGB_SQL}, {COLOURS.replace('img AS', 'clear AS', 1).format(src='event_rgb')},
sm0 AS (SELECT range - 25 AS d, exp(-(range-25)*(range-25)/(2*8.0::DOUBLE*8.0::DOUBLE)) AS w FROM range(0,51)), sm1 AS (SELECT d, w/(SELECT sum(w) FROM sm0) AS w FROM sm0),
sm AS (SELECT o, {_mirror('o + d', str(SIDE))} AS i, sum(w) AS w FROM (SELECT range AS o FROM range(0,{SIDE})), sm1 GROUP BY ALL),
{both('clear', 'smooth')}, mask AS (SELECT c.volume_id, c.z, c.x, c.y, {res} FROM clear c JOIN smooth s USING (volume_id, z, x, y)),
{both('mask', 'soft')}, img AS (SELECT volume_id, z, x, y, {out} FROM mask JOIN soft USING (volume_id, z, x, y))"""


@query("d13_degrade_bsrgan", patch_sql(degrade.MIXED, mixed_turns(13), 13, 4, 5, f"{fx.EVENT_RGB_SQL}, {COLOURS.format(src='event_rgb')}"))
def d13_degrade_bsrgan(spark, sf):
    return patches(degrade.degrade_bsrgan(fx.event_rgb(spark, sf), sf=4, lq_patchsize=5, seed=13))


@query("d14_degrade_variant", whole_sql(degrade.MIXED, 14, 4))
def d14_degrade_variant(spark, sf):
    return summary(degrade.degrade_variant(byte_images(spark, sf), sf=4, seed=14))


@query("d15_degrade_plus", patch_sql(degrade.TWO_ROUNDS, two_round_turns(15, 0.5), 15, 2, 10, sharpened_sql()))
def d15_degrade_plus(spark, sf):
    return patches(degrade.degrade_plus(fx.event_rgb(spark, sf), sf=2, lq_patchsize=10, seed=15))


@query("d16_degrade_light", whole_sql(degrade.MIXED_LIGHT, 16, 4))
def d16_degrade_light(spark, sf):
    return summary(degrade.degrade_light(byte_images(spark, sf), sf=4, seed=16))
