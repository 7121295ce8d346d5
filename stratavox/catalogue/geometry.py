"""Tiling, cropping and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.registry import query
from stratavox.functions import text
from stratavox.operators import pooling, tiling
from stratavox.plans.patch_preparation import mean_of, prepare_patches
from stratavox.session import settle

V = "WITH " + fx.VOXELS_SQL
E = "WITH " + fx.EVENTS_SQL
N = "n AS (SELECT volume_id, max(z)+1 AS nz, max(x)+1 AS nx, max(y)+1 AS ny FROM voxels GROUP BY volume_id)"
EN = "n AS (SELECT volume_id, max(z)+1 AS nz, max(x)+1 AS nx, max(y)+1 AS ny FROM event_voxels GROUP BY volume_id)"
RV = "round(v, 6) + 0.0 AS v"
KEY = "volume_id, z, x, y"


def draw_sql(seed: int, stream: str, *key: str) -> str:
    text_ = "concat_ws(':', '%d', '%s', %s)" % (seed, stream, ", ".join(f"CAST({k} AS VARCHAR)" for k in key))
    return f"(CAST(concat('0x', substr(md5({text_}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def integer_sql(seed: int, stream: str, low: str, high: str, *key: str) -> str:
    return f"({low} + CAST(floor({draw_sql(seed, stream, *key)} * ({high} - {low})) AS INT))"


def _out(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names or ("v",)})


@query(
    "t1_tile_grid",
    f"""{V}, {N} SELECT volume_id, z//4 AS gz, x//3 AS gx, y//4 AS gy, z%4 AS z, x%3 AS x, y%4 AS y, {RV} FROM voxels JOIN n USING (volume_id)
WHERE (z//4+1)*4 <= nz AND (x//3+1)*3 <= nx AND (y//4+1)*4 <= ny""",
)
def t1_tile_grid(spark, sf):
    return _out(tiling.tile_grid(fx.voxels(spark, sf), (4, 3, 4), (4, 3, 4), sizes=fx.sizes(spark, sf)))


@query(
    "t1_tile_grid_step",
    f"""{E}, {EN}, g AS (SELECT CAST(a.range AS INT) AS gz, CAST(b.range AS INT) AS gx, CAST(c.range AS INT) AS gy FROM range(0,30) a, range(0,24) b, range(0,24) c)
SELECT volume_id, gz, gx, gy, z-gz*3 AS z, x-gx*6 AS x, y-gy*8 AS y, {RV} FROM event_voxels JOIN n USING (volume_id) JOIN g ON
z >= gz*3 AND z < gz*3+5 AND x >= gx*6 AND x < gx*6+8 AND y >= gy*8 AND y < gy*8+8
WHERE gz < nz//3 AND gz*3+5 <= nz AND gx < nx//6 AND gx*6+8 <= nx AND gy < ny//8 AND gy*8+8 <= ny""",
)
def t1_tile_grid_step(spark, sf):
    return _out(tiling.tile_grid(fx.event_voxels(spark, sf), (5, 8, 8), (3, 6, 8), origin="step", sizes=fx.event_sizes(spark, sf)))


@query(
    "t1_tile_grid_mixed",
    f"""{E}, {EN} SELECT volume_id, z//5 AS gz, x//8 AS gx, y//8 AS gy, z%5 AS z, x%8 AS x, y%8 AS y, {RV} FROM event_voxels JOIN n USING (volume_id)
WHERE z//5 < nz//10 AND (z//5+1)*5 <= nz AND x//8 < nx//12 AND y//8 < ny//8""",
)
def t1_tile_grid_mixed(spark, sf):
    """Step larger than the block: counts follow the step, origins the block."""
    return _out(tiling.tile_grid(fx.event_voxels(spark, sf), (5, 8, 8), (10, 12, 8), sizes=fx.event_sizes(spark, sf)))


@query(
    "p15_keep_bright_patches",
    f"""{E}, s AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM event_voxels GROUP BY volume_id), t AS (SELECT volume_id, z//3 AS gz, x//4 AS gx, y//4 AS gy, z, x, y, v, (v-lo)/(hi-lo)*2-1 AS nv FROM event_voxels JOIN s USING (volume_id)),
k AS (SELECT volume_id, gz, gx, gy, avg(nv) AS mean_v FROM t GROUP BY ALL HAVING avg(nv) > -0.98)
SELECT volume_id, gz, gx, gy, round(mean_v, 6) AS mean_v, round(sum(v), 3) AS other_sum, count(*) AS n FROM t JOIN k USING (volume_id, gz, gx, gy) GROUP BY ALL""",
)
def p15_keep_bright_patches(spark, sf):
    """Bright patches of the normalised volume; the raw volume keeps the same places."""
    raw = settle(fx.event_slices(spark, sf))
    keys = ["volume_id", "gz", "gx", "gy"]
    kept, other = prepare_patches([raw, raw], (3, 4, 4), ["11", None], bright=-0.98)
    sums = other.select(*keys, F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("other_sum"), F.size("data").cast("long").alias("n"))
    return kept.select(*keys, F.round(mean_of(), 6).alias("mean_v")).join(sums, keys).select(
        *keys, "mean_v", F.round("other_sum", 3).alias("other_sum"), "n"
    )


OVERLAP = """o AS (SELECT CAST(unnest([0,6,12,16]) AS INT) AS o, unnest(range(0,4)) AS k),
tiles AS (SELECT volume_id, z, CAST(a.k*4+b.k AS INT) AS i, a.o AS top, b.o AS left_, x-a.o AS x, y-b.o AS y, v FROM event_voxels JOIN o a ON x>=a.o AND x<a.o+8 JOIN o b ON y>=b.o AND y<b.o+8)"""


@query("t2_tile_overlap", f"""{E}, {OVERLAP} SELECT volume_id, z, i, top, left_ AS "left", x, y, {RV} FROM tiles""")
def t2_tile_overlap(spark, sf):
    from stratavox.operators.layout import slices_to_voxels

    tiles = tiling.tile_overlap(fx.event_slices(spark, sf), 8, 2, 10)
    return _out(slices_to_voxels(tiles))


@query("s4_name_split_tiles", f"""{E}, {OVERLAP} SELECT DISTINCT format('block{{:d}}day{{:02d}}_s{{:04d}}', volume_id, z, i) AS name, z, i FROM tiles""")
def s4_name_split_tiles(spark, sf):
    tiles = tiling.tile_overlap(fx.event_slices(spark, sf), 8, 2, 10)
    stem = F.format_string("block%dday%02d", F.col("volume_id"), F.col("z"))
    return tiles.select(text.tile_name(stem, F.col("i")).alias("name"), "z", "i")


@query(
    "s5_split_imageset",
    f"""{E}, {OVERLAP}, images AS (SELECT format('block{{:d}}day{{:02d}}', volume_id, z) AS stem, i, count(*) AS n, round(sum(v),3) AS total FROM tiles GROUP BY ALL)
SELECT stem || format('_s{{:04d}}', i) AS name, n, total FROM images""",
)
def s5_split_imageset(spark, sf):
    """Catalog -> overlap tiles -> names and content, as written by the sink."""
    from stratavox.sources.images import split_imageset

    images = fx.event_slices(spark, sf).withColumn("path", F.format_string("days/block%dday%02d.tif", F.col("volume_id"), F.col("z")))
    tiles = split_imageset(images, 8, 2, 10)
    total = F.aggregate("data", F.lit(0.0), lambda acc, v: acc + v)
    return tiles.select("name", F.size("data").cast("long").alias("n"), F.round(total, 3).alias("total"))


@query("t3_tile_square", f"{V} SELECT volume_id, z, x//4 AS gx, y//4 AS gy, x%4 AS x, y%4 AS y, {RV} FROM voxels")
def t3_tile_square(spark, sf):
    return _out(tiling.tile_square(fx.voxels(spark, sf), 4))


@query("t4_center_crop", f"{E} SELECT volume_id, z, x-7 AS x, y-5 AS y, {RV} FROM event_voxels WHERE x >= 7 AND x < 16 AND y >= 5 AND y < 19")
def t4_center_crop(spark, sf):
    return _out(tiling.center_crop(fx.event_voxels(spark, sf), 9, 14, sizes=fx.event_sizes(spark, sf)))


@query(
    "t5_random_crop",
    f"""{V}, {N}, d AS (SELECT volume_id, {integer_sql(11, "crop/x", "0", "nx-5+1", "volume_id")} AS t, {integer_sql(11, "crop/y", "0", "ny-4+1", "volume_id")} AS l FROM n)
SELECT volume_id, z, x-t AS x, y-l AS y, {RV} FROM voxels JOIN d USING (volume_id) WHERE x>=t AND x<t+5 AND y>=l AND y<l+4""",
)
def t5_random_crop(spark, sf):
    return _out(tiling.random_crop(fx.voxels(spark, sf), 5, 4, seed=11, sizes=fx.sizes(spark, sf)))


@query(
    "t6_paired_random_crop",
    f"""{E}, d AS (SELECT DISTINCT volume_id, z, {integer_sql(3, "pair/x", "0", "12-5+1", "volume_id", "z")} AS t, {integer_sql(3, "pair/y", "0", "12-5+1", "volume_id", "z")} AS l FROM event_voxels),
lo AS (SELECT volume_id, z, x//2 AS x, y//2 AS y, avg(v) AS v FROM event_voxels GROUP BY ALL)
SELECT 'low' AS side, volume_id, z, x-t AS x, y-l AS y, {RV} FROM lo JOIN d USING (volume_id, z) WHERE x>=t AND x<t+5 AND y>=l AND y<l+5
UNION ALL SELECT 'high', volume_id, z, x-t*2, y-l*2, {RV} FROM event_voxels JOIN d USING (volume_id, z) WHERE x>=t*2 AND x<t*2+10 AND y>=l*2 AND y<l*2+10""",
)
def t6_paired_random_crop(spark, sf):
    from stratavox.operators import planes
    from stratavox.operators.layout import slices_to_voxels

    high = fx.event_slices(spark, sf)
    low = planes.resize(high, "area", (12, 12))
    a, b = tiling.paired_random_crop(low, high, 2, 5, seed=3)
    both = a.withColumn("side", F.lit("low")).unionByName(b.withColumn("side", F.lit("high")))
    return _out(slices_to_voxels(both).select("side", "volume_id", "z", "x", "y", "v"))


@query(
    "t7_crop_z",
    f"""{V}, {N}, d AS (SELECT volume_id, {integer_sql(5, "cropz", "0", "greatest(nz-16,1)", "volume_id")} AS s FROM n)
SELECT volume_id, z-s AS z, x, y, {RV} FROM voxels JOIN d USING (volume_id) WHERE z>=s AND z<s+16""",
)
def t7_crop_z(spark, sf):
    return _out(tiling.crop_z(fx.voxels(spark, sf), 16, seed=5, sizes=fx.sizes(spark, sf)))


@query(
    "t8_stride_z",
    f"""{V}, d AS (SELECT DISTINCT volume_id, {integer_sql(6, "stridez", "0", "3", "volume_id")} AS s FROM stack)
SELECT volume_id, (z-s)//3 AS z, x, y, {RV} FROM voxels JOIN d USING (volume_id) WHERE z>=s AND (z-s)%3=0""",
)
def t8_stride_z(spark, sf):
    return _out(tiling.stride_z(fx.voxels(spark, sf), 3, seed=6, sizes=fx.sizes(spark, sf)))


@query(
    "t9_area_downsample_z",
    f"""{V}, {N}, b AS (SELECT volume_id, nz, CAST(unnest(range(0, nz//4)) AS INT) AS i FROM n)
SELECT volume_id, i AS z, x, y, round(avg(v), 6) + 0.0 AS v FROM voxels JOIN b USING (volume_id) WHERE z >= i*nz//(nz//4) AND z < -((-(i+1)*nz)//(nz//4)) + CASE WHEN (i+1)*nz % (nz//4) > 0 THEN 1 ELSE 0 END GROUP BY ALL""",
)
def t9_area_downsample_z(spark, sf):
    return _out(pooling.area_downsample_z(fx.voxels(spark, sf), 4, sizes=fx.sizes(spark, sf)))


@query("t10_modcrop", f"{V} SELECT {KEY}, {RV} FROM voxels WHERE x < 6 AND y < 6")
def t10_modcrop(spark, sf):
    return _out(tiling.modcrop(fx.voxels(spark, sf), 3, sizes=fx.sizes(spark, sf)))


@query("t11_shave", f"{V} SELECT volume_id, z, x-2 AS x, y-2 AS y, {RV} FROM voxels WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6")
def t11_shave(spark, sf):
    return _out(tiling.shave(fx.voxels(spark, sf), 2, sizes=fx.sizes(spark, sf)))


_D = {
    0: ("x", "y"),
    1: ("y", "x"),
    2: ("7-x", "y"),
    3: ("y", "7-x"),
    4: ("x", "7-y"),
    5: ("7-y", "x"),
    6: ("7-x", "7-y"),
    7: ("7-y", "7-x"),
}


@query(
    "t12_dihedral",
    f"""{V} """ + " UNION ALL ".join(f"SELECT {m} AS mode, volume_id, z, {a} AS x, {b} AS y, {RV} FROM voxels" for m, (a, b) in _D.items()),
)
def t12_dihedral(spark, sf):
    """All eight modes of every slice in one scan."""
    modes = fx.voxels(spark, sf).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in range(8)])))
    return _out(tiling.dihedral(modes, F.col("mode"), sizes=fx.sizes(spark, sf)))


@query(
    "t13_augment_list",
    f"""{V}, c AS (SELECT DISTINCT volume_id, {draw_sql(8, "hflip", "volume_id")} < 0.5 AS hf, {draw_sql(8, "vflip", "volume_id")} < 0.5 AS vf, {draw_sql(8, "rot90", "volume_id")} < 0.5 AS rt FROM stack),
m AS (SELECT volume_id, z, CASE WHEN vf THEN 7-x ELSE x END AS r, CASE WHEN hf THEN 7-y ELSE y END AS c, rt, v FROM voxels JOIN c USING (volume_id))
SELECT volume_id, z, CASE WHEN rt THEN c ELSE r END AS x, CASE WHEN rt THEN r ELSE c END AS y, {RV} FROM m""",
)
def t13_augment_list(spark, sf):
    return _out(tiling.augment(fx.voxels(spark, sf), seed=8, sizes=fx.sizes(spark, sf)))


@query(
    "t15_swap_xy",
    f"""{V}, c AS (SELECT DISTINCT volume_id, {draw_sql(9, "swapxy", "volume_id")} < 0.5 AS t FROM stack)
SELECT volume_id, z, CASE WHEN t THEN y ELSE x END AS x, CASE WHEN t THEN x ELSE y END AS y, {RV} FROM voxels JOIN c USING (volume_id)""",
)
def t15_swap_xy(spark, sf):
    return _out(tiling.swap_xy(fx.voxels(spark, sf), seed=9, sizes=fx.sizes(spark, sf)))


@query(
    "t16_six_views",
    f"""{V} """
    + " UNION ALL ".join(
        f"""SELECT volume_id, '{n}' AS "view", {b} AS i, {r} AS "row", {c} AS "col", {RV} FROM voxels""" for n, b, r, c in tiling.SIX_VIEWS
    ),
)
def t16_six_views(spark, sf):
    return _out(tiling.six_views(fx.voxels(spark, sf)))


@query(
    "t17_view_group_random",
    f"""{V}, {N}, g AS (SELECT voxels.*, nz, {integer_sql(2, "viewgroup", "0", "3", "volume_id")} AS g FROM voxels JOIN n USING (volume_id))
SELECT volume_id, 'x_zy' AS "view", false AS flipped, x AS i, z AS "row", y AS col, 0.25::DOUBLE AS weight, {RV} FROM g WHERE g=0
UNION ALL SELECT volume_id, 'x_zy', true, x, nz-1-z, y, 0.25, {RV} FROM g WHERE g=0
UNION ALL SELECT volume_id, 'x_yz', false, x, y, z, 0.25, {RV} FROM g WHERE g=0
UNION ALL SELECT volume_id, 'x_yz', true, x, y, nz-1-z, 0.25, {RV} FROM g WHERE g=0
UNION ALL SELECT volume_id, 'y_zx', false, y, z, x, 0.25, {RV} FROM g WHERE g=1
UNION ALL SELECT volume_id, 'y_zx', true, y, nz-1-z, x, 0.25, {RV} FROM g WHERE g=1
UNION ALL SELECT volume_id, 'y_xz', false, y, x, z, 0.25, {RV} FROM g WHERE g=1
UNION ALL SELECT volume_id, 'y_xz', true, y, x, nz-1-z, 0.25, {RV} FROM g WHERE g=1
UNION ALL SELECT volume_id, 'z_xy', false, z, x, y, 0.5, {RV} FROM g WHERE g=2
UNION ALL SELECT volume_id, 'z_yx', false, z, y, x, 0.5, {RV} FROM g WHERE g=2""",
)
def t17_view_group_random(spark, sf):
    return _out(tiling.view_group_random(fx.voxels(spark, sf), seed=2, sizes=fx.sizes(spark, sf)))


@query("t18_xy_slices", f"{V} SELECT volume_id, z, 8 AS h, 8 AS w, round(sum((x*8+y+1)*v), 6) + 0.0 AS checksum FROM voxels GROUP BY ALL")
def t18_xy_slices(spark, sf):
    from stratavox.operators.layout import voxels_to_slices

    planes = voxels_to_slices(fx.voxels(spark, sf))
    weighted = F.aggregate(
        F.zip_with("data", F.sequence(F.lit(1), F.size("data")), lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v
    )
    return planes.select("volume_id", "z", "h", "w", (F.round(weighted, 6) + 0.0).alias("checksum"))


@query("t19_every_kth", f"{V} SELECT volume_id, (z-4)//8 AS z, x, y, {RV} FROM voxels WHERE z >= 4 AND (z-4)%8=0")
def t19_every_kth(spark, sf):
    return _out(tiling.every_kth(fx.voxels(spark, sf)))


@query(
    "t20_hconcat",
    f"""{V} SELECT volume_id, z//2 AS z, x, y, {RV} FROM voxels WHERE z%2=0 UNION ALL SELECT volume_id, z//2, x, y+8, {RV} FROM voxels WHERE z%2=1""",
)
def t20_hconcat(spark, sf):
    from stratavox.operators.layout import slices_to_voxels
    from stratavox.operators.pairing import interleaved_pair

    a, b = interleaved_pair(fx.slices(spark, sf))
    return _out(tiling.hconcat(slices_to_voxels(a), slices_to_voxels(b), "y", fx.sizes(spark, sf)))


@query("r7_project_z_mean", f"{V}, {N} SELECT volume_id, z//4 AS z, x, y, round(avg(v), 6) + 0.0 AS v FROM voxels JOIN n USING (volume_id) WHERE (z//4+1)*4 <= nz GROUP BY ALL")
def r7_project_z_mean(spark, sf):
    return _out(pooling.project_z(fx.voxels(spark, sf), 4, "mean", sizes=fx.sizes(spark, sf)))


@query("r7_project_z_max", f"{V}, {N} SELECT volume_id, z//4 AS z, x, y, round(max(v), 6) + 0.0 AS v FROM voxels JOIN n USING (volume_id) WHERE (z//4+1)*4 <= nz GROUP BY ALL")
def r7_project_z_max(spark, sf):
    return _out(pooling.project_z(fx.voxels(spark, sf), 4, "max", sizes=fx.sizes(spark, sf)))


@query("r7_project_z_min", f"{V}, {N} SELECT volume_id, z//4 AS z, x, y, round(min(v), 6) + 0.0 AS v FROM voxels JOIN n USING (volume_id) WHERE (z//4+1)*4 <= nz GROUP BY ALL")
def r7_project_z_min(spark, sf):
    return _out(pooling.project_z(fx.voxels(spark, sf), 4, "min", sizes=fx.sizes(spark, sf)))


@query("r8_project_z_sampled", f"{V} SELECT volume_id, (z-2)//8 AS z, x, y, {RV} FROM voxels WHERE z >= 2 AND (z-2)%8=0")
def r8_project_z_sampled(spark, sf):
    return _out(pooling.project_z_sampled(fx.voxels(spark, sf), 4, 2))


@query("r9_max_pool", f"{V}, {N} SELECT volume_id, z//2 AS z, x//2 AS x, y//3 AS y, round(max(v), 6) + 0.0 AS v FROM voxels JOIN n USING (volume_id) WHERE (z//2+1)*2 <= nz AND (y//3+1)*3 <= ny GROUP BY ALL")
def r9_max_pool(spark, sf):
    return _out(pooling.pool(fx.voxels(spark, sf), (2, 2, 3), "max", sizes=fx.sizes(spark, sf)))


@query("r10_avg_pool", f"{V} SELECT volume_id, z, x//2 AS x, y//2 AS y, round(avg(v), 6) + 0.0 AS v FROM voxels GROUP BY ALL")
def r10_avg_pool(spark, sf):
    return _out(pooling.pool(fx.voxels(spark, sf), (1, 2, 2), "mean", sizes=fx.sizes(spark, sf)))


@query(
    "r11_adaptive_pool",
    f"""{V}, b AS (SELECT unnest([0,1,2]) AS i, unnest([0,2,5]) AS s, unnest([3,6,8]) AS e),
p AS (SELECT volume_id, z, a.i AS x, c.i AS y, avg(v) AS v FROM voxels JOIN b a ON x>=a.s AND x<a.e JOIN b c ON y>=c.s AND y<c.e GROUP BY ALL),
c AS (SELECT e.volume_id, e.z//2 AS z, e.x, e.y, e.v AS c0, o.v AS c1 FROM p e JOIN p o ON e.volume_id=o.volume_id AND o.z=e.z+1 AND e.x=o.x AND e.y=o.y WHERE e.z%2=0)
SELECT volume_id, z, x, y, round(c0/(sqrt(c0*c0+c1*c1)+1e-7), 6) + 0.0 AS c0, round(c1/(sqrt(c0*c0+c1*c1)+1e-7), 6) + 0.0 AS c1 FROM c""",
)
def r11_adaptive_pool(spark, sf):
    """3x3 bins of two channels, then unit length across the channels."""
    from stratavox.functions.vectors import l2_normalize

    binned = pooling.adaptive_pool(fx.voxels(spark, sf), {"x": 3, "y": 3}, "mean", sizes=fx.sizes(spark, sf))
    pair = binned.groupBy("volume_id", F.shiftright("z", 1).alias("z"), "x", "y").agg(
        F.max(F.when(F.col("z") % 2 == 0, F.col("v"))).alias("c0"), F.max(F.when(F.col("z") % 2 == 1, F.col("v"))).alias("c1")
    )
    unit = pair.where("c0 IS NOT NULL AND c1 IS NOT NULL").withColumn("f", l2_normalize(F.array("c0", "c1")))
    return _out(unit.select("volume_id", "z", "x", "y", F.col("f")[0].alias("c0"), F.col("f")[1].alias("c1")), "c0", "c1")


@query(
    "r11_global_max_pool",
    f"""{V}, p AS (SELECT volume_id, z, max(v) AS v FROM voxels GROUP BY ALL)
SELECT volume_id, z, round(v, 6) + 0.0 AS v FROM p""",
)
def r11_global_max_pool(spark, sf):
    return _out(pooling.adaptive_pool(fx.voxels(spark, sf), {"x": 1, "y": 1}, "max", sizes=fx.sizes(spark, sf)).drop("x", "y"))


@query("r13_mean_flat", f"{V} SELECT volume_id, z, round(avg(v), 6) + 0.0 AS mean FROM voxels GROUP BY ALL")
def r13_mean_flat(spark, sf):
    return _out(pooling.mean_flat(fx.voxels(spark, sf), ["volume_id", "z"]), "mean")


@query("a4_mean_reference", f"{V} SELECT volume_id, x, y, round(avg(v), 6) + 0.0 AS v FROM voxels GROUP BY ALL")
def a4_mean_reference(spark, sf):
    return _out(pooling.mean_reference(fx.voxels(spark, sf)))
