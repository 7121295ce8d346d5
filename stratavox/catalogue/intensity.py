"""Row-local intensity and colour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.registry import query
from stratavox.functions import color, draws, pixel, text, vectors
from stratavox.operators import normalize as nz
from stratavox.operators import pairing

V = "WITH " + fx.VOXELS_SQL
KEY = "volume_id, z, x, y"


def _out(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


@query("p1_clip", f"{V} SELECT {KEY}, round(greatest(least(v, 0.1), -0.1), 6) + 0.0 AS v FROM voxels")
def p1_clip(spark, sf):
    return _out(fx.voxels(spark, sf).withColumn("v", pixel.clip(F.col("v"), -0.1, 0.1)), "v")


PCLIP = """q AS (SELECT volume_id, quantile_cont(v, 0.001) AS p0, quantile_cont(v, 0.999) AS p1 FROM voxels GROUP BY volume_id),
clipped AS (SELECT volume_id, z, x, y, greatest(least(v, p1), p0) AS v FROM voxels JOIN q USING (volume_id))"""


@query("p2_percentile_clip", f"{V}, {PCLIP} SELECT {KEY}, round(v, 6) + 0.0 AS v FROM clipped")
def p2_percentile_clip(spark, sf):
    return _out(nz.percentile_clip(fx.voxels(spark, sf), 0.1, 99.9), "v")


STATS = "s AS (SELECT volume_id, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd FROM voxels GROUP BY volume_id)"


@query("p3_normalize_01", f"{V}, {STATS} SELECT {KEY}, round((v-lo)/(hi-lo), 6) + 0.0 AS v FROM voxels JOIN s USING (volume_id)")
def p3_normalize_01(spark, sf):
    return _out(nz.normalize(fx.voxels(spark, sf), "01"), "v")


@query("p4_normalize_11", f"{V}, {STATS} SELECT {KEY}, round((v-lo)/(hi-lo)*2-1, 6) + 0.0 AS v FROM voxels JOIN s USING (volume_id)")
def p4_normalize_11(spark, sf):
    return _out(nz.normalize(fx.voxels(spark, sf), "11"), "v")


@query("p5_normalize_none", f"{V} SELECT {KEY}, round(v, 6) + 0.0 AS v FROM voxels")
def p5_normalize_none(spark, sf):
    return _out(nz.normalize(fx.voxels(spark, sf), "00"), "v")


@query(
    "p6_z_rescale",
    f"""WITH {fx.EVENTS_SQL}, lg AS (SELECT volume_id, z, x, y, log10(v+1) AS v FROM event_voxels),
s AS (SELECT volume_id, avg(v) AS mu, stddev_pop(v) AS sd FROM lg GROUP BY volume_id)
SELECT {KEY}, round(greatest(least((v-mu)/sd, 6), -6)/6, 6) + 0.0 AS v FROM lg JOIN s USING (volume_id)""",
)
def p6_z_rescale(spark, sf):
    return _out(nz.z_rescale(fx.event_voxels(spark, sf), 6.0), "v")


@query("p7_norm_01", f"{V}, {STATS} SELECT {KEY}, round((v-lo)/(hi-lo), 6) + 0.0 AS v FROM voxels JOIN s USING (volume_id)")
def p7_norm_01(spark, sf):
    return _out(nz.norm_01(fx.voxels(spark, sf)), "v")


@query(
    "p8_floor_rescale",
    f"""{V}, f AS (SELECT volume_id, z, x, y, greatest(v, -0.1) AS v FROM voxels),
s AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM f GROUP BY volume_id)
SELECT {KEY}, round((v-lo)/(hi-lo)*2-1, 6) + 0.0 AS v FROM f JOIN s USING (volume_id)""",
)
def p8_floor_rescale(spark, sf):
    return _out(nz.floor_rescale(fx.voxels(spark, sf), -0.1), "v")


@query(
    "p9_to_8bit",
    f"""{V}, {STATS}, lev AS (SELECT {KEY}, CAST(floor((v-lo)/(hi-lo)*255) AS INT) AS g FROM voxels JOIN s USING (volume_id))
SELECT {KEY}, g AS r, g, g AS b FROM lev""",
)
def p9_to_8bit(spark, sf):
    return nz.to_8bit(fx.voxels(spark, sf))


PX = "WITH " + fx.PIXELS_SQL


@query(
    "p10_uint_single",
    f"""{PX}, lv AS (SELECT CAST(round_even(greatest(least(r,1),0)*255,0) AS INT) AS r8, CAST(round_even(greatest(least(g,1),0)*255,0) AS INT) AS g8,
CAST(round_even(greatest(least(b,1),0)*65535,0) AS INT) AS b16 FROM pixels)
SELECT r8, g8, b16, round(r8/255.0::DOUBLE, 6) AS r, round(g8/255.0::DOUBLE, 6) AS g, round(b16/65535.0::DOUBLE, 6) AS b, count(*) AS n FROM lv GROUP BY ALL""",
)
def p10_uint_single(spark, sf):
    px = fx.pixels(spark, sf)
    levels = px.select(
        pixel.unsigned(F.col("r")).alias("r8"),
        pixel.unsigned(F.col("g")).alias("g8"),
        pixel.unsigned(F.col("b"), 16).alias("b16"),
    )
    back = levels.withColumns(
        {"r": pixel.single(F.col("r8")), "g": pixel.single(F.col("g8")), "b": pixel.single(F.col("b16"), 16)}
    )
    return _out(back, "r", "g", "b").groupBy("r8", "g8", "b16", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p11_tensor2im",
    f"""{V}, lv AS (SELECT {KEY}, CAST(floor((greatest(least(v*4,1),-1)+1)/2*255) AS INT) AS g FROM voxels) SELECT {KEY}, g AS r, g, g AS b FROM lv""",
)
def p11_tensor2im(spark, sf):
    level = pixel.tensor_to_level(F.col("v") * 4)
    gray = fx.voxels(spark, sf).select("volume_id", "z", "x", "y", level.alias("level"))
    rgb = color.channel_convert({"gray": F.col("level")}, "RGB")
    return gray.select("volume_id", "z", "x", "y", *[c.alias(n) for n, c in rgb.items()])


@query(
    "p12_tensor2img",
    f"""{PX} SELECT CAST(round_even((greatest(least(b*2-1,0.9),-0.9)+0.9)/1.8*255,0) AS INT) AS c0, CAST(round_even((greatest(least(g*2-1,0.9),-0.9)+0.9)/1.8*255,0) AS INT) AS c1,
CAST(round_even((greatest(least(r*2-1,0.9),-0.9)+0.9)/1.8*255,0) AS INT) AS c2, count(*) AS n FROM pixels GROUP BY ALL""",
)
def p12_tensor2img(spark, sf):
    px = fx.pixels(spark, sf)
    bgr = [pixel.tensor_to_image(F.col(c) * 2 - 1, -0.9, 0.9).alias(f"c{i}") for i, c in enumerate("bgr")]
    return px.select(*bgr).groupBy("c0", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_save_range_norm",
    f"""{V}, {STATS}, {fx.EVENTS_SQL} SELECT {KEY}, round(CASE WHEN lo < 0 OR hi > 1 THEN (v-lo)/(hi-lo) ELSE v END, 6) + 0.0 AS v FROM voxels JOIN s USING (volume_id)""",
)
def p13_save_range_norm(spark, sf):
    return _out(nz.save_range_norm(fx.voxels(spark, sf)), "v")


@query(
    "p14_nan_to_num",
    f"""{V} SELECT {KEY}, CASE WHEN abs(v) < 0.001 THEN 0.0 WHEN v > 0.3 THEN 1.7976931348623157e308 WHEN v < -0.3 THEN -1.7976931348623157e308 ELSE round(v, 6) + 0.0 END AS v FROM voxels""",
)
def p14_nan_to_num(spark, sf):
    v = F.col("v")
    broken = (
        F.when(F.abs(v) < 0.001, F.lit(float("nan")))
        .when(v > 0.3, F.lit(float("inf")))
        .when(v < -0.3, F.lit(float("-inf")))
        .otherwise(F.round(v, 6) + 0.0)
    )
    return fx.voxels(spark, sf).withColumn("v", broken).withColumn("v", pixel.nan_to_num(F.col("v")))


@query("p16_permute", f"{V} SELECT volume_id, y AS z, z AS x, x AS y, round(v, 6) + 0.0 AS v FROM voxels")
def p16_permute(spark, sf):
    from stratavox.operators.tiling import permute

    return _out(permute(fx.voxels(spark, sf), (2, 0, 1)), "v")


@query(
    "p17_rgb2ycbcr",
    f"""{PX}, c AS (SELECT r, g, b, CAST(round_even(r*255,0) AS INT) AS ri, CAST(round_even(g*255,0) AS INT) AS gi, CAST(round_even(b*255,0) AS INT) AS bi FROM pixels)
SELECT round((r*255*65.481+g*255*128.553+b*255*24.966)/255/255+16/255.0::DOUBLE, 6) AS "Y", round((r*255*-37.797+g*255*-74.203+b*255*112)/255/255+128/255.0::DOUBLE, 6) AS "Cb",
round((r*255*112+g*255*-93.786+b*255*-18.214)/255/255+128/255.0::DOUBLE, 6) AS "Cr",
CAST(round_even((ri*65.481::DOUBLE+gi*128.553::DOUBLE+bi*24.966::DOUBLE)/255+16,0) AS INT) AS "Y8", count(*) AS n FROM c GROUP BY ALL""",
)
def p17_rgb2ycbcr(spark, sf):
    px = fx.pixels(spark, sf)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    unit = color.rgb_to_ycbcr(r, g, b)
    byte = color.bgr_to_ycbcr(*[pixel.unsigned(c) for c in (b, g, r)], levels=True)
    out = px.select(*[F.round(c, 6).alias(n) for n, c in unit.items()], byte["Y"].alias("Y8"))
    return out.groupBy("Y", "Cb", "Cr", "Y8").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p18_ycbcr2rgb",
    f"""{PX} SELECT round(((r*255*0.00456621+b*255*0.00625893)*255-222.921)/255, 6) + 0.0 AS r, round(((r*255*0.00456621-g*255*0.00153632-b*255*0.00318811)*255+135.576)/255, 6) + 0.0 AS g,
round(((r*255*0.00456621+g*255*0.00791071)*255-276.836)/255, 6) + 0.0 AS b, count(*) AS n FROM pixels GROUP BY ALL""",
)
def p18_ycbcr2rgb(spark, sf):
    rgb = color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    out = fx.pixels(spark, sf).select(*[(F.round(c, 6) + 0.0).alias(n) for n, c in rgb.items()])
    return out.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p19_channel_convert",
    f"""{PX} SELECT round(r*0.299+g*0.587+b*0.114, 6) AS gray, round((r*255*65.481+g*255*128.553+b*255*24.966)/255/255+16/255.0::DOUBLE, 6) AS y, round(b, 6) AS c0, round(g, 6) AS c1, round(r, 6) AS c2, count(*) AS n FROM pixels GROUP BY ALL""",
)
def p19_channel_convert(spark, sf):
    rgba = {"r": F.col("r"), "g": F.col("g"), "b": F.col("b"), "a": F.lit(1.0)}
    swapped = color.channel_convert(rgba, "BGR")
    out = fx.pixels(spark, sf).select(
        F.round(color.channel_convert(rgba, "gray")["gray"], 6).alias("gray"),
        F.round(color.channel_convert(rgba, "y")["y"], 6).alias("y"),
        *[F.round(c, 6).alias(f"c{i}") for i, c in enumerate(swapped.values())],
    )
    return out.groupBy("gray", "y", "c0", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p20_stack_two_channels",
    f"""{V} SELECT a.volume_id, a.z//2 AS z, a.x, a.y, round(a.v, 6) + 0.0 AS c0, round(b.v, 6) + 0.0 AS c1
FROM voxels a JOIN voxels b ON a.volume_id=b.volume_id AND b.z=a.z+1 AND a.x=b.x AND a.y=b.y WHERE a.z%2=0""",
)
def p20_stack_two_channels(spark, sf):
    even, odd = pairing.interleaved_pair(fx.slices(spark, sf))
    both = pairing.stack_two_channels(even, odd)
    return both.select(
        "volume_id",
        "z",
        "x",
        "y",
        (F.round(F.col("channels")[0], 6) + 0.0).alias("c0"),
        (F.round(F.col("channels")[1], 6) + 0.0).alias("c1"),
    )


@query(
    "p22_l2_normalize",
    """SELECT vec_id, i - 1 AS pos, round(3*e[i]/(sqrt(9*list_sum(list_transform(e, lambda v: v*v)))+1e-7), 6) + 0.0 AS f
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(unnest(range(1,65)) AS INT) AS i FROM embeddings)""",
)
def p22_l2_normalize(spark, sf):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 3)
    unit = fx.table(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize(e).alias("f"))
    return _out(unit.select("vec_id", F.posexplode("f").alias("pos", "f")), "f")


@query(
    "p23_standardize_group",
    """WITH c AS (SELECT vec_id, CAST(i-1 AS INT) AS pos, (i-1)//8 AS g, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS i FROM embeddings)),
s AS (SELECT vec_id, g, avg(v) AS mu, stddev_samp(v) AS sd FROM c GROUP BY ALL), w AS (SELECT vec_id, avg(v) AS mu, stddev_samp(v) AS sd FROM c GROUP BY ALL)
SELECT c.vec_id, c.pos, round((c.v-s.mu)/(s.sd+1e-7), 6) + 0.0 AS by_group, round((c.v-w.mu)/(w.sd+1e-5), 6) + 0.0 AS whole FROM c JOIN s USING (vec_id, g) JOIN w ON c.vec_id=w.vec_id""",
)
def p23_standardize_group(spark, sf):
    e = F.col("embedding").cast("array<double>")
    rows = fx.table(spark, sf, "embeddings").select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                vectors.standardize_groups(e, 8, 64).alias("by_group"),
                vectors.standardize_groups(e, 1, 64, eps=1e-5).alias("whole"),
            )
        ).alias("pos", "s"),
    )
    return _out(rows.select("vec_id", "pos", "s.by_group", "s.whole"), "by_group", "whole")


@query(
    "p24_sinusoidal_embedding",
    """WITH t AS (SELECT event_id, hour(ts) AS t FROM events), i AS (SELECT CAST(range AS INT) AS i FROM range(0,4))
SELECT event_id, i AS pos, round(cos(t*exp(-ln(10000)*i/4.0::DOUBLE)), 6) + 0.0 AS e FROM t, i
UNION ALL SELECT event_id, i + 4, round(sin(t*exp(-ln(10000)*i/4.0::DOUBLE)), 6) + 0.0 FROM t, i UNION ALL SELECT event_id, 8, 0.0 FROM t""",
)
def p24_sinusoidal_embedding(spark, sf):
    hours = fx.table(spark, sf, "events").select("event_id", F.hour("ts").alias("t"))
    rows = hours.select("event_id", F.posexplode(vectors.sinusoidal_embedding(F.col("t"), 9)).alias("pos", "e"))
    return _out(rows, "e")


@query(
    "p24_sinusoidal_sine_first",
    """WITH t AS (SELECT event_id, hour(ts) AS t FROM events), i AS (SELECT CAST(range AS INT) AS i FROM range(0,4))
SELECT event_id, i AS pos, round(sin(t*exp(-ln(10000)*i/3.0::DOUBLE)), 6) + 0.0 AS e FROM t, i
UNION ALL SELECT event_id, i + 4, round(cos(t*exp(-ln(10000)*i/3.0::DOUBLE)), 6) + 0.0 FROM t, i""",
)
def p24_sinusoidal_sine_first(spark, sf):
    hours = fx.table(spark, sf, "events").select("event_id", F.hour("ts").alias("t"))
    vec = vectors.sinusoidal_embedding(F.col("t"), 8, sine_first=True)
    return _out(hours.select("event_id", F.posexplode(vec).alias("pos", "e")), "e")


@query(
    "p25_subject_key",
    """SELECT doc_id, replace(b, '_' || list_last(string_split(b, '_')), '') AS subject FROM
(SELECT doc_id, list_last(string_split('scans/' || CAST(doc_id AS VARCHAR) || '_' || source || '_' || lang, '/')) AS b FROM documents)""",
)
def p25_subject_key(spark, sf):
    path = F.concat(F.lit("scans/"), F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit("_"), F.col("lang"))
    return fx.table(spark, sf, "documents").select("doc_id", text.subject_key(path).alias("subject"))


@query(
    "p26_print_profile",
    f"""{V} SELECT volume_id, round(avg(v),6) + 0.0 AS mean, round(min(v),6) + 0.0 AS min, round(max(v),6) + 0.0 AS max, round(quantile_cont(v,0.5),6) + 0.0 AS median,
round(stddev_pop(v),6) AS std, max(z)+1 AS nz, max(x)+1 AS nx, max(y)+1 AS ny FROM voxels GROUP BY volume_id""",
)
def p26_print_profile(spark, sf):
    return _out(nz.profile(fx.voxels(spark, sf)), "mean", "min", "max", "median", "std")


def colour_matrix(channels: int) -> list[list[float]]:
    """Fixed 3 x channels matrix; entries depend on their place only."""
    seeds = [[draws.numpy_seed(7, "colour", f"{k}:{c}")[0] for c in range(channels)] for k in range(3)]
    return [[s / draws.TWO_32 * 2 - 1 for s in row] for row in seeds]


_ROWS = ["[" + ",".join(f"CAST({w!r} AS DOUBLE)" for w in row) + "]" for row in colour_matrix(64)]


@query(
    "p28_project_to_rgb",
    f"""WITH m AS (SELECT vec_id, {", ".join(f"list_sum(list_transform(range(1,65), lambda i: CAST(embedding[i] AS DOUBLE)*({row})[i])) AS {n}" for n, row in zip("rgb", _ROWS))} FROM embeddings),
s AS (SELECT min(least(r,g,b)) AS lo, max(greatest(r,g,b)) AS hi FROM m)
SELECT vec_id, round((r-lo)/(hi-lo)*2-1, 6) + 0.0 AS r, round((g-lo)/(hi-lo)*2-1, 6) + 0.0 AS g, round((b-lo)/(hi-lo)*2-1, 6) + 0.0 AS b FROM m, s""",
)
def p28_project_to_rgb(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"))
    return _out(nz.project_to_rgb(rows, colour_matrix(64)), "r", "g", "b")


@query(
    "f_str2bool",
    """SELECT doc_id, source, CASE WHEN quality=1 THEN true ELSE false END AS good, CASE WHEN toxic=1 THEN true ELSE false END AS bad FROM labels JOIN documents USING (doc_id)""",
)
def f_str2bool(spark, sf):
    """Boolean words parsed from the label columns: 1 / 0 and Yes / No."""
    labels = fx.table(spark, sf, "labels").select(
        "doc_id",
        pixel.parse_bool(F.col("quality").cast("string")).alias("good"),
        pixel.parse_bool(F.when(F.col("toxic") == 1, "Yes").otherwise("No")).alias("bad"),
    )
    return labels.join(fx.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
