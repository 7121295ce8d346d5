"""Metric, window and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql
from stratavox.catalogue.registry import query
from stratavox.functions import pixel, vectors
from stratavox.operators import metrics, pairing, pooling, recurrence, tiling

V = "WITH " + fx.VOXELS_SQL
L = "WITH " + fx.LOGITS_SQL
PAIR_SQL = """pairs AS (SELECT a.volume_id, a.z//2 AS z, a.x, a.y, a.v AS a, b.v AS b FROM voxels a JOIN voxels b ON a.volume_id=b.volume_id AND b.z=a.z+1 AND a.x=b.x AND a.y=b.y WHERE a.z%2=0)"""
N = "n AS (SELECT volume_id, max(z)+1 AS nz FROM voxels GROUP BY volume_id)"


def _out(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


def pairs(spark, sf):
    return pairing.voxel_pairs(*pairing.interleaved_pair(fx.slices(spark, sf)))


@query("j4_voxel_pairs", f"{V}, {PAIR_SQL} SELECT volume_id, z, x, y, round(a,6) + 0.0 AS a, round(b,6) + 0.0 AS b FROM pairs")
def j4_voxel_pairs(spark, sf):
    return _out(pairs(spark, sf), "a", "b")


@query("m1_l1_l2", f"{V}, {PAIR_SQL} SELECT volume_id, round(avg(abs(a-b)),6) AS l1, round(avg((a-b)*(a-b)),6) AS l2 FROM pairs GROUP BY ALL")
def m1_l1_l2(spark, sf):
    return _out(metrics.l1_l2(pairs(spark, sf), ["volume_id"]), "l1", "l2")


@query(
    "m2_projected_l1",
    f"""{V}, {N}, p AS (SELECT volume_id, z//8 AS z, x, y, avg(v) AS mean, max(v) AS max, min(v) AS min FROM voxels JOIN n USING (volume_id) WHERE (z//8+1)*8 <= nz GROUP BY ALL),
o AS (SELECT volume_id, z//8 AS z, x, y, v FROM voxels WHERE z%8=0)
SELECT volume_id, round(avg(abs(mean-v)),6) AS mean_l1, round((avg(abs(max-v))+avg(abs(min-v)))/2,6) AS maxmin_l1 FROM p JOIN o USING (volume_id, z, x, y) GROUP BY ALL""",
)
def m2_projected_l1(spark, sf):
    """Projection over uprate * skip = 4 * 2 slices against every 8th slice."""
    vox = fx.voxels(spark, sf)
    keys = ["volume_id", "z", "x", "y"]
    original = tiling.stride_z(tiling.stride_z(vox, 4), 2).withColumnRenamed("v", "o")
    kinds = F.array(*[F.struct(F.lit(k).alias("how"), F.col(k).alias("v")) for k in ("mean", "max", "min")])
    sized = tiling.with_extents(vox, fx.sizes(spark, sf)).where((F.floor(F.col("z") / 8) + 1) * 8 <= F.col("nz"))
    all_three = (
        sized.groupBy("volume_id", F.floor(F.col("z") / 8).cast("int").alias("z"), "x", "y")
        .agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))
        .join(original, keys)
        .select("volume_id", "o", F.explode(kinds).alias("k"))
    )
    gap = F.abs(F.col("k.v") - F.col("o"))

    def of(how):
        return F.avg(F.when(F.col("k.how") == how, gap))

    out = all_three.groupBy("volume_id").agg(of("mean").alias("mean_l1"), ((of("max") + of("min")) / 2).alias("maxmin_l1"))
    return _out(out, "mean_l1", "maxmin_l1")


LEVEL = "CAST(round_even(greatest(least({c}*2+0.5,1),0)*255,0) AS INT)"


@query(
    "m3_psnr",
    f"""{V}, {PAIR_SQL}, l AS (SELECT volume_id, z, {LEVEL.format(c="a")} AS a, {LEVEL.format(c="b")} AS b FROM pairs WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
m AS (SELECT volume_id, z, avg(CAST((a-b)*(a-b) AS DOUBLE)) AS mse FROM l GROUP BY ALL) SELECT volume_id, z, round(20*log10(255/sqrt(mse)),6) AS psnr FROM m""",
)
def m3_psnr(spark, sf):
    levels = pairs(spark, sf).withColumns({c: pixel.unsigned(F.col(c) * 2 + 0.5) for c in "ab"})
    return _out(metrics.psnr(levels, border=1, sizes=fx.sizes(spark, sf)), "psnr")


CE = "(ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[label+1])"


@query("m6_cross_entropy", f"{L} SELECT round(avg({CE}),6) AS cross_entropy FROM logits")
def m6_cross_entropy(spark, sf):
    return _out(metrics.cross_entropy(fx.logits(spark, sf)), "cross_entropy")


PRED = "pred AS (SELECT id, label, list_position(logits, list_max(logits))-1 AS pred FROM logits)"
DICE = """SELECT CAST(c.range AS INT) AS cls, round(2.0*sum(CASE WHEN pred=c.range AND label=c.range THEN 1 ELSE 0 END)/nullif(sum(CASE WHEN pred=c.range THEN 1 ELSE 0 END)+sum(CASE WHEN label=c.range THEN 1 ELSE 0 END),0),6) AS dice
FROM pred, range(0,{n}) c GROUP BY c.range"""


@query("m7_dice", f"{L}, {PRED} {DICE.format(n=12)}")
def m7_dice(spark, sf):
    """Twelve classes; two never occur and give NULL."""
    return _out(metrics.dice(fx.logits(spark, sf), 12), "dice")


@query("w7_top_class", f"{L}, {PRED} SELECT id, CAST(pred AS INT) AS pred FROM pred")
def w7_top_class(spark, sf):
    return fx.logits(spark, sf).select("id", vectors.first_argmax(F.col("logits")).alias("pred"))


@query("m8_dual_half_dice", f"{L}, {PRED} {DICE.format(n=10)}")
def m8_dual_half_dice(spark, sf):
    scores = fx.logits(spark, sf)
    return _out(metrics.dual_half(scores.where("id % 2 = 0"), scores.where("id % 2 = 1"), metrics.dice, 10), "dice")


@query("m8_dual_half_entropy", f"{L} SELECT round(avg({CE}),6) AS cross_entropy FROM logits")
def m8_dual_half_entropy(spark, sf):
    scores = fx.logits(spark, sf)
    return _out(metrics.dual_half(scores.where("id % 2 = 0"), scores.where("id % 2 = 1"), metrics.cross_entropy), "cross_entropy")


ROC = f"""{L}, s AS (SELECT CAST(c.range AS INT) AS cls, logits[c.range+1] AS score, CASE WHEN label=c.range THEN 1 ELSE 0 END AS pos FROM logits, range(1,10) c),
g AS (SELECT cls, score, sum(pos) AS tp_here, sum(1-pos) AS fp_here FROM s GROUP BY ALL),
r AS (SELECT *, sum(tp_here) OVER w AS tp, sum(fp_here) OVER w AS fp FROM g WINDOW w AS (PARTITION BY cls ORDER BY score DESC))"""


@query("w3_roc_points", f"{ROC} SELECT cls, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp-tp_here AS BIGINT) AS tp_before, CAST(fp-fp_here AS BIGINT) AS fp_before FROM r")
def w3_roc_points(spark, sf):
    points = metrics.roc_points(metrics.class_scores(fx.logits(spark, sf), 10), ["cls"])
    return points.select("cls", "score", "tp", "fp", "tp_before", "fp_before")


@query("m9_auc_per_class", f"{ROC} SELECT cls, round(sum(fp_here*(tp-tp_here/2.0))/(sum(tp_here)*sum(fp_here)),6) AS auc FROM r GROUP BY cls")
def m9_auc_per_class(spark, sf):
    return _out(metrics.auc_per_class(fx.logits(spark, sf), 10), "auc")


FEAT = "WITH " + fx.FEATURES_SQL
CONTRAST = """cp AS (SELECT q.f AS f1, k.f AS f2, CASE WHEN k.pos=q.pos THEN 1 ELSE 0 END AS target FROM features q JOIN features k ON q.image_id=k.image_id AND k.side='k' AND (k.pos=q.pos OR k.pos=q.pos+1) WHERE q.side='q'),
d AS (SELECT 1-target AS t, list_sum(list_transform(range(1,65), lambda i: (f1[i]-f2[i])*(f1[i]-f2[i]))) AS d2 FROM cp),
c AS (SELECT 0.5*(t*d2+(1-t)*power(greatest(1.5-sqrt(d2+1e-9),0),2)) AS loss FROM d)"""


def contrast_pairs(spark, sf):
    """Query rows with the key row of their own place (target 1) and of the next place (target 0)."""
    features = fx.features(spark, sf)
    q = features.where("side = 'q'").select("image_id", "pos", F.col("f").alias("f1"))
    near = F.array(F.struct(F.col("pos").alias("p"), F.lit(1).alias("t")), F.struct((F.col("pos") - 1).alias("p"), F.lit(0).alias("t")))
    k = features.where("side = 'k'").select("image_id", F.col("f").alias("f2"), F.explode(near).alias("s"))
    return q.join(k.select("image_id", F.col("s.p").alias("pos"), "f2", F.col("s.t").alias("target")), ["image_id", "pos"])


@query("m10_contrastive", f"{FEAT}, {CONTRAST} SELECT round(avg(loss),6) AS mean, round(sum(loss),4) AS sum FROM c")
def m10_contrastive(spark, sf):
    out = metrics.contrastive(contrast_pairs(spark, sf), 1.5)
    return out.select(F.round("mean", 6).alias("mean"), F.round("sum", 4).alias("sum"))


@query(
    "m8_classify_and_contrast",
    f"""{FEAT}, {CONTRAST}, {fx.LOGITS_SQL}, e AS (SELECT id%2 AS half, avg({CE}) AS ce FROM logits GROUP BY ALL)
SELECT round((SELECT avg(ce) FROM e),6) AS classify, round((SELECT avg(loss) FROM c),6) AS contrast, round((SELECT avg(ce) FROM e),6) AS total""",
)
def m8_classify_and_contrast(spark, sf):
    scores = fx.logits(spark, sf)
    out = metrics.classify_and_contrast(
        scores.where("id % 2 = 0"), scores.where("id % 2 = 1"), contrast_pairs(spark, sf), 1.5
    )
    return _out(out, "classify", "contrast", "total")


SP = "(greatest({v},0)+ln(1+exp(-abs({v}))))"


@query(
    "m15_gan_score",
    f"""{L}, s AS (SELECT label < 5 AS is_real, logits[1]*4 AS p FROM logits) SELECT is_real,
round(avg(CASE WHEN is_real THEN {SP.format(v="(-p)")} ELSE {SP.format(v="p")} END),6) AS vanilla, round(avg(CASE WHEN is_real THEN (p-1)*(p-1) ELSE p*p END),6) AS lsgan,
round(avg(CASE WHEN is_real THEN -p ELSE p END),6) AS wgangp, round(avg(CASE WHEN is_real THEN {SP.format(v="(-p)")} ELSE {SP.format(v="p")} END),6) AS nonsaturating FROM s GROUP BY is_real""",
)
def m15_gan_score(spark, sf):
    scores = fx.logits(spark, sf).select((F.col("label") < 5).alias("is_real"), (F.col("logits")[0] * 4).alias("p"))
    modes = ("vanilla", "lsgan", "wgangp", "nonsaturating")
    wide = scores.groupBy("is_real").agg(*[F.avg(metrics.gan_loss(m, F.col("is_real"))).alias(m) for m in modes])
    return _out(wide, "vanilla", "lsgan", "wgangp", "nonsaturating")


@query(
    "m16_hinge_d",
    f"""{L}, s AS (SELECT logits[1]*6 AS r, logits[2]*6 AS f, label+1 AS w FROM logits)
SELECT 'plain' AS kind, round(0.5*(avg(greatest(1-r,0))+avg(greatest(1+f,0))),6) AS hinge FROM s
UNION ALL SELECT 'weighted', round(0.5*(sum(w*greatest(1-r,0))/sum(w)+sum(w*greatest(1+f,0))/sum(w)),6) FROM s""",
)
def m16_hinge_d(spark, sf):
    scores = fx.logits(spark, sf).select(
        (F.col("logits")[0] * 6).alias("real"), (F.col("logits")[1] * 6).alias("fake"), (F.col("label") + 1).alias("w")
    )
    plain = metrics.hinge_d(scores).withColumn("kind", F.lit("plain"))
    weighted = metrics.hinge_d(scores, F.col("w")).withColumn("kind", F.lit("weighted"))
    return _out(plain.unionByName(weighted), "hinge")


@query(
    "m17_cycle_identity_l1",
    f"""{V}, {PAIR_SQL} SELECT round((avg(abs(b*0.8-a))+avg(abs(a*0.7-b)))/2,6) AS cycle, round((avg(abs(a*0.9-a))+avg(abs(b*1.2-b)))/2,6) AS identity,
round((avg(abs(b*0.8-a))+avg(abs(a*0.7-b)))/2*10+(avg(abs(a*0.9-a))+avg(abs(b*1.2-b)))/2*5,6) AS total FROM pairs""",
)
def m17_cycle_identity_l1(spark, sf):
    a, b = F.col("a"), F.col("b")
    kinds = (("cycle_a", b * 0.8, a), ("cycle_b", a * 0.7, b), ("identity_a", a * 0.9, a), ("identity_b", b * 1.2, b))
    terms = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("a"), q.alias("b")) for k, p, q in kinds])
    rows = pairs(spark, sf).select(F.explode(terms).alias("t")).select("t.*")
    return _out(metrics.cycle_identity_l1(rows, 10.0, 5.0), "cycle", "identity", "total")


POST = "WITH " + fx.POSTERIOR_SQL


@query(
    "m18_gaussian_kl",
    f"""{POST}, p AS (SELECT id, mean AS m, list_transform(logvar, lambda v: greatest(least(v*200,20),-30)) AS lv FROM posterior)
SELECT id, round(ln(0.5*list_sum(list_transform(range(1,33), lambda i: m[i]*m[i]+exp(lv[i])-1-lv[i]))),6) AS log_kl,
round(ln(0.5*list_sum(list_transform(range(1,33), lambda i: (m[i]-lv[i]/200)*(m[i]-lv[i]/200)/exp(m[i]) + exp(lv[i])/exp(m[i])-1-lv[i]+m[i]))),6) AS log_kl_other, 0.0::DOUBLE AS kl_fixed,
round(0.5*(-1+lv[2]/200-m[1]+exp(m[1]-lv[2]/200)+(m[2]-m[3])*(m[2]-m[3])*exp(-lv[2]/200)),6) + 0.0 AS element FROM p""",
)
def m18_gaussian_kl(spark, sf):
    """Log-variances are scaled so that both clamps act; the other Gaussian swaps the halves."""
    post = fx.posterior(spark, sf)
    mean, logvar = F.col("mean"), F.transform("logvar", lambda v: v * 200)
    other = (F.transform(metrics.clamp_logvar(logvar), lambda v: v / 200), mean)
    small = F.greatest(F.least(F.col("logvar")[1] * 200, F.lit(20.0)), F.lit(-30.0)) / 200
    return post.select(
        "id",
        F.round(F.ln(metrics.gaussian_kl(mean, logvar)), 6).alias("log_kl"),
        F.round(F.ln(metrics.gaussian_kl(mean, logvar, other)), 6).alias("log_kl_other"),
        metrics.gaussian_kl(mean, logvar, deterministic=True).alias("kl_fixed"),
        (F.round(metrics.normal_kl(mean[1], mean[0], mean[2], small), 6) + 0.0).alias("element"),
    )


@query(
    "m19_gaussian_nll",
    f"{POST} SELECT id, round(0.5*list_sum(list_transform(range(1,33), lambda i: 1.8378770664093453+logvar[i]+(logvar[i]-mean[i])*(logvar[i]-mean[i])/exp(logvar[i]))),6) AS nll FROM posterior",
)
def m19_gaussian_nll(spark, sf):
    nll = metrics.gaussian_nll(F.col("mean"), F.col("logvar"), F.col("logvar"))
    return fx.posterior(spark, sf).select("id", F.round(nll, 6).alias("nll"))


@query(
    "m20_posterior_sample",
    f"""{POST}, r AS (SELECT id, CAST(i-1 AS INT) AS pos, mean[i] AS m, logvar[i] AS lv FROM (SELECT *, unnest(range(1,33)) AS i FROM posterior))
SELECT id, pos, round(m+exp(0.5*lv)*sqrt(-2*ln(1-{draw_sql(13, "posterior/r", "id", "pos")}))*cos(6.283185307179586*{draw_sql(13, "posterior/a", "id", "pos")}),6) + 0.0 AS sample, round(m,6) + 0.0 AS mode FROM r""",
)
def m20_posterior_sample(spark, sf):
    return _out(metrics.posterior_sample(fx.posterior(spark, sf), seed=13), "sample", "mode")


@query(
    "m21_nll_scaled",
    f"""{V}, {PAIR_SQL}, r AS (SELECT volume_id, abs(a-b)/exp(0.3)+0.3 AS nll, x+1 AS w FROM pairs)
SELECT round(sum(nll)/count(DISTINCT volume_id),4) AS nll, round(sum(w*nll)/count(DISTINCT volume_id),4) AS weighted_nll FROM r""",
)
def m21_nll_scaled(spark, sf):
    rec = pairs(spark, sf).withColumn("rec", F.abs(F.col("a") - F.col("b")))
    out = metrics.nll_scaled(rec, 0.3, weight=F.col("x") + 1)
    return out.select(F.round("nll", 4).alias("nll"), F.round("weighted_nll", 4).alias("weighted_nll"))


@query(
    "m23_weighted_total",
    """WITH m AS (SELECT day(ts) AS epoch, event_type AS name, avg(value) AS value FROM events GROUP BY ALL)
SELECT epoch, round(sum(value*CASE name WHEN 'click' THEN 10.0 WHEN 'view' THEN 0.5 WHEN 'error' THEN 0.0 ELSE 1.0 END),6) AS total, count(*) AS terms FROM m GROUP BY epoch""",
)
def m23_weighted_total(spark, sf):
    means = fx.table(spark, sf, "events").groupBy(
        F.dayofmonth("ts").cast("long").alias("epoch"), F.col("event_type").alias("name")
    ).agg(F.avg("value").alias("value"))
    weights = spark.createDataFrame([("click", 10.0), ("view", 0.5), ("error", 0.0)], "name string, weight double")
    return _out(metrics.weighted_total(means, weights, ["epoch"]), "total")


@query(
    "m24_label_swap",
    f"""{V}, g AS (SELECT CAST(vec_id//50 AS INT) AS sample, vec_id, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings),
s AS (SELECT sample, CASE WHEN sum(v) < 0 THEN -1 ELSE 1 END AS sign FROM g GROUP BY sample) SELECT vec_id AS "row", sample, round(v*sign,6) + 0.0 AS v FROM g JOIN s USING (sample)""",
)
def m24_label_swap(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding")[0].cast("double").alias("v"))
    sample = F.floor(F.col("row") / 50).cast("int").alias("sample")
    signs = rows.groupBy(sample).agg(F.when(F.sum("v") < 0, -1).otherwise(1).alias("sign"))
    return _out(metrics.label_swap(rows, signs, 50), "v")


@query("m25_slice_pool", f"{V}, m AS (SELECT volume_id, z, avg(v) AS m FROM voxels GROUP BY ALL) SELECT volume_id, round(max(m),6) + 0.0 AS pooled FROM m GROUP BY volume_id")
def m25_slice_pool(spark, sf):
    return _out(metrics.slice_pool(fx.voxels(spark, sf)), "pooled")


COUNTS = "c AS (SELECT volume_id, round(v,2)+0.0 AS v, count(*) AS n FROM voxels GROUP BY ALL)"


@query(
    "m26_value_counts",
    f"{V}, {COUNTS} SELECT volume_id, v, n, round(sum(n) OVER (PARTITION BY volume_id ORDER BY v)/sum(n) OVER (PARTITION BY volume_id),9) AS cdf FROM c",
)
def m26_value_counts(spark, sf):
    rounded = fx.voxels(spark, sf).withColumn("v", F.round("v", 2) + 0.0)
    return metrics.value_counts(rounded).select("volume_id", "v", "n", F.round("cdf", 9).alias("cdf"))


@query(
    "w2_running_cdf",
    "WITH c AS (SELECT user_id AS key, value AS v, count(*) AS n FROM events GROUP BY ALL) SELECT key, v, CAST(sum(n) OVER (PARTITION BY key ORDER BY v) AS BIGINT) AS upto, lag(v) OVER (PARTITION BY key ORDER BY v) AS prev FROM c",
)
def w2_running_cdf(spark, sf):
    rows = fx.series(spark, sf).select("key", "v")
    return metrics.value_counts(rows, ["key"], previous=True).select("key", "v", "upto", "prev")


EMA = """WITH s AS (SELECT user_id AS key, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS n FROM events),
l AS (SELECT key, event_id, n, v, list({'n': n, 'v': v}) OVER (PARTITION BY key ORDER BY n) AS h FROM s)"""


@query(
    "w4_ema",
    f"""{EMA} SELECT key, event_id, n, round(list_reduce(h, lambda a, b: {{'n': b.n, 'v': a.v-(1-least(0.9999,(1+b.n)/(10.0+b.n)))*(a.v-b.v)}}).v,6) AS ema FROM l""",
)
def w4_ema(spark, sf):
    rows = fx.series(spark, sf).select("key", "ts", "event_id", "v")
    out = recurrence.ema(rows, ["ts", "event_id"], recurrence.warmup_decay)
    return _out(out.select("key", "event_id", "n", "ema"), "ema")


@query(
    "w5_ema_center",
    f"""{EMA} SELECT key, event_id, round(v-list_reduce(h, lambda a, b: {{'n': b.n, 'v': a.v*0.999+b.v*0.001}}).v,6) + 0.0 AS centered FROM l""",
)
def w5_ema_center(spark, sf):
    rows = fx.series(spark, sf).select("key", "ts", "event_id", "v")
    return _out(recurrence.ema_center(rows, ["ts", "event_id"]).select("key", "event_id", "centered"), "centered")
