"""Codebook, contrastive and histogram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql
from stratavox.catalogue.registry import query
from stratavox.operators import codebook as cb
from stratavox.operators import contrast, histogram, metrics, pairing
from stratavox.operators.layout import slices_to_voxels

NEAR = "WITH " + fx.NEAREST_SQL


def _out(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + 0.0 for n in names})


def vectors_of(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))


def assigned(spark, sf, method="arrow"):
    return cb.nearest_code(vectors_of(spark, sf), fx.codebook(spark, sf), method=method)


NEAREST = f"{NEAR} SELECT vec_id, code, round(d2,6) AS d2 FROM assigned"


@query("j5_nearest_code", NEAREST)
def j5_nearest_code(spark, sf):
    return _out(assigned(spark, sf, "expression").select("vec_id", "code", "d2"), "d2")


@query("j5_nearest_code_arrow", NEAREST)
def j5_nearest_code_arrow(spark, sf):
    return _out(assigned(spark, sf, "arrow").select("vec_id", "code", "d2"), "d2")


@query(
    "j5_remap_used",
    f"""{NEAR}, u AS (SELECT code, row_number() OVER (ORDER BY code)-1 AS i FROM assigned GROUP BY code HAVING count(*) >= (SELECT count(*) FROM assigned)/10.0)
SELECT vec_id, CAST(coalesce(i, (SELECT count(*) FROM u)) AS INT) AS "index" FROM assigned LEFT JOIN u USING (code)""",
)
def j5_remap_used(spark, sf):
    """Codes with at least a tenth of the vectors are used; the others share the last number."""
    codes = assigned(spark, sf)
    total = codes.agg(F.count(F.lit(1)).alias("t")).withColumn("_one", F.lit(1))
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    used = counts.join(total, "_one").where(F.col("n") >= F.col("t") / 10.0).select("code")
    return cb.remap_codes(codes, used).select("vec_id", "index")


@query(
    "j6_code_lookup",
    f"{NEAR} SELECT vec_id, CAST(i-1 AS INT) AS pos, round(c[i],6) + 0.0 AS v FROM (SELECT vec_id, c, unnest(range(1,65)) AS i FROM assigned JOIN codebook USING (code))",
)
def j6_code_lookup(spark, sf):
    looked = cb.code_lookup(assigned(spark, sf), fx.codebook(spark, sf))
    return _out(looked.select("vec_id", F.posexplode("c").alias("pos", "v")), "v")


USAGE = "exp(-sum(p*ln(p+1e-10)))"


@query(
    "m13_perplexity",
    f"{NEAR}, p AS (SELECT code, count(*)/(SELECT count(*) FROM assigned)::DOUBLE AS p FROM assigned GROUP BY code) SELECT round({USAGE},6) AS perplexity, count(*) AS codes_used FROM p",
)
def m13_perplexity(spark, sf):
    return _out(cb.usage(assigned(spark, sf)), "perplexity")


@query("m14_commitment_loss", f"{NEAR} SELECT round(1.25*sum(d2)/(count(*)*64),6) AS commitment FROM assigned")
def m14_commitment_loss(spark, sf):
    looked = cb.code_lookup(assigned(spark, sf), fx.codebook(spark, sf))
    pairs = looked.select(F.explode(F.arrays_zip(F.col("f").alias("a"), F.col("c").alias("b"))).alias("p")).select("p.*")
    return _out(metrics.commitment_loss(pairs.toDF("a", "b")), "commitment")


FEAT = "WITH " + fx.FEATURES_SQL
DOTS = "dots AS (SELECT q.image_id, q.pos, k.image_id AS key_image, k.pos AS key_pos, list_sum(list_transform(range(1,65), lambda i: q.f[i]*k.f[i])) AS dot FROM features q JOIN features k ON {on} WHERE q.side='q' AND k.side='k')"


@query(
    "j7_pair_similarity",
    f"""{FEAT}, {DOTS.format(on="q.image_id=k.image_id")} SELECT image_id, pos, count(*) AS n, round(min(dot),6) + 0.0 AS low, round(max(dot),6) + 0.0 AS high, arg_max(key_pos, dot) AS best FROM dots GROUP BY ALL""",
)
def j7_pair_similarity(spark, sf):
    """Dot products of each query with all keys of its image, reported as count, extremes and best key."""
    sims = contrast.pair_similarity(fx.features(spark, sf))
    return _out(sims.select("image_id", "pos", "n", "low", "high", F.col("keys")[0]["key_pos"].alias("best")), "low", "high")


@query(
    "j7_top_keys",
    f"""{FEAT}, {DOTS.format(on="q.image_id=k.image_id")} SELECT image_id, pos, row_number() OVER w AS rank, key_pos, round(dot,6) + 0.0 AS dot FROM dots WINDOW w AS (PARTITION BY image_id, pos ORDER BY dot DESC, key_image, key_pos) QUALIFY rank <= 5""",
)
def j7_top_keys(spark, sf):
    """The five most similar keys of each query."""
    sims = contrast.pair_similarity(fx.features(spark, sf), top=5)
    ranked = sims.select("image_id", "pos", F.posexplode("keys").alias("at", "k"))
    return _out(ranked.select("image_id", "pos", (F.col("at") + 1).cast("long").alias("rank"), F.col("k.key_pos").alias("key_pos"), F.col("k.dot").alias("dot")), "dot")


@query(
    "j7_similar_pairs",
    f"""{FEAT}, {DOTS.format(on="q.image_id//2=k.image_id//2")} SELECT image_id, pos, key_image, key_pos, round(dot,6) + 0.0 AS dot FROM dots WHERE dot >= 0.3""",
)
def j7_similar_pairs(spark, sf):
    """Pairs of two neighbouring images with a dot product of 0.3 or more."""
    batched = fx.features(spark, sf).withColumn("batch", F.floor(F.col("image_id") / 2))
    return _out(contrast.similar_pairs(batched, 0.3, group=["batch"]), "dot")


LOSS = """l AS (SELECT image_id, pos, CASE WHEN key_image=image_id AND key_pos=pos THEN -10.0 ELSE dot END/0.07 AS l, CASE WHEN key_image=image_id AND key_pos=pos THEN dot/0.07 END AS own FROM dots),
loss AS (SELECT image_id, pos, ln(exp(max(own))+sum(exp(l)))-max(own) AS loss FROM l GROUP BY ALL)"""


@query("m11_patch_nce", f"""{FEAT}, {DOTS.format(on="q.image_id=k.image_id")}, {LOSS} SELECT image_id, pos, round(loss,6) + 0.0 AS loss FROM loss""")
def m11_patch_nce(spark, sf):
    return _out(contrast.patch_nce(fx.features(spark, sf)), "loss")


DRAWN = f"""p AS (SELECT DISTINCT pos FROM features), r AS (SELECT pos, row_number() OVER (ORDER BY {draw_sql(5, "positions", "0", "pos")}, pos) AS rn FROM p),
drawn AS (SELECT features.* FROM features JOIN r USING (pos) WHERE rn <= 12)"""


@query(
    "m11_patch_nce_drawn",
    f"""{FEAT}, {DRAWN}, {DOTS.format(on="q.image_id=k.image_id").replace("features", "drawn")}, {LOSS} SELECT image_id, pos, round(loss,6) + 0.0 AS loss FROM loss""",
)
def m11_patch_nce_drawn(spark, sf):
    """Twelve drawn positions only."""
    return _out(contrast.patch_nce(fx.features(spark, sf), patches=12, seed=5), "loss")


@query("m11_patch_nce_batch", f"""{FEAT}, {DOTS.format(on="q.image_id//2=k.image_id//2")}, {LOSS} SELECT image_id, pos, round(loss,6) + 0.0 AS loss FROM loss""")
def m11_patch_nce_batch(spark, sf):
    """Negatives of the whole batch of two images."""
    batched = fx.features(spark, sf).withColumn("batch", F.floor(F.col("image_id") / 2))
    return _out(contrast.patch_nce(batched, group=["batch"]), "loss")


LAYERS = """layers AS (SELECT side, image_id, pos, n AS layer, list_transform(f[n*16+1:n*16+16], lambda v: v/(sqrt(list_sum(list_transform(f[n*16+1:n*16+16], lambda u: u*u)))+1e-7)) AS f FROM (SELECT *, unnest(range(0,4)) AS n FROM features)),
dots AS (SELECT q.layer, q.image_id, q.pos, k.pos AS key_pos, list_sum(list_transform(range(1,17), lambda i: q.f[i]*k.f[i])) AS dot FROM layers q JOIN layers k ON q.image_id=k.image_id AND q.layer=k.layer WHERE q.side='q' AND k.side='k'),
l AS (SELECT layer, image_id, pos, CASE WHEN key_pos=pos THEN -10.0 ELSE dot END/0.07 AS l, CASE WHEN key_pos=pos THEN dot/0.07 END AS own FROM dots),
loss AS (SELECT layer, image_id, pos, ln(exp(max(own))+sum(exp(l)))-max(own) AS loss FROM l GROUP BY ALL),
m AS (SELECT layer, avg(loss) AS m FROM loss GROUP BY layer)"""


@query("m12_nce_multi_layer", f"""{FEAT}, {LAYERS} SELECT round(sum(m*CASE layer WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 2.0 END)/4,6) AS nce FROM m""")
def m12_nce_multi_layer(spark, sf):
    """Four layers: the quarters of each vector at unit length."""
    from stratavox.functions.vectors import l2_normalize

    quarters = F.array(
        *[F.struct(F.lit(n).alias("layer"), l2_normalize(F.slice("f", n * 16 + 1, 16)).alias("f")) for n in range(4)]
    )
    layered = fx.features(spark, sf).select("side", "image_id", "pos", F.explode(quarters).alias("q")).select(
        "side", "image_id", "pos", "q.layer", "q.f"
    )
    losses = contrast.patch_nce(layered)
    return _out(contrast.nce_multi_layer(losses, {0: 1.0, 1: 1.0, 2: 0.5, 3: 2.0}), "nce")


QUARTERS = """quarters AS (SELECT code*4+qx*2+qy AS code, list_transform(range(0,16), lambda i: c[(qx*4+i//4)*8+qy*4+i%4+1]) AS c FROM codebook, (SELECT unnest([0,0,1,1]) AS qx, unnest([0,1,0,1]) AS qy)),
tiles AS (SELECT volume_id, z, gx, gy, list_transform(range(0,16), lambda i: CAST(embedding[(gx*4+i//4)*8+gy*4+i%4+1] AS DOUBLE)) AS f FROM stack, (SELECT CAST(unnest([0,0,1,1]) AS INT) AS gx, CAST(unnest([0,1,0,1]) AS INT) AS gy)),
enc AS (SELECT volume_id, z, gx, gy, code, c FROM (SELECT t.*, q.code, q.c, row_number() OVER (PARTITION BY volume_id, z, gx, gy ORDER BY list_sum(list_transform(range(1,17), lambda i: (f[i]-c[i])*(f[i]-c[i]))), code) AS rn FROM tiles t, quarters q) WHERE rn=1)"""


def quarter_codebook(spark, sf):
    """Forty 4x4 codes: the quarters of the ten mean slices."""
    book = fx.codebook(spark, sf).select(F.col("code").alias("label"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("q"), "c")
    qx, qy = F.floor(F.col("q") / 2).cast("int"), F.col("q") % 2
    part = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("c", (qx * 4 + r) * 8 + qy * 4 + 1, F.lit(4))))
    return book.select((F.col("label") * 4 + F.col("q")).alias("code"), part.alias("c"))


@query("u7_encode_volume", f"WITH {fx.STACK_SQL}, {fx.CODEBOOK_SQL}, {QUARTERS} SELECT volume_id, z, gx, gy, code FROM enc")
def u7_encode_volume(spark, sf):
    return cb.encode_volume(fx.slices(spark, sf), quarter_codebook(spark, sf), 4)


@query(
    "u7_decode_volume",
    f"WITH {fx.STACK_SQL}, {fx.CODEBOOK_SQL}, {QUARTERS} SELECT volume_id, z, CAST(gx*4+i//4 AS INT) AS x, CAST(gy*4+i%4 AS INT) AS y, round(c[i+1],6) + 0.0 AS v FROM (SELECT *, unnest(range(0,16)) AS i FROM enc)",
)
def u7_decode_volume(spark, sf):
    book = quarter_codebook(spark, sf)
    return _out(cb.decode_volume(cb.encode_volume(fx.slices(spark, sf), book, 4), book, 4), "v")


def _lloyd_sql(rounds: int) -> str:
    """Rounds of nearest code (lowest on ties) and means, from the mean vector of each label."""
    ctes, book = [fx.CODEBOOK_SQL], "codebook"
    for n in range(rounds):
        ctes.append(
            f"""near{n} AS (SELECT vec_id, f, code FROM (SELECT e.vec_id, e.f, k.code, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(range(1,65), lambda i: (e.f[i]-k.c[i])*(e.f[i]-k.c[i]))), code) AS rn FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings) e, {book} k) WHERE rn=1),
cells{n} AS (SELECT code, i, avg(f[i]) AS m FROM (SELECT code, f, unnest(range(1,65)) AS i FROM near{n}) GROUP BY ALL),
book{n} AS (SELECT code, list(m ORDER BY i) AS c FROM cells{n} GROUP BY code UNION ALL SELECT code, c FROM {book} WHERE code NOT IN (SELECT code FROM cells{n}))"""
        )
        book = f"book{n}"
    return f"WITH {', '.join(ctes)} SELECT CAST(code AS INT) AS code, CAST(i-1 AS INT) AS pos, round(c[i],6) + 0.0 AS v FROM (SELECT *, unnest(range(1,65)) AS i FROM {book})"


@query("u6_lloyd_rounds", _lloyd_sql(3))
def u6_lloyd_rounds(spark, sf):
    """Three rounds from the mean vector of each label."""
    book = cb.refine_codebook(vectors_of(spark, sf), fx.codebook(spark, sf), 3)
    return _out(book.select("code", F.posexplode("c").alias("pos", "v")), "v")


@query("u6_fit_codebook")
def u6_fit_codebook(spark, sf):
    """Sixteen codes learned from all vectors, with the error they leave."""
    data = vectors_of(spark, sf)
    book = cb.fit_codebook(data, 16, seed=3)
    coded = cb.nearest_code(data, book)
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("d2").alias("error"))


@query(
    "m27_compression_report",
    f"WITH {fx.STACK_SQL}, n AS (SELECT volume_id, max(z)+1 AS nz FROM stack GROUP BY volume_id) SELECT volume_id, CAST(nz*64*16 AS BIGINT) AS bits_in, CAST(nz*8 AS BIGINT) AS bits_out, 128.0::DOUBLE AS ratio, 1024.0::DOUBLE AS isotropic_ratio FROM n",
)
def m27_compression_report(spark, sf):
    return cb.compression_report(fx.slices(spark, sf))


MATCH = """r AS (SELECT volume_id, z//2 AS z, x, y, z%2 AS side, round(v,2)+0.0 AS v FROM voxels),
c AS (SELECT volume_id, side, v, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT *, sum(n) OVER w/sum(n) OVER (PARTITION BY volume_id, side)::DOUBLE AS q, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY volume_id, side ORDER BY v)),
t AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY volume_id ORDER BY v), 0) AS pq FROM q WHERE side=1),
b AS (SELECT s.volume_id, s.v, s.q, t.pq, t.q AS cq, t.pv, t.v AS tv FROM q s JOIN t ON s.volume_id=t.volume_id AND s.q > t.pq AND s.q <= t.q WHERE s.side=0)"""


@query("j9_quantile_bracket", f"WITH {fx.VOXELS_SQL}, {MATCH} SELECT volume_id, v, round(q,9) AS q, pv AS t_low, tv AS t_high FROM b")
def j9_quantile_bracket(spark, sf):
    even, odd = two_sides(spark, sf)
    out = histogram.quantile_bracket(
        metrics.value_counts(even), metrics.value_counts(odd, previous=True), ["volume_id"]
    )
    return out.select("volume_id", "v", F.round("q", 9).alias("q"), "t_low", "t_high")


FINE = MATCH.replace("round(v,2)+0.0 AS v", "v")


@query("j9_quantile_bracket_fine", f"WITH {fx.VOXELS_SQL}, {FINE} SELECT volume_id, v, round(q,9) AS q, pv AS t_low, tv AS t_high FROM b")
def j9_quantile_bracket_fine(spark, sf):
    """Unrounded values: nearly every pixel has a value of its own."""
    even, odd = two_sides(spark, sf, None)
    out = histogram.quantile_bracket(metrics.value_counts(even), metrics.value_counts(odd, previous=True), ["volume_id"])
    return out.select("volume_id", "v", F.round("q", 9).alias("q"), "t_low", "t_high")


def two_sides(spark, sf, digits=2):
    even, odd = pairing.interleaved_pair(fx.slices(spark, sf))
    sides = [slices_to_voxels(s) for s in (even, odd)]
    return sides if digits is None else [s.withColumn("v", F.round("v", digits) + 0.0) for s in sides]


@query(
    "r21_hist_match",
    f"WITH {fx.VOXELS_SQL}, {MATCH} SELECT r.volume_id, r.z, x, y, round(CASE WHEN pv IS NULL THEN tv ELSE pv+(b.q-pq)/(cq-pq)*(tv-pv) END,10) + 0.0 AS v FROM r JOIN b ON r.volume_id=b.volume_id AND r.v=b.v WHERE side=0",
)
def r21_hist_match(spark, sf):
    """Even slices of each volume take the histogram of the odd ones."""
    return histogram.hist_match(*two_sides(spark, sf)).withColumn("v", F.round("v", 10) + 0.0)


@query(
    "r21_hist_match_fine",
    f"WITH {fx.VOXELS_SQL}, {FINE} SELECT r.volume_id, r.z, x, y, round(CASE WHEN pv IS NULL THEN tv ELSE pv+(b.q-pq)/(cq-pq)*(tv-pv) END,9) + 0.0 AS v FROM r JOIN b ON r.volume_id=b.volume_id AND r.v=b.v WHERE side=0",
)
def r21_hist_match_fine(spark, sf):
    """Unrounded values."""
    return histogram.hist_match(*two_sides(spark, sf, None)).withColumn("v", F.round("v", 9) + 0.0)


BACK = """px AS (SELECT volume_id, z, x, y, v FROM event_voxels), r AS (SELECT volume_id, z//2 AS z, x, y, z%2 AS side, v FROM px),"""


@query(
    "r21_hist_match_background",
    f"WITH {fx.EVENTS_SQL}, {BACK} {MATCH[MATCH.index('c AS'):]} SELECT r.volume_id, r.z, x, y, round(CASE WHEN pv IS NULL THEN tv ELSE pv+(b.q-pq)/(cq-pq)*(tv-pv) END,6) + 0.0 AS v FROM r JOIN b ON r.volume_id=b.volume_id AND r.v=b.v WHERE side=0",
)
def r21_hist_match_background(spark, sf):
    """Sparse volumes: most pixels of both sides hold the background value 0."""
    even, odd = pairing.interleaved_pair(fx.event_slices(spark, sf))
    out = histogram.hist_match(slices_to_voxels(even), slices_to_voxels(odd))
    return out.withColumn("v", F.round("v", 6) + 0.0)
