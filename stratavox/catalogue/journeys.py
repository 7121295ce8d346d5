"""End-to-end queries: training samples, evaluation samples, compression quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.codes import QUARTERS, quarter_codebook
from stratavox.catalogue.geometry import draw_sql, integer_sql
from stratavox.catalogue.registry import query
from stratavox.catalogue.stencils import apply_sql, linear_sql
from stratavox.operators.pairing import interleaved_pair
from stratavox.plans import compression, training_samples


@query(
    "e2_training_samples",
    f"""WITH {fx.VOXELS_SQL}, h AS (SELECT volume_id, z%2 AS side, z//2 AS z, x, y, v FROM voxels),
s AS (SELECT volume_id, side, min(v) AS lo, max(v) AS hi FROM h GROUP BY ALL),
c AS (SELECT volume_id, side, z, x-1 AS x, y-1 AS y, (v-lo)/(hi-lo)*2-1 AS v FROM h JOIN s USING (volume_id, side) WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
d AS (SELECT volume_id, {integer_sql(31, "crop/x", "0", "6-4+1", "volume_id")} AS t, {integer_sql(31, "crop/y", "0", "6-4+1", "volume_id")} AS l,
 row_number() OVER (ORDER BY {draw_sql(31, "shuffle", "volume_id")}, volume_id)-1 AS pos FROM (SELECT DISTINCT volume_id FROM h))
SELECT CAST(pos//4 AS INT) AS batch, CAST(pos%4 AS INT) AS place, volume_id, CAST(side AS INT) AS side, z, x-t AS x, y-l AS y, round(v,6) + 0.0 AS v FROM c JOIN d USING (volume_id) WHERE x>=t AND x<t+4 AND y>=l AND y<l+4""",
)
def e2_training_samples(spark, sf):
    """Even and odd slices as the two sides of each sample, four samples per batch."""
    sides = interleaved_pair(fx.slices(spark, sf))
    out = training_samples.training_samples(sides, "11", precrop=6, resize=6, crop=4, batch=4, seed=31)
    return out.select("batch", "place", "volume_id", "side", "z", "x", "y", (F.round("v", 6) + 0.0).alias("v"))


@query(
    "e2_evaluation_samples",
    f"""WITH {fx.VOXELS_SQL}, {linear_sql("w", 8, 12)}, {apply_sql("w", "w")}, s AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM res GROUP BY ALL)
SELECT volume_id, z, x-1 AS x, y-1 AS y, round((v-lo)/(hi-lo),6) + 0.0 AS v FROM res JOIN s USING (volume_id) WHERE x BETWEEN 1 AND 9 AND y BETWEEN 1 AND 9""",
)
def e2_evaluation_samples(spark, sf):
    out = training_samples.evaluation_samples(fx.slices(spark, sf), "01", resize=12, crop=9)
    return out.withColumn("v", F.round("v", 6) + 0.0)


@query(
    "e3_compress_evaluate",
    f"""WITH {fx.STACK_SQL}, {fx.CODEBOOK_SQL}, {QUARTERS}, t AS (SELECT e.volume_id, e.code, list_sum(list_transform(range(1,17), lambda i: (tiles.f[i]-e.c[i])*(tiles.f[i]-e.c[i]))) AS d2 FROM enc e JOIN tiles USING (volume_id, z, gx, gy)),
m AS (SELECT volume_id, sum(d2)/(count(*)*16) AS mse FROM t GROUP BY volume_id), k AS (SELECT volume_id, code, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT volume_id, code, n/sum(n) OVER (PARTITION BY volume_id)::DOUBLE AS p FROM k),
u AS (SELECT volume_id, exp(-sum(p*ln(p+1e-10))) AS perplexity, count(*) AS codes_used FROM p GROUP BY volume_id)
SELECT volume_id, round(mse,9) AS mse, round(20*log10(2/sqrt(mse)),6) AS psnr, round(1.25*mse,9) AS commitment, round(perplexity,6) AS perplexity, codes_used FROM m JOIN u USING (volume_id)""",
)
def e3_compress_evaluate(spark, sf):
    out = compression.evaluate(fx.slices(spark, sf), quarter_codebook(spark, sf), 4)
    digits = {"mse": 9, "psnr": 6, "commitment": 9, "perplexity": 6}
    return out.withColumns({n: F.round(n, d) for n, d in digits.items()})
