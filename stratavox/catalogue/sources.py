"""Scans, sinks, name joins and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql
from stratavox.catalogue.registry import query
from stratavox.functions import text
from stratavox.operators import pairing, sampling
from stratavox.plans.patch_preparation import mean_of, prepare_patches
from stratavox.session import scratch_path
from stratavox.sources import images

FILES = "WITH " + fx.FILES_SQL
LISTED = """listed AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.tif' WHEN 'de' THEN '.PNG' WHEN 'fr' THEN '.tiff' ELSE '.Jpg' END AS path FROM documents)"""


def listed(spark, sf):
    suffix = F.create_map(*[F.lit(v) for v in ("en", ".tif", "de", ".PNG", "fr", ".tiff")])
    return fx.table(spark, sf, "documents").select(
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.coalesce(suffix[F.col("lang")], F.lit(".Jpg"))).alias("path")
    )


@query("s1_image_catalog", f"WITH {LISTED} SELECT path FROM listed WHERE lang_ok(path)".replace("lang_ok(path)", "regexp_matches(path, '(\\.tif|\\.PNG)$')"))
def s1_image_catalog(spark, sf):
    """The suffix rule of the catalog on document paths: .tif and .PNG pass, .tiff and .Jpg do not."""
    return listed(spark, sf).where(images.is_image(F.col("path")))


@query("s1_catalog_of_folder", "SELECT DISTINCT lang, source FROM documents WHERE lang IN ('en', 'de', 'fr')")
def s1_catalog_of_folder(spark, sf):
    """A folder of files with image and other suffixes, written from the documents and listed again; Spanish files are no images."""
    root = scratch_path(spark, "pictures")
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    for lang, suffix in (("en", "tif"), ("de", "png"), ("fr", "BMP"), ("es", "csv")):
        rows = docs.where(F.col("lang") == lang).repartition("source")
        rows.select("doc_id", "source").write.option("extension", suffix).partitionBy("source").csv(f"{root}/{lang}")
    found = images.image_catalog(spark, root).where("length > 0").select(F.regexp_extract("path", "/(..)/source=([^/]+)/[^/]+$", 1).alias("lang"), F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"))
    return found.distinct()


@query("w9_sorted_paths", f"WITH {LISTED} SELECT DISTINCT path FROM listed")
def w9_sorted_paths(spark, sf):
    return images.sorted_paths(listed(spark, sf))


@query("s2_slices_to_volume", f"WITH {fx.STACK_SQL} SELECT volume_id, z, vec_id, 8 AS h, 8 AS w FROM stack")
def s2_slices_to_volume(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("volume_id"), "vec_id", F.lit(8).alias("h"), F.lit(8).alias("w")
    )
    return images.slices_to_volume(rows, "vec_id").select("volume_id", F.col("z").cast("int").alias("z"), "vec_id", "h", "w")


@query(
    "s2_slices_by_hashed_id",
    "SELECT label AS volume_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)))-1 AS z, md5(CAST(vec_id AS VARCHAR)) AS name FROM embeddings",
)
def s2_slices_by_hashed_id(spark, sf):
    """Slices named by hashes: text ids, as sparse as can be."""
    name = F.md5(F.col("vec_id").cast("string")).alias("name")
    rows = fx.table(spark, sf, "embeddings").select(F.col("label").alias("volume_id"), name, F.lit(8).alias("h"), F.lit(8).alias("w"))
    return images.slices_to_volume(rows, "name").select("volume_id", "z", "name")


PATCHES = f"""{fx.VOXELS_SQL}, q AS (SELECT volume_id, quantile_cont(v, 0.001) AS p0, quantile_cont(v, 0.999) AS p1 FROM voxels GROUP BY volume_id),
c AS (SELECT volume_id, z, x, y, greatest(least(v, p1), p0) AS v FROM voxels JOIN q USING (volume_id)),
s AS (SELECT volume_id, min(v) AS lo, max(v) AS hi, max(z)+1 AS nz FROM c GROUP BY volume_id),
t AS (SELECT volume_id, z//4 AS gz, x//4 AS gx, y//4 AS gy, (v-lo)/(hi-lo)*2-1 AS v FROM c JOIN s USING (volume_id) WHERE (z//4+1)*4 <= nz)"""


@query(
    "s3_write_patches",
    f"""WITH {PATCHES} SELECT 'v' || CAST(volume_id AS VARCHAR) || '_' || format('{{:03d}}{{:03d}}{{:03d}}', gx, gy, gz) AS name, count(*) AS n, round(avg(CAST(CAST(v AS FLOAT) AS DOUBLE)), 6) + 0.0 AS mean_v,
round(CAST(min(CAST(v AS FLOAT)) AS DOUBLE), 6) + 0.0 AS min_v, round(CAST(max(CAST(v AS FLOAT)) AS DOUBLE), 6) + 0.0 AS max_v FROM t GROUP BY volume_id, gx, gy, gz HAVING avg(v) > -0.02""",
)
def s3_write_patches(spark, sf):
    """Prepared patches through the sink and back; values in single precision."""
    (patches,) = prepare_patches([fx.slices(spark, sf)], (4, 4, 4), ["11"], percentile=(0.1, 99.9), bright=-0.02)
    root = scratch_path(spark, "patches")
    images.write_patches(patches.withColumn("name", F.concat(F.lit("v"), F.col("volume_id").cast("string"), F.lit("_"), "name")), root, "first")
    kept = spark.read.parquet(root).withColumn("data", F.col("data").cast("array<double>"))
    return kept.select(
        "name",
        F.size("data").cast("long").alias("n"),
        (F.round(mean_of(), 6) + 0.0).alias("mean_v"),
        (F.round(F.array_min("data"), 6) + 0.0).alias("min_v"),
        (F.round(F.array_max("data"), 6) + 0.0).alias("max_v"),
    )


@query("s6_subject_scan", f"WITH {fx.SUBJECTS_SQL} SELECT * FROM subjects")
def s6_subject_scan(spark, sf):
    """Scores written as CSV files and scanned with a fixed schema."""
    path = scratch_path(spark, "subjects")
    fx.subjects(spark, sf).select("ID", "left_score", "right_score").write.csv(path, header=True)
    return images.subject_scan(spark, path)


@query(
    "s7_append_epoch_metrics",
    "SELECT day(ts) AS epoch, event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY ALL",
)
def s7_append_epoch_metrics(spark, sf):
    events = fx.table(spark, sf, "events")
    means = events.groupBy(F.dayofmonth("ts").alias("_day"), F.col("event_type").alias("name")).agg(
        F.round(F.avg("value"), 6).alias("value")
    )
    log = scratch_path(spark, "epochs")
    days = images.with_epoch(means, F.col("_day")).drop("_day")
    images.put_epochs(days, log)
    images.put_epochs(days.where("epoch = 3"), log)  # a repeated append
    return images.read_epochs(spark, log, "name string, value double").withColumn("epoch", F.col("epoch").cast("long"))


@query(
    "s8_stale_runs",
    f"""WITH {fx.PATHS_SQL}, runs AS (SELECT DISTINCT 'logs/default/v' || CAST(user_id AS VARCHAR) || '/' AS run FROM events),
last AS (SELECT string_split(path, 'checkpoints')[1] AS run, max_by(CAST(regexp_extract(path, 'epoch=(\\d+)', 1) AS INT), path) AS epoch FROM paths GROUP BY ALL)
SELECT run, coalesce(epoch, 0) AS epoch FROM runs LEFT JOIN last USING (run) WHERE coalesce(epoch, 0) < 60""",
)
def s8_stale_runs(spark, sf):
    users = fx.table(spark, sf, "events").select("user_id").distinct()
    runs = users.select(F.concat(F.lit("logs/default/v"), F.col("user_id").cast("string"), F.lit("/")).alias("run"))
    return images.stale_runs(fx.checkpoint_paths(spark, sf), runs)


@query("s9_split_scan", "SELECT doc_id, source FROM documents WHERE lang <> 'en'")
def s9_split_scan(spark, sf):
    """English documents train, the others validate; a folder level per split, of which one is read."""
    split = F.when(F.col("lang") == "en", "train").otherwise("val")
    root = scratch_path(spark, "splits")
    fx.table(spark, sf, "documents").select("doc_id", "source", split.alias("split")).write.partitionBy("split").parquet(root)
    return images.split_scan(spark, root, "val").select("doc_id", "source")


@query(
    "s10_select_indices",
    f"WITH {LISTED}, r AS (SELECT path AS name, CAST(row_number() OVER (ORDER BY path)-1 AS INT) AS pos FROM listed) SELECT name, pos FROM r WHERE pos IN (SELECT item_id*3 FROM benchmark)",
)
def s10_select_indices(spark, sf):
    wanted = fx.table(spark, sf, "benchmark").select((F.col("item_id") * 3).cast("int").alias("pos"))
    return pairing.select_indices(listed(spark, sf).withColumnRenamed("path", "name"), wanted)


@query("j1_common_names", f"{FILES} SELECT name FROM files GROUP BY name HAVING count(DISTINCT dir) = 4")
def j1_common_names(spark, sf):
    return pairing.common_names(fx.files(spark, sf), 4)


@query(
    "j2_paired_samples",
    f"{FILES} SELECT name, 'en/' || name AS first, 'de/' || name AS second FROM files WHERE dir IN ('en', 'de') GROUP BY name HAVING count(DISTINCT dir) = 2",
)
def j2_paired_samples(spark, sf):
    pairs = pairing.paired_samples(fx.files(spark, sf), ["en", "de"])
    return pairs.select("name", F.col("filenames")[0].alias("first"), F.col("filenames")[1].alias("second"))


@query(
    "j3_subject_labels",
    f"""WITH {fx.SUBJECTS_SQL} SELECT CAST(doc_id AS VARCHAR) || '_' || source AS path, s.ID, left_score, right_score, round((right_score-left_score)/10, 6) + 0.0 AS diff,
(sign(right_score-left_score)+1)/2 AS "binary" FROM documents d JOIN subjects s ON s.ID = CAST(d.doc_id AS VARCHAR)""",
)
def j3_subject_labels(spark, sf):
    """Labelled documents only; an unlabelled one stops the lookup (see the tests)."""
    subjects = fx.subjects(spark, sf)
    docs = fx.table(spark, sf, "documents").withColumn("ID", F.col("doc_id").cast("string"))
    known = docs.join(subjects.select("ID"), "ID", "left_semi")
    samples = known.select(F.concat("ID", F.lit("_"), "source").alias("path"))
    return pairing.subject_labels(samples, subjects).withColumn("diff", F.round("diff", 6) + 0.0)


@query("so1_intersect", f"{FILES} SELECT name FROM files WHERE dir='en' INTERSECT SELECT name FROM files WHERE dir='fr'")
def so1_intersect(spark, sf):
    files = fx.files(spark, sf)
    return files.where("dir = 'en'").select("name").intersect(files.where("dir = 'fr'").select("name"))


@query("so2_union", f"{FILES} SELECT name, dir FROM files WHERE dir='en' UNION ALL SELECT name, dir FROM files WHERE dir='es'")
def so2_union(spark, sf):
    files = fx.files(spark, sf)
    return files.where("dir = 'en'").unionByName(files.where("dir = 'es'")).select("name", "dir")


@query("w1_position_by_name", f"{FILES} SELECT dir, name, CAST(row_number() OVER (PARTITION BY dir ORDER BY name)-1 AS INT) AS pos FROM files")
def w1_position_by_name(spark, sf):
    return pairing.name_positions(fx.files(spark, sf), keys=["dir"]).withColumn("pos", F.col("pos").cast("int"))


@query(
    "w8_shuffle_batches",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(4, "shuffle", "doc_id")}, doc_id)-1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(pos//64 AS INT) AS batch, CAST(pos%64 AS INT) AS place FROM r WHERE pos < n - n%64""",
)
def w8_shuffle_batches(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return sampling.shuffle_batches(docs, "doc_id", 64, seed=4, drop_last=True)


@query(
    "u1_draw",
    f"""SELECT doc_id, {draw_sql(21, "check", "doc_id")} AS u,
round(sqrt(-2*ln(1-{draw_sql(21, "check/r", "doc_id")}))*cos(6.283185307179586*{draw_sql(21, "check/a", "doc_id")}), 9) + 0.0 AS g FROM documents""",
)
def u1_draw(spark, sf):
    from stratavox.functions import draws

    return fx.table(spark, sf, "documents").select(
        "doc_id",
        draws.uniform(21, "check", F.col("doc_id")).alias("u"),
        (F.round(draws.gaussian(21, "check", F.col("doc_id")), 9) + 0.0).alias("g"),
    )


@query(
    "w6_sample_positions",
    f"""WITH {fx.FEATURES_SQL}, p AS (SELECT DISTINCT pos FROM features), r AS (SELECT pos, row_number() OVER (ORDER BY {draw_sql(5, "positions", "0", "pos")}, pos) AS rn FROM p)
SELECT side, image_id, f.pos FROM features f JOIN r ON f.pos=r.pos WHERE rn <= 12""",
)
def w6_sample_positions(spark, sf):
    """The same twelve positions for every image and both sides."""
    features = fx.features(spark, sf)
    return sampling.sample_positions(features, 12, seed=5).select("side", "image_id", "pos")
