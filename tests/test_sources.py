"""Readers and writers on real files."""

import numpy as np
import pytest
from helpers import plane_rows
from pyspark.sql import functions as F

from stratavox.operators import pairing
from stratavox.plans.patch_preparation import prepare_patches
from stratavox.sources import images


def test_catalog_lists_nested_images_only(spark, tmp_path):
    for name in ("b.tif", "a.PNG", "c.tiff", "d.txt", "in/e.jpeg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    got = [r["path"].rsplit("/", 1)[1] for r in images.image_catalog(spark, str(tmp_path)).collect()]
    assert got == ["a.PNG", "b.tif", "e.jpeg"]
    plan = images.image_catalog(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        images.image_catalog(spark, str(empty))


def test_patches_are_stored_single_precision(spark, tmp_path):
    cube = np.random.default_rng(0).random((2, 4, 4))
    (patches,) = prepare_patches([plane_rows(spark, list(cube))], (2, 2, 2), [None], prefix="q")
    images.write_patches(patches, str(tmp_path / "out"), "ori")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert dict(back.dtypes)["data"] == "array<float>"
    assert {r["name"] for r in back.where("dest = 'ori'").collect()} == {f"q{x:03d}{y:03d}000" for x in (0, 1) for y in (0, 1)}


def test_subject_file_keeps_text_ids(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("ID,left,right\n007,1,3\n12,2.5,2\n")
    rows = images.subject_scan(spark, str(path)).collect()
    assert [(r["ID"], r["left_score"]) for r in rows] == [("007", 1.0), ("12", 2.5)]


def test_labels_take_the_first_match_and_reject_unknown(spark):
    subjects = spark.createDataFrame(
        [("7", 1.0, 3.0, 1), ("7", 9.0, 9.0, 2), ("8", 2.0, 2.0, 3)], "ID string, left_score double, right_score double, ord int"
    )
    files = spark.createDataFrame([("d/7_01.tif",), ("d/8_02.tif",)], "path string")
    got = {r["ID"]: (r["diff"], r["binary"]) for r in pairing.subject_labels(files, subjects).collect()}
    assert got == {"7": (0.2, 1.0), "8": (0.0, 0.5)}
    with pytest.raises(Exception, match="unknown subject"):
        pairing.subject_labels(spark.createDataFrame([("9_1.tif",)], "path string"), subjects).collect()


def test_epochs_append(spark, tmp_path):
    metrics = spark.createDataFrame([("l1", 0.5), ("nce", 2.0)], "name string, value double")
    for epoch in (1, 2):
        images.append_epoch_metrics(metrics, epoch, str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert back.columns == ["epoch", "name", "value"] and back.count() == 4


def test_split_prunes_folders(spark, tmp_path):
    root = str(tmp_path / "data")
    spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("val")).write.partitionBy("split").parquet(root)
    val = images.split_scan(spark, root, "val")
    assert val.count() == 3 and images.split_scan(spark, root, "test").count() == 0
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_stacking_rejects_mixed_shapes(spark):
    rows = spark.createDataFrame([(0, 5, 8, 8), (0, 9, 8, 7)], "volume_id int, id int, h int, w int")
    with pytest.raises(Exception, match="differ in shape"):
        images.slices_to_volume(rows, "id").collect()


def test_an_epoch_written_twice_is_there_once(spark, tmp_path):
    metrics = spark.createDataFrame([(1, "l1", 0.5), (1, "nce", 2.0), (2, "l1", 0.25)], "epoch int, name string, value double")
    path = str(tmp_path / "log")
    images.put_epochs(metrics, path)
    images.put_epochs(metrics.where("epoch = 1").withColumn("value", F.col("value") * 2), path)
    back = images.read_epochs(spark, path, "name string, value double")
    assert sorted(map(tuple, back.select("epoch", "name", "value").collect())) == [(1, "l1", 1.0), (1, "nce", 4.0), (2, "l1", 0.25)]
