"""Plan shapes that must hold at scale."""

import numpy as np
from helpers import plane_rows
from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.functions import kernels
from stratavox.operators import codebook, pairing, planes, tiling
from stratavox.operators.layout import slices_to_voxels

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, n=4):
    path = str(tmp_path / "slices")
    plane_rows(spark, [np.random.default_rng(i).random((8, 8)) for i in range(n)]).write.parquet(path)
    return spark.read.parquet(path)


def test_plane_operators_never_shuffle(spark, tmp_path):
    df = stored(spark, tmp_path)
    for out in (
        planes.convolve(df, kernels.isotropic_gaussian(3, 1.0), "mirror"),
        planes.resize_bicubic_aa(df, 0.5),
        tiling.tile_overlap(df, 4, 1, 5),
        codebook.slice_tiles(df, 4),
        slices_to_voxels(df),
    ):
        assert "Exchange" not in plan(out)


def test_a_plane_function_runs_once(spark, tmp_path):
    out = planes.convolve(stored(spark, tmp_path), kernels.laplacian(0.2), "wrap")
    used = out.select("h", "w", F.size("data"), F.array_min("data"), F.array_max("data"))
    assert plan(used).count("MapInPandas") == 1 and "ArrowEvalPython" not in plan(used)


def test_codes_do_not_move_features(spark, tmp_path):
    df = stored(spark, tmp_path).withColumnRenamed("data", "f")
    book = spark.createDataFrame([(0, [0.0] * 64), (1, [1.0] * 64)], "code int, c array<double>")
    for method in ("expression", "arrow"):
        assert "Exchange" not in plan(codebook.nearest_code(df, book, method=method))


def test_known_sizes_read_no_pixels(spark):
    text = plan(fx.sizes(spark, SF))
    assert "ReadSchema: struct<label:int>" in text


def test_known_sizes_broadcast(spark, tmp_path):
    df = slices_to_voxels(stored(spark, tmp_path))
    sizes = spark.createDataFrame([(0, 4, 8, 8)], "volume_id int, nz int, nx int, ny int")
    text = plan(tiling.center_crop(df, 4, 4, sizes))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_statistics_are_combined_before_the_shuffle(spark, tmp_path):
    from stratavox.operators.normalize import volume_stats

    text = plan(volume_stats(slices_to_voxels(stored(spark, tmp_path))))
    assert text.index("partial_min") > text.index("Exchange")


def test_common_names_use_one_pass(spark):
    assert plan(pairing.common_names(fx.files(spark, SF), 4)).count("FileScan") == 1


def test_pushed_filter(spark):
    text = plan(fx.checkpoint_paths(spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text
