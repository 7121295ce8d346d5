"""Hand-made cases: tiny volumes, borders, ties, empty classes and the decided quirks."""

import math

import numpy as np
import pytest
from helpers import plane_rows, to_cube, to_planes, volume_rows
from pyspark.sql import functions as F

from stratavox.functions import kernels, pixel, vectors
from stratavox.operators import codebook, metrics, normalize, pairing, planes, pooling, register, tiling
from stratavox.operators.layout import slices_to_voxels, voxels_to_slices
from stratavox.plans.patch_preparation import prepare_patches


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def test_normalize_and_permute_small_cube(spark):
    cube = np.arange(8).reshape(2, 2, 2)
    df = volume_rows(spark, cube)
    assert np.allclose(to_cube(normalize.normalize(df, "01")), cube / 7)
    assert np.allclose(to_cube(normalize.normalize(df, "11")), cube / 7 * 2 - 1)
    assert np.array_equal(to_cube(tiling.permute(df, (2, 0, 1))), cube.transpose(2, 0, 1))
    with pytest.raises(ValueError):
        normalize.normalize(df, "12")


def test_constant_volume_gives_null(spark):
    df = normalize.normalize(volume_rows(spark, np.ones((1, 2, 2))), "01")
    assert df.where("v IS NULL").count() == 4


def test_percentile_clip_equals_numpy(spark):
    cube = np.random.default_rng(0).normal(size=(5, 6, 7))
    lo, hi = np.percentile(cube, [3, 92])
    assert np.allclose(to_cube(normalize.percentile_clip(volume_rows(spark, cube), 3, 92)), np.clip(cube, lo, hi))


def test_half_even_levels(spark):
    levels = [pixel.unsigned(F.lit(v / 255)) for v in (0.5, 1.5, 2.5)]
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(levels)])) == [0, 2, 2]


def test_parse_bool_rejects_other_words(spark):
    assert one(spark, pixel.parse_bool(F.lit("Yes")).alias("a"), pixel.parse_bool(F.lit("F")).alias("b")) == (True, False)
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, pixel.parse_bool(F.lit("maybe")).alias("a"))


def test_six_views_shapes(spark):
    views = tiling.six_views(volume_rows(spark, np.arange(24).reshape(2, 3, 4)))
    images = views.groupBy("view").agg(F.countDistinct("i").alias("n")).collect()
    assert sum(r["n"] for r in images) == 2 * (2 + 3 + 4)


@pytest.mark.parametrize("mode", range(8))
def test_dihedral_forms_and_inverse(spark, mode):
    image = np.arange(12).reshape(3, 4)
    out = to_cube(tiling.dihedral(volume_rows(spark, image[None]), mode))[0]
    h, w = image.shape
    source = {
        0: lambda i, j: (i, j),
        1: lambda i, j: (j, i),
        2: lambda i, j: (h - 1 - i, j),
        3: lambda i, j: (h - 1 - j, i),
        4: lambda i, j: (i, w - 1 - j),
        5: lambda i, j: (j, w - 1 - i),
        6: lambda i, j: (h - 1 - i, w - 1 - j),
        7: lambda i, j: (h - 1 - j, w - 1 - i),
    }[mode]
    for at, v in np.ndenumerate(out):
        assert v == image[source(*at)]
    inverse = {3: 5, 5: 3}.get(mode, mode)
    back = to_cube(tiling.dihedral(volume_rows(spark, out[None]), inverse))[0]
    assert np.array_equal(back, image)


def test_tile_grid_step_differs_from_block(spark):
    df = volume_rows(spark, np.zeros((1, 10, 1)))
    coded = tiling.tile_grid(df, (1, 4, 1), (1, 3, 1))
    sliding = tiling.tile_grid(df, (1, 4, 1), (1, 3, 1), origin="step")
    assert sorted(r["gx"] for r in coded.select("gx").distinct().collect()) == [0, 1]
    assert sorted(r["gx"] for r in sliding.select("gx").distinct().collect()) == [0, 1, 2]
    assert sliding.count() == 12


def test_overlap_tiles_anchor_the_last(spark):
    image = np.arange(17 * 17).reshape(17, 17)
    tiles = tiling.tile_overlap(plane_rows(spark, [image]), 8, 2, 10).orderBy("i").collect()
    assert [(t["top"], t["left"]) for t in tiles] == [(a, b) for a in (0, 6, 9) for b in (0, 6, 9)]
    assert np.array_equal(np.reshape(tiles[5]["data"], (8, 8)), image[6:14, 9:17])
    whole = tiling.tile_overlap(plane_rows(spark, [np.zeros((9, 17))]), 8, 2, 10).collect()
    assert len(whole) == 1 and len(whole[0]["data"]) == 9 * 17


def test_cut_patches_equals_numpy(spark):
    cube = np.arange(5 * 9 * 8, dtype=float).reshape(5, 9, 8)
    patches = tiling.cut_patches(plane_rows(spark, list(cube)), (2, 4, 3)).collect()
    assert len(patches) == 2 * 2 * 2
    for p in patches:
        z, x, y = p["gz"] * 2, p["gx"] * 4, p["gy"] * 3
        assert np.array_equal(np.reshape(p["data"], (2, 4, 3)), cube[z : z + 2, x : x + 4, y : y + 3])


def test_prepare_patches_keeps_channels_together(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((4, 8, 8)), rng.random((4, 8, 8))
    first, second = prepare_patches(
        [plane_rows(spark, list(a)), plane_rows(spark, list(b))], (2, 4, 4), ["11", "01"], (1, 99), bright=0.0, prefix="p"
    )
    assert sorted(r["name"] for r in first.collect()) == sorted(r["name"] for r in second.collect())
    lo, hi = np.percentile(a, [1, 99])
    want = (np.clip(a, lo, hi) - lo) / (hi - lo) * 2 - 1
    for r in first.collect():
        z, x, y = (int(r["name"][1:][i : i + 3]) for i in (6, 0, 3))
        part = want[2 * z : 2 * z + 2, 4 * x : 4 * x + 4, 4 * y : 4 * y + 4]
        assert part.mean() > 0 and np.allclose(np.reshape(r["data"], part.shape), part)


@pytest.mark.parametrize("norm", [None, "01", "zrescale"])
def test_rescale_modes(spark, norm):
    cube = np.random.default_rng(2).random((2, 4, 4)) * 9
    (out,) = prepare_patches([plane_rows(spark, list(cube))], (2, 4, 4), [norm], thresholds=[(1, 8)])
    held = np.clip(cube, 1, 8)
    if norm == "01":
        held = (held - held.min()) / (held.max() - held.min())
    if norm == "zrescale":
        held = np.log10(held + 1)
        held = np.clip((held - held.mean()) / held.std(), -6, 6) / 6
    assert np.allclose(np.reshape(out.head()["data"], cube.shape), held)


def test_projection_drops_the_tail(spark):
    df = volume_rows(spark, np.arange(7).reshape(7, 1, 1))
    assert to_cube(pooling.project_z(df, 3, "min")).ravel().tolist() == [0, 3]
    assert to_cube(pooling.project_z(df, 3, "mean")).ravel().tolist() == [1, 4]


def test_crop_z_of_full_depth_starts_at_zero(spark):
    df = volume_rows(spark, np.arange(4).reshape(4, 1, 1))
    assert to_cube(tiling.crop_z(df, 4, seed=3)).ravel().tolist() == [0, 1, 2, 3]
    assert tiling.crop_z(df, 0) is df


def test_modcrop_trims_each_axis(spark):
    assert to_cube(tiling.modcrop(volume_rows(spark, np.zeros((1, 7, 5))), 4)).shape == (1, 4, 4)


@pytest.mark.parametrize("mode", ["wrap", "mirror", "replicate", "symmetric", "zero"])
def test_kernel_flip_and_borders(spark, mode):
    pad_mode = {"wrap": "wrap", "mirror": "reflect", "replicate": "edge", "symmetric": "symmetric", "zero": "constant"}[mode]
    image = np.random.default_rng(3).random((5, 5))
    kernel = np.arange(9.0).reshape(3, 3)
    wide = np.pad(image, 1, mode=pad_mode)
    want = sum(kernel[ky, kx] * wide[2 - ky : 7 - ky, 2 - kx : 7 - kx] for ky in range(3) for kx in range(3))
    assert np.allclose(to_planes(planes.convolve(plane_rows(spark, [image]), kernel, mode))[0], want)
    assert np.allclose(to_planes(planes.pad(plane_rows(spark, [image]), 3, mode))[0], np.pad(image, 3, mode=pad_mode))


def test_large_kernels_take_the_spectral_way():
    rng = np.random.default_rng(4)
    image, kernel = rng.random((2, 30, 26, 3)), rng.random((11, 12))
    for flip in (False, True):
        fast = planes.correlate(image, kernel, "mirror", 2, flip)
        limit, planes.DIRECT_TAPS = planes.DIRECT_TAPS, 10_000
        slow = planes.correlate(image, kernel, "mirror", 2, flip)
        planes.DIRECT_TAPS = limit
        assert np.allclose(fast, slow)


def test_equal_images(spark):
    image = np.random.default_rng(5).random((16, 16)) * 255
    pairs = pairing.slice_pairs(plane_rows(spark, [image]), plane_rows(spark, [image]))
    assert math.isclose(planes.ssim(pairs).head()["ssim"], 1.0)
    levels = pairing.voxel_pairs(plane_rows(spark, [image]), plane_rows(spark, [image]))
    assert metrics.psnr(levels).head()["psnr"] == float("inf")


def test_shape_mismatch_is_an_error(spark):
    pairs = pairing.slice_pairs(plane_rows(spark, [np.zeros((4, 4))]), plane_rows(spark, [np.zeros((4, 5))]))
    with pytest.raises(Exception, match="differ in shape"):
        pairs.collect()


def test_ms_ssim_against_a_plain_computation(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((1, 32, 31, 1)) * 2 - 1, rng.random((1, 32, 31, 1)) * 2 - 1
    pairs = pairing.slice_pairs(plane_rows(spark, [a[0, ..., 0]]), plane_rows(spark, [b[0, ..., 0]]))
    got = planes.ms_ssim(pairs, win=7).head()["ms_ssim"]

    taps = np.exp(-((np.arange(7) - 3) ** 2) / 4.5)
    window = np.outer(taps, taps) / taps.sum() ** 2

    def smooth(m):
        return np.array([[np.sum(window * m[i : i + 7, j : j + 7]) for j in range(m.shape[1] - 6)] for i in range(m.shape[0] - 6)])

    def half(m):
        m = np.pad(m, [(n % 2, n % 2) for n in m.shape])
        h, w = m.shape[0] // 2 * 2, m.shape[1] // 2 * 2
        return m[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))

    x, y, value = a[0, ..., 0], b[0, ..., 0], 1.0
    for level, weight in enumerate(planes.MS_WEIGHTS):
        mx, my = smooth(x), smooth(y)
        sx, sy, sxy = smooth(x * x) - mx**2, smooth(y * y) - my**2, smooth(x * y) - mx * my
        contrast = (2 * sxy + 0.06**2) / (sx + sy + 0.06**2)
        full = (2 * mx * my + 0.02**2) / (mx**2 + my**2 + 0.02**2) * contrast
        value *= max((full if level == 2 else contrast).mean(), 0) ** weight
        x, y = half(x), half(y)
    assert math.isclose(got, value, rel_tol=1e-9, abs_tol=1e-12)


def scores(spark, rows):
    return spark.createDataFrame(rows, "id bigint, logits array<double>, label int")


def test_absent_class_and_first_maximum(spark):
    df = scores(spark, [(0, [1.0, 1.0, 0.0], 0), (1, [0.0, 2.0, 0.0], 1)])
    got = {r["cls"]: r["dice"] for r in metrics.dice(df, 3).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None}


def test_auc_with_ties_and_monotone_maps(spark):
    rows = [(i, [0.0, s], y) for i, (s, y) in enumerate([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.9, 0)])]
    assert math.isclose(metrics.auc_per_class(scores(spark, rows), 2).head()["auc"], 3.5 / 6)
    cubed = scores(spark, [(i, [0.0, v[1] ** 3], y) for i, v, y in rows])
    assert math.isclose(metrics.auc_per_class(cubed, 2).head()["auc"], 3.5 / 6)
    lonely = scores(spark, [(0, [0.0, 0.5], 1)])
    assert metrics.auc_per_class(lonely, 2).head()["auc"] is None


def test_contrast_flip(spark):
    df = spark.createDataFrame([([0.0], [2.0], 1)], "f1 array<double>, f2 array<double>, target int")
    assert math.isclose(metrics.contrastive(df, 3.0).head()["mean"], 0.5 * (3 - math.sqrt(4 + 1e-9)) ** 2)
    assert math.isclose(metrics.contrastive(df, 3.0, flip=True).head()["mean"], 2.0)


@pytest.mark.parametrize("method", ["expression", "arrow"])
def test_equal_distances_take_the_lowest_code(spark, method):
    book = spark.createDataFrame([(5, [0.0]), (3, [2.0])], "code int, c array<double>")
    df = spark.createDataFrame([([1.0],), ([1.9],), ([-4.0],)], "f array<double>")
    got = [r["code"] for r in codebook.nearest_code(df, book, method=method).collect()]
    assert got == [3, 3, 5]


def test_codes_map_to_themselves(spark):
    book = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(8)], "code int, c array<double>")
    again = codebook.nearest_code(book.withColumnRenamed("code", "was").withColumnRenamed("c", "f"), book)
    assert all(r["was"] == r["code"] and r["d2"] == 0 for r in again.collect())


@pytest.mark.parametrize("side", [9, 20])
def test_known_shift_is_measured_and_undone(spark, side):
    rng = np.random.default_rng(7)
    base = np.zeros((side, side))
    base[2:6, 4:8] = rng.random((4, 4)) + 1
    moved = np.roll(base, (1, -2), axis=(0, 1))
    df = plane_rows(spark, [base, moved])
    shifts = register.slice_shifts(df).orderBy("z").collect()
    assert [(r["dy"], r["dx"]) for r in shifts] == [(0, 0), (1, -2)]
    assert np.allclose(to_planes(register.align(df))[1], base)
    doubled = to_planes(register.align(df, sign=1))[1]
    assert np.allclose(doubled, np.roll(base, (2, -4), axis=(0, 1)))


def test_registration_cleans_nan(spark):
    image = np.random.default_rng(8).random((5, 5))
    broken = image.copy()
    broken[0, 0] = np.nan
    r = register.slice_shifts(plane_rows(spark, [image, broken])).where("z = 1").head()
    assert (r["dy"], r["dx"]) == (0, 0)


def test_round_trip_of_layouts(spark):
    cube = np.random.default_rng(9).random((3, 4, 5))
    back = voxels_to_slices(slices_to_voxels(plane_rows(spark, list(cube))))
    assert np.array_equal(np.stack(to_planes(back)), cube)


def test_let_binds_once(spark):
    row = one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)), 0.0).alias("f"))
    assert np.allclose(row["f"], [0.6, 0.8])


@pytest.mark.parametrize("method,scale", [("linear", None), ("cubic", None), ("area", None), ("coverage", None), ("matlab", 0.4), ("nearest", None)])
@pytest.mark.parametrize("n,m", [(10, 4), (7, 7), (5, 12)])
def test_resize_weights_sum_to_one(method, scale, n, m):
    taps = kernels.resize_weights(method, n, m, None if scale is None else m / n)
    w = taps.dense()
    line = np.random.default_rng(n).random((3, n))
    assert np.allclose(taps.along(line, 1), line @ w.T)
    limit, kernels.SMALL_MATRIX = kernels.SMALL_MATRIX, 0
    assert np.allclose(taps.along(line, 1), line @ w.T)
    kernels.SMALL_MATRIX = limit
    assert w.shape == (m, n) and np.allclose(w.sum(1), 1)
    if n == m:
        assert np.allclose(w, np.eye(n))
