"""Cases off the fixtures: extreme decays, many codes, ties, gray images, other keys, missing slices."""

import numpy as np
import pandas as pd
import pytest
from helpers import plane_rows, to_planes
from pyspark.sql import functions as F

from stratavox.operators import codebook, contrast, degrade, planes, recurrence, register, resample, tiling


@pytest.mark.parametrize("decay", [0.999, 0.5, 0.0])
def test_averages_of_any_decay(spark, monkeypatch, decay):
    monkeypatch.setattr(recurrence, "CHUNK", 64)
    values = np.random.default_rng(1).normal(size=5000)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "key string, id long, v double")
    got = recurrence.ema(rows, ["id"], lambda n: F.lit(decay)).orderBy("id").toPandas()["ema"]
    want, s = [], None
    for v in values:
        s = v if s is None else decay * s + (1 - decay) * v
        want.append(s)
    assert np.allclose(got, want)


def test_codes_beyond_two_bytes_and_exact_ties(spark, monkeypatch):
    monkeypatch.setattr(codebook, "CODE_BLOCK", 7)
    draw = np.random.default_rng(2)
    centers = np.round(draw.random((60, 5)), 1)
    centers[40] = centers[3]
    codes = [40_000 + i for i in range(60)]
    book = spark.createDataFrame([(c, [float(v) for v in row]) for c, row in zip(codes, centers)], "code int, c array<double>")
    x = np.vstack([centers, np.round(draw.random((200, 5)), 1)])
    features = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, f array<double>")
    d2 = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    for method in ("arrow", "expression"):
        got = codebook.nearest_code(features, book, method=method).orderBy("id").toPandas()
        assert np.allclose(got["d2"], d2.min(axis=1))
        assert got["code"].tolist()[:60] == [40_000 + (3 if i == 40 else int(np.argmin(d2[i]))) for i in range(60)]


def test_scores_use_every_position(spark):
    draw = np.random.default_rng(3)
    rows = [(side, 0, p, [float(v) for v in draw.random(4)]) for p in range(300) for side in "qk"]
    features = spark.createDataFrame(rows, "side string, image_id int, pos int, f array<double>")
    assert contrast.patch_nce(features).count() == 300
    assert contrast.patch_nce(features, patches=12, seed=1).count() == 12


def test_ties_do_not_depend_on_the_transform(monkeypatch):
    draw = np.random.default_rng(4)
    images = (draw.random((40, 20, 20)) < 0.03).astype(float)
    reference = (draw.random((20, 20)) < 0.03).astype(float)
    refs = np.repeat(reference[None], 40, axis=0)
    fast = register.full_correlation(images, refs)
    got = [register.first_peak(c, i, reference) for c, i in zip(fast, images)]
    monkeypatch.setattr(register, "DIRECT_SIDE", 32)
    direct = register.full_correlation(images, refs)
    assert got == direct.reshape(40, -1).argmax(axis=1).tolist()


def test_gray_images_degrade(spark):
    df = plane_rows(spark, [np.random.default_rng(i).random((32, 32)) for i in range(4)])
    for out in (degrade.degrade_bsrgan(df, 4, 5, seed=1), degrade.degrade_plus(df, 2, 0.5, True, 10, seed=1)):
        rows = out.collect()
        assert all(len(r["data"]) == r["h"] * r["w"] and len(r["hq"]) % len(r["data"]) == 0 and len(r["hq"]) for r in rows)
    assert all(a.shape == (32, 32) for a in to_planes(degrade.poisson_noise(df, seed=1)))
    twice = degrade.add_two_part_noise(df, 0.1, 50.0, seed=2)
    assert [a.shape for a in to_planes(twice)] == [(32, 32)] * 4
    assert not np.allclose(to_planes(twice)[0], to_planes(degrade.add_shot_noise(df, 50.0, seed=2))[0])


def test_orders_keep_the_first_shrink_first(spark):
    rows = spark.range(50).select(F.col("id").alias("volume_id"), F.lit(0).alias("z"))
    orders = rows.select(degrade.in_turn(degrade.step_order(7, 3), 2, 3).alias("o")).collect()
    assert all(sorted(r["o"]) == list(range(7)) and r["o"].index(2) < r["o"].index(3) for r in orders)


def test_shrinking_to_nothing_is_an_error():
    with pytest.raises(ValueError, match="shrinks to nothing"):
        degrade._resized(np.ones((3, 3, 1)), 0, 3, 0.5)


def test_batches_of_oblong_images(spark):
    df = plane_rows(spark, [np.random.default_rng(0).random((32, 16))])
    row = planes.batch_resize(df, F.lit(1), 32, 32, seed=1).head()
    assert (row["h"], row["w"], len(row["data"])) == (32, 32, 32 * 32 * 3)


def test_volumes_named_by_strings(spark):
    df = plane_rows(spark, [np.full((4, 6), float(z)) for z in range(4)]).withColumn("volume_id", F.lit("stack-a"))
    out = resample.resample(df, size=(7, 4, 6))
    assert dict(out.dtypes)["volume_id"] == "string" and out.count() == 7
    with pytest.raises(Exception, match="lacks slices"):
        resample.resample(df.where("z <> 1"), size=(7, 4, 6)).collect()


def test_blocks_that_lack_a_slice_are_dropped(spark):
    df = plane_rows(spark, [np.full((4, 4), float(z)) for z in range(4)]).where("z <> 2")
    got = tiling.cut_patches(df, (2, 2, 2)).collect()
    assert {r["gz"] for r in got} == {0} and {len(r["data"]) for r in got} == {8}


@pytest.mark.parametrize("side", [8, 24])
@pytest.mark.parametrize("subpixel", [False, True])
def test_one_pass_alignment_equals_measuring_and_moving(spark, side, subpixel):
    rng = np.random.default_rng(5)
    base = rng.random((side, side))
    images = [np.roll(base, (k % 3 - 1, k % 2), axis=(0, 1)) for k in range(7)]
    slices = plane_rows(spark, images)
    plan = register.align(slices, subpixel=subpixel)
    shifts = register.slice_shifts(slices, subpixel=subpixel)
    want = planes.apply_shift(slices.join(shifts, ["volume_id", "z"]), None, sign=-1, fill=0.0)
    for a, b in zip(to_planes(plan), to_planes(want.select(*slices.columns))):
        assert np.allclose(a, b)
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()


def test_stacking_images_of_two_sizes(spark):
    rng = np.random.default_rng(7)
    big = [rng.random((6, 9)), rng.random((4, 4)), rng.random((6, 9))]
    low = [rng.random((3, 3, 2)), rng.random((2, 2, 2)), np.full((2, 5, 2), 0.5)]
    got = to_planes(planes.resize_and_stack(plane_rows(spark, big), plane_rows(spark, low)))
    assert [g.shape for g in got] == [(6, 9, 3), (4, 4, 3), (6, 9, 3)]
    for g, image in zip(got, big):
        assert np.allclose(g[..., 0], image)
    assert np.allclose(got[2][..., 1:], 0.5) and np.allclose(got[1][0, 0, 1:], low[1][0, 0])


def blobs(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10]])
    x = centers[rng.integers(0, 4, n)] + rng.normal(0, 0.3, (n, 2))
    return centers, x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, f array<double>")


def test_lloyd_rounds_equal_plain_ones(spark):
    _, x, df = blobs(spark)
    book = np.array([[1.0, 1], [2, 2], [9, 9], [500, 500]])
    start = spark.createDataFrame([(k * 7, c.tolist()) for k, c in enumerate(book)], "code int, c array<double>")
    got = codebook.refine_codebook(df.repartition(5), start, 4).orderBy("code").collect()
    for _ in range(4):
        to = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        book = np.array([x[to == k].mean(axis=0) if (to == k).any() else book[k] for k in range(4)])
    assert [r["code"] for r in got] == [0, 7, 14, 21]
    assert np.allclose([r["c"] for r in got], book) and got[3]["c"] == [500.0, 500.0]


def test_learned_codes_find_the_blobs_however_rows_lie(spark):
    centers, _, df = blobs(spark)
    one = codebook.fit_codebook(df.coalesce(1), 4, seed=2).orderBy("code").collect()
    many = codebook.fit_codebook(df.repartition(9), 4, seed=2).orderBy("code").collect()
    assert np.allclose([r["c"] for r in one], [r["c"] for r in many])
    found = np.array(sorted(r["c"] for r in one))
    assert np.allclose(found, sorted(centers.tolist()), atol=0.2)
    few = codebook.fit_codebook(df.limit(2), 4, seed=2)
    assert few.count() == 2


def test_codes_are_learned_when_tasks_have_no_rows(spark):
    centers, x, df = blobs(spark, 6)
    missing = spark.createDataFrame([(99, None), (98, [])], "id int, f array<double>")
    start = spark.createDataFrame([(0, centers[0].tolist()), (1, [500.0, 500.0])], "code int, c array<double>")
    got = codebook.refine_codebook(df.repartition(40).union(missing), start, 1).orderBy("code").collect()
    assert np.allclose([r["c"] for r in got], [x.mean(axis=0), [500, 500]])
    assert codebook.fit_codebook(df.repartition(40), 3, seed=2).count() == 3


def test_planes_are_worked_on_in_pieces_of_bounded_size(spark):
    rows = spark.range(3000, numPartitions=1).selectExpr(
        "id", "IF(id % 2 = 0, NULL, CAST(id AS int)) AS odd", "IF(id = 5, double('nan'), 1D) AS real", "timestamp_seconds(id) AS at", "array_repeat(id + 0D, 576) AS data"
    )

    def measure(piece):
        return pd.DataFrame({"first": [d[0] for d in piece["data"]], "n": [len(piece)] * len(piece)})

    got = planes.map_batches(rows, measure, ["data"], "first double, n int").orderBy("id").toPandas()
    assert got.columns.tolist() == ["id", "odd", "real", "at", "first", "n"]
    assert got["n"].max() * 576 * 8 <= planes.PIECE_BYTES and got["first"].tolist() == list(range(3000))
    want = rows.drop("data").toPandas()
    assert got[want.columns.tolist()].equals(want)
    wide = spark.createDataFrame([(k, [0.5] * 200_000) for k in range(3)], "id int, data array<double>")
    assert planes.map_batches(wide.coalesce(1), measure, ["data"], "first double, n int").select("n").collect() == [(1,)] * 3


def test_pieces_shrink_with_what_is_made_of_them(spark):
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "array_repeat(id + 0D, 64) AS data")

    def widen(piece):
        return pd.DataFrame({"data": [np.tile(d, 100) for d in piece["data"]], "n": [len(piece)] * len(piece)})

    got = planes.map_batches(rows, widen, ["data"], "data array<double>, n int").selectExpr("id", "data[6399] AS last", "n").orderBy("id").toPandas()
    assert got["n"].max() * 6400 * 8 <= planes.PIECE_BYTES and got["n"].max() > 16 and got["last"].tolist() == list(range(3000))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: degrade.degrade_bsrgan(d, 4, 5, seed=1),
        lambda d: degrade.degrade_variant(d, 4, seed=1),
        lambda d: degrade.degrade_plus(d, 2, 0.5, True, 10, seed=1),
    ],
)
def test_recipes_pass_python_once(spark, run):
    rng = np.random.default_rng(9)
    df = plane_rows(spark, [rng.random((33, 35, 3)) for _ in range(5)])
    out = run(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.count() == 5
