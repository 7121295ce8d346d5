"""The scale primitives under skew, other partitionings and tight bounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox import scale
from stratavox.operators import recurrence, sampling
from stratavox.operators.histogram import hist_match
from stratavox.operators.metrics import value_counts


def skewed(spark, n=3000):
    """Two thirds of the rows share one key; values repeat."""
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).cast("int")
    value = F.floor(F.rand(5) * 400) / 100
    return spark.range(n).select(key.alias("k"), F.col("id"), value.alias("v"))


@pytest.mark.parametrize("bits", [3, 20])
def test_rank_ids_equals_a_window(spark, bits):
    rows = skewed(spark).withColumn("id", F.col("id") * 5 + 2)
    got = scale.rank_ids(rows, ["k"], "id", "z", bits).toPandas()
    want = got.sort_values("id").groupby("k").cumcount()
    assert (got.sort_values("id")["z"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("parts", ["1", "8"])
def test_prefix_sum_equals_pandas(spark, parts):
    counts = skewed(spark).groupBy("k", "v").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(coalesce, "false")
    try:
        got = scale.prefix_sum(counts, ["k"], ["v"], {"upto": F.col("count")}, rank="r", previous={"prev": "v"}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(coalesce, "true")
    got = got.sort_values(["k", "v"]).reset_index(drop=True)
    groups = got.groupby("k")
    assert (got["upto"] == groups["count"].cumsum()).all()
    assert (got["r"] == groups.cumcount() + 1).all()
    prev = groups["v"].shift()
    assert ((got["prev"] == prev) | (got["prev"].isna() & prev.isna())).all()


@pytest.mark.parametrize("bins,small", [(4096, 1_000_000), (4, 10), (16, 1)])
def test_exact_quantiles_in_many_rounds(spark, bins, small):
    df = skewed(spark).withColumn("v", F.when(F.col("id") == 7, 1e6).otherwise(F.col("v")))
    probs = {"a": 0.003, "b": 0.5, "c": 0.97, "d": 1.0}
    got = scale.exact_quantiles(df, ["k"], "v", probs, bins, small).toPandas().set_index("k")
    data = df.toPandas()
    for k, part in data.groupby("k"):
        for name, p in probs.items():
            assert np.isclose(got.loc[k, name], np.percentile(part["v"], p * 100))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_small_sides_beyond_the_bounds(spark, how):
    big = skewed(spark)
    small = big.where("k < 3").groupBy("k").agg(F.max("v").alias("m"))
    want = big.join(small, "k", how).count()
    for bounds in ({}, {"max_rows": 1}, {"max_bytes": 1}):
        assert scale.attach_small(big, small, ["k"], how, **bounds).count() == want
    plan = scale.attach_small(big, small, ["k"], how, max_rows=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "Generate" not in plan
    nested = spark.createDataFrame([([["ab"] * 50],)], "a array<array<string>>")
    assert scale.weigh(nested)[1] > 200


def test_long_keys_average_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "CHUNK", 16)
    rows = skewed(spark, 400).withColumnRenamed("k", "key")
    got = recurrence.ema(rows, ["id"], recurrence.warmup_decay).toPandas().sort_values("id")
    for _, part in got.groupby("key"):
        s, want = None, []
        for n, v in enumerate(part["v"]):
            d = min(0.9999, (1 + n) / (10 + n))
            s = v if s is None else s - (1 - d) * (s - v)
            want.append(s)
        assert np.allclose(part["ema"], want)


def test_batches_do_not_depend_on_partitioning(spark):
    ids = spark.range(500)
    one = sampling.shuffle_batches(ids.coalesce(1), "id", 32, seed=2, drop_last=True).toPandas()
    many = sampling.shuffle_batches(ids.repartition(13), "id", 32, seed=2, drop_last=True).toPandas()
    assert one.sort_values("id").reset_index(drop=True).equals(many.sort_values("id").reset_index(drop=True))
    assert (one.groupby("batch").size() == 32).all() and len(one) == 480


def test_matching_a_volume_with_itself(spark):
    rows = skewed(spark).withColumnRenamed("k", "volume_id")
    same = hist_match(rows, rows.withColumn("id", F.col("id")))
    moved = same.select("id", F.col("v").alias("w")).join(rows, "id").where(F.abs(F.col("v") - F.col("w")) > 1e-9)
    assert moved.count() == 0


def test_matching_equals_interpolation(spark):
    rng = np.random.default_rng(3)
    source, template = np.round(rng.random(300), 2), np.round(rng.random(200) ** 2, 2)
    make = lambda a: spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(a)], "volume_id int, id int, v double")
    got = hist_match(make(source), make(template)).orderBy("id").toPandas()["v"]
    sv, si, sc = np.unique(source, return_inverse=True, return_counts=True)
    tv, tc = np.unique(template, return_counts=True)
    want = np.interp(np.cumsum(sc) / 300, np.cumsum(tc) / 200, tv)[si]
    assert np.allclose(got, want)
    assert value_counts(make(source)).count() == len(sv)


@pytest.mark.parametrize("parts", ["1", "13"])
def test_carry_last_over_partition_ends(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(i), None if rng.random() < 0.9 else f"s{i}") for k in range(3) for i in rng.permutation(200 if k else 2000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(coalesce, "false")
    try:
        got = scale.carry_last(spark.createDataFrame(rows, "k int, at double, s string"), ["k"], ["at"], "s").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(coalesce, "true")
    want = pd.DataFrame(rows, columns=["k", "at", "s"]).sort_values(["k", "at"])
    want["s"] = want.groupby("k")["s"].ffill()
    got = got.sort_values(["k", "at"])
    assert [(x or None) for x in got["s"]] == [x if isinstance(x, str) else None for x in want["s"]]


def test_matching_with_a_background_of_a_third(spark):
    """One value on a third of the pixels of each side: the template's histogram is taken, and no cells are listed."""
    n = 30_000
    side = lambda seed, back: spark.range(n).select(
        F.lit("vol").alias("volume_id"), F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, back).otherwise(F.rand(seed)).alias("v")
    )
    source, template = side(1, 0.25).cache(), side(2, 0.75).cache()
    matched = hist_match(source, template)
    plan = matched._jdf.queryExecution().toString().lower()
    assert "sequence(" not in plan and "explode" not in plan
    got = matched.toPandas()
    s, t = source.toPandas()["v"].to_numpy(), template.toPandas()["v"].to_numpy()
    values, counts = np.unique(t, return_counts=True)
    own, at, n_own = np.unique(s, return_inverse=True, return_counts=True)
    want = np.interp(np.cumsum(n_own) / n, np.cumsum(counts) / n, values)[at]
    assert np.allclose(got.sort_values("x")["v"], want)


def test_average_of_a_million_rows_of_one_key(spark):
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 50 == 7, F.col("id")).otherwise(-1).cast("string").alias("key"), "id", F.rand(2).alias("v"), F.lit("x").alias("tag"))
    got = recurrence.ema(rows, ["id"], recurrence.warmup_decay).where("key = '-1'").orderBy("id").toPandas()
    assert (got["n"] == np.arange(len(got))).all() and (got["tag"] == "x").all() and len(got) == 980_000
    s = 0.0
    for i, (v, found) in enumerate(zip(got["v"].tolist(), got["ema"].tolist())):
        keep = 0.0 if i == 0 else min(0.9999, (1 + i) / (10 + i))
        s = keep * s + (1 - keep) * v
        assert abs(found - s) < 1e-9


def counted_source(spark, rows, schema):
    """A frame that counts how often its rows are produced."""
    seen = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return spark.createDataFrame(rows, schema).mapInPandas(passed, schema), seen


def test_quantiles_take_two_passes_whatever_the_values(spark):
    rng = np.random.default_rng(6)
    wild = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.5), 10.0 ** rng.uniform(-300, 300, 10_000), -(10.0 ** rng.uniform(-300, 300, 5_000))])
    df, seen = counted_source(spark, [(int(i % 3 == 0), float(v)) for i, v in enumerate(wild)], "k int, v double")
    probs = {"a": 0.001, "b": 0.5, "c": 0.999}
    got = scale.exact_quantiles(df, ["k"], "v", probs, accuracy=500).toPandas().set_index("k")
    assert seen.value == 2 * len(wild)
    for k in (0, 1):
        mine = np.array([v for i, v in enumerate(wild) if int(i % 3 == 0) == k])
        assert np.allclose(got.loc[k, list(probs)].to_numpy(float), np.percentile(mine, [0.1, 50, 99.9]), rtol=1e-9)
        assert (got.loc[k, "v_min"], got.loc[k, "v_max"], got.loc[k, "n"]) == (mine.min(), mine.max(), len(mine))


@pytest.mark.parametrize("small", [1, 1_000_000])
def test_quantiles_of_nan_and_infinity(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [("nan", v) for v in (1.0, nan, 3.0)] + [("inf", v) for v in (-inf, 1.0, 2.0, 4.0, inf)] + [("null", None), ("null", 7.0)] + [("none", None)]
    got = scale.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 1.0}, small=small).toPandas().set_index("k")
    assert sorted(got.index) == ["inf", "nan", "null"]
    assert got.loc["nan", ["lo", "mid", "hi", "v_min", "v_max"]].isna().all() and got.loc["nan", "n"] == 3
    assert got.loc["inf", ["lo", "mid", "hi"]].tolist() == [-inf, 2.0, inf]
    assert got.loc["null", ["lo", "mid", "hi", "n"]].tolist() == [7.0, 7.0, 7.0, 1]


def test_a_missed_rank_is_counted_again(spark, monkeypatch):
    """A sketch that answers beside the point costs one more pass, not a wrong result."""
    values = [(0, float(v)) for v in np.random.default_rng(8).permutation(5000)]
    wrong = scale.F.percentile_approx
    monkeypatch.setattr(scale.F, "percentile_approx", lambda col, at, accuracy: wrong(col, [0.0] * len(at), accuracy))
    got = scale.exact_quantiles(spark.createDataFrame(values, "k int, v double"), ["k"], "v", {"m": 0.5}, accuracy=20).collect()
    assert [r["m"] for r in got] == [2499.5]


def test_rank_of_text_and_sparse_ids(spark):
    rows = spark.range(4000).select((F.col("id") % 5 == 0).cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("name"), (F.col("id") * 2_000_000_011).alias("far"))
    for ids in ("name", "far"):
        ranked = scale.rank_rows(rows, ["k"], [ids], "z")
        assert dict(ranked.dtypes)["z"] == "bigint"
        got = ranked.toPandas().sort_values(["k", ids])
        assert (got["z"].to_numpy() == got.groupby("k").cumcount().to_numpy()).all()
    assert sorted(r["z"] for r in scale.rank_rows(rows, [], ["name"], "z").collect()) == list(range(4000))
