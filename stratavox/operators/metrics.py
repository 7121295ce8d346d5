"""Quality and evaluation metrics.

Pair metrics take the output of ``pairing.voxel_pairs`` or block-row pairs; every mean is an ordinary aggregate,
combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions import draws, vectors
from stratavox.scale import attach_small, prefix_sum

LOG_2PI = 1.8378770664093453


def l1_l2(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    diff = F.col("a") - F.col("b")
    return pairs.groupBy(*keys).agg(F.avg(F.abs(diff)).alias("l1"), F.avg(diff * diff).alias("l2"))


def psnr(
    pairs: DataFrame, keys: Sequence[str] = ("volume_id", "z"), border: int = 0, sizes: DataFrame | None = None
) -> DataFrame:
    """20 log10(255 / rmse) per image on [0, 255] levels; infinite for equal images."""
    if border:
        from stratavox.operators.tiling import shave

        pairs = shave(pairs, border, sizes)
    diff = F.col("a").cast("double") - F.col("b")
    mse = pairs.groupBy(*keys).agg(F.avg(diff * diff).alias("mse"))
    # 20 log10(255 / sqrt(mse)), written so that a zero error is decided before the division.
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(
        F.lit(20.0) * F.log10(F.try_divide(F.lit(255.0), F.sqrt("mse")))
    )
    return mse.select(*keys, value.alias("psnr"))


def cross_entropy(logits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    loss = vectors.log_sum_exp(F.col("logits")) - F.get("logits", F.col("label"))
    return logits.groupBy(*keys).agg(F.avg(loss).alias("cross_entropy"))


def dice(logits: DataFrame, classes: int) -> DataFrame:
    """2 TP / (predicted + true) per class; NULL for a class that is neither predicted nor true."""
    pred = vectors.first_argmax(F.col("logits"))
    votes = F.array(
        F.struct(pred.alias("cls"), (pred == F.col("label")).cast("long").alias("tp")),
        F.struct(F.col("label").alias("cls"), F.lit(0).cast("long").alias("tp")),
    )
    sums = (
        logits.select(F.explode(votes).alias("s"))
        .groupBy("s.cls")
        .agg(F.sum("s.tp").alias("tp"), F.count(F.lit(1)).alias("div"))
    )
    every = logits.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(sums, "cls", "left").select("cls", F.try_divide(2.0 * F.col("tp"), F.col("div")).alias("dice"))


def dual_half(first: DataFrame, second: DataFrame, metric, *args) -> DataFrame:
    """A metric over the union of two halves."""
    return metric(first.unionByName(second), *args)


def classify_and_contrast(first: DataFrame, second: DataFrame, pairs: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean of the cross entropies of two halves; the pair term is reported and has weight 0."""
    halves = cross_entropy(first.withColumn("half", F.lit(0)).unionByName(second.withColumn("half", F.lit(1))), ["half"])
    entropy = halves.agg(F.avg("cross_entropy").alias("classify")).withColumn("_one", F.lit(1))
    pair = contrastive(pairs, margin).select(F.col("mean").alias("contrast"), F.lit(1).alias("_one"))
    return entropy.join(pair, "_one").select(
        "classify", "contrast", (F.col("classify") + F.col("contrast") * 0).alias("total")
    )


def roc_points(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running true and false positives by falling score, ties grouped, with the point before."""
    ties = scores.groupBy(*keys, "score").agg(
        F.sum("positive").alias("tp_here"), F.sum(1 - F.col("positive")).alias("fp_here")
    )
    run = prefix_sum(ties, keys, [-F.col("score")], {"tp": F.col("tp_here"), "fp": F.col("fp_here")})
    return run.withColumns({"tp_before": F.col("tp") - F.col("tp_here"), "fp_before": F.col("fp") - F.col("fp_here")})


def class_scores(logits: DataFrame, classes: int) -> DataFrame:
    """One row per sample and class from 1 up: score in column n, positive if the label is n."""
    each = F.posexplode(F.slice("logits", 2, classes - 1)).alias("_i", "score")
    return logits.select("label", each).select(
        (F.col("_i") + 1).alias("cls"), "score", (F.col("label") == F.col("_i") + 1).cast("long").alias("positive")
    )


def auc_per_class(logits: DataFrame, classes: int) -> DataFrame:
    """One-vs-rest area under the ROC polygon; NULL if a class or its rest is empty."""
    points = roc_points(class_scores(logits, classes), ["cls"])
    area = (F.col("fp") - F.col("fp_before")) * (F.col("tp") + F.col("tp_before")) / 2.0
    sums = points.groupBy("cls").agg(
        F.sum(area).alias("area"), F.sum("tp_here").alias("p"), F.sum("fp_here").alias("n")
    )
    return sums.select("cls", F.try_divide("area", F.col("p") * F.col("n")).alias("auc"))


def contrastive(pairs: DataFrame, margin: float, flip: bool = False) -> DataFrame:
    """Pairs ``f1, f2, target``. The weight of the pull term is 1 - target (``flip`` uses target)."""
    d2 = vectors.squared_distance(F.col("f1"), F.col("f2"))
    with_d = pairs.withColumn("_d2", d2).withColumn("_t", F.col("target") if flip else 1 - F.col("target"))
    push = F.greatest(F.lit(margin) - F.sqrt(F.col("_d2") + 1e-9), F.lit(0.0))
    loss = 0.5 * (F.col("_t") * F.col("_d2") + (1 - F.col("_t")) * push * push)
    return with_d.agg(F.avg(loss).alias("mean"), F.sum(loss).alias("sum"))


def commitment_loss(pairs: DataFrame, beta: float = 0.25) -> DataFrame:
    diff = F.col("a") - F.col("b")
    return pairs.agg(((1.0 + beta) * F.avg(diff * diff)).alias("commitment"))


def _softplus(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def gan_score(scores: DataFrame, mode: str, real: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Mean adversarial score of ``p``. 'nonsaturating' keeps one mean per sample when ``keys`` name it."""
    return scores.groupBy(*keys).agg(F.avg(gan_loss(mode, F.lit(real))).alias("score"))


def gan_loss(mode: str, real: Column, score: str = "p") -> Column:
    """Adversarial loss of one score; ``real`` may differ from row to row, so that one scan serves both sides."""
    p = F.col(score)
    target = F.when(real, F.lit(1.0)).otherwise(0.0)
    signed = F.when(real, -p).otherwise(p)
    return {"vanilla": _softplus(signed), "lsgan": (p - target) * (p - target), "wgangp": signed, "nonsaturating": _softplus(signed)}[mode]


def hinge_d(scores: DataFrame, weight: Column | None = None) -> DataFrame:
    """Columns ``real`` and ``fake`` per sample; plain or exemplar-weighted mean of the two hinges, halved."""
    w = F.lit(1.0) if weight is None else weight
    up, down = F.greatest(1.0 - F.col("real"), F.lit(0.0)), F.greatest(1.0 + F.col("fake"), F.lit(0.0))
    value = 0.5 * (F.try_divide(F.sum(w * up), F.sum(w)) + F.try_divide(F.sum(w * down), F.sum(w)))
    return scores.agg(value.alias("hinge"))


def cycle_identity_l1(terms: DataFrame, cycle_weight: float, identity_weight: float) -> DataFrame:
    """Rows ``kind`` in (cycle_a, cycle_b, identity_a, identity_b) with a, b; halves averaged, then weighted."""
    diff = F.abs(F.col("a") - F.col("b"))

    def mean(kind: str) -> Column:
        return F.avg(F.when(F.col("kind") == kind, diff))

    cycle = (mean("cycle_a") + mean("cycle_b")) / 2
    identity = (mean("identity_a") + mean("identity_b")) / 2
    return terms.agg(cycle.alias("cycle"), identity.alias("identity")).withColumn(
        "total", F.col("cycle") * cycle_weight + F.col("identity") * identity_weight
    )


def clamp_logvar(logvar: Column) -> Column:
    return F.transform(logvar, lambda v: F.greatest(F.least(v, F.lit(20.0)), F.lit(-30.0)))


def gaussian_kl(mean: Column, logvar: Column, other: tuple[Column, Column] | None = None, deterministic: bool = False) -> Column:
    """Divergence of a diagonal Gaussian from the standard normal or from ``other``."""
    if deterministic:
        return F.lit(0.0)
    lv = clamp_logvar(logvar)
    if other is None:
        return 0.5 * vectors.total(F.zip_with(mean, lv, lambda m, v: m * m + F.exp(v) - 1.0 - v))
    mean2, lv2 = other[0], clamp_logvar(other[1])
    shift = F.zip_with(mean, mean2, lambda a, b: (a - b) * (a - b))
    pull = F.zip_with(shift, lv2, lambda d, v: d / F.exp(v))
    spread = F.zip_with(lv, lv2, lambda a, b: F.exp(a) / F.exp(b) - 1.0 - a + b)
    return 0.5 * (vectors.total(pull) + vectors.total(spread))


def normal_kl(mean1: Column, logvar1: Column, mean2: Column, logvar2: Column) -> Column:
    """Element-wise divergence of two normals given as scalars."""
    return 0.5 * (
        -1.0 + logvar2 - logvar1 + F.exp(logvar1 - logvar2) + (mean1 - mean2) * (mean1 - mean2) * F.exp(-logvar2)
    )


def gaussian_nll(mean: Column, logvar: Column, sample: Column) -> Column:
    lv = clamp_logvar(logvar)
    off = F.zip_with(sample, mean, lambda s, m: (s - m) * (s - m))
    return 0.5 * vectors.total(F.zip_with(off, lv, lambda d, v: LOG_2PI + v + d / F.exp(v)))


def posterior_sample(posterior: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """mean + deviation * normal draw, one row per entry; the draw is keyed on (id, place)."""
    rows = posterior.select(id_col, F.posexplode(F.arrays_zip("mean", "logvar")).alias("pos", "p"))
    lv = F.greatest(F.least(F.col("p.logvar"), F.lit(20.0)), F.lit(-30.0))
    noise = draws.gaussian(seed, "posterior", F.col(id_col), F.col("pos"))
    return rows.select(id_col, "pos", (F.col("p.mean") + F.exp(0.5 * lv) * noise).alias("sample"), F.col("p.mean").alias("mode"))


def nll_scaled(rec: DataFrame, logvar: float, batch: str = "volume_id", weight: Column | None = None) -> DataFrame:
    """rec / exp(logvar) + logvar, summed and divided by the number of batch entries."""
    nll = F.col("rec") / F.exp(F.lit(logvar)) + logvar
    w = F.lit(1.0) if weight is None else weight
    n = F.countDistinct(batch)
    per = rec.groupBy(batch).agg(F.sum(nll).alias("_nll"), F.sum(w * nll).alias("_weighted"))
    return per.agg((F.sum("_nll") / n).alias("nll"), (F.sum("_weighted") / n).alias("weighted_nll"))


def weighted_total(metrics: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of named terms times their weights; a term without a weight counts once. Names and parts stay visible."""
    terms = attach_small(metrics, weights, ["name"], "left")
    part = F.col("value") * F.coalesce("weight", F.lit(1.0))
    return terms.groupBy(*keys).agg(F.sum(part).alias("total"), F.count(F.lit(1)).alias("terms"))


def label_swap(features: DataFrame, signs: DataFrame, depth: int) -> DataFrame:
    """Multiply rows by the sign of their sample; sample s spans rows s * depth up to the next."""
    rows = features.withColumn("sample", F.floor(F.col("row") / depth).cast("int"))
    return attach_small(rows, signs, ["sample"]).withColumn("v", F.col("v") * F.col("sign")).drop("sign")


def slice_pool(df: DataFrame, value: str = "v") -> DataFrame:
    """Mean of each slice, then the largest over slices."""
    means = df.groupBy("volume_id", "z").agg(F.avg(value).alias("_m"))
    return means.groupBy("volume_id").agg(F.max("_m").alias("pooled"))


def value_counts(df: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "v", previous: bool = False) -> DataFrame:
    """Distinct values with count, running share, and total; optionally the next smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sum(
        counts,
        keys,
        [value],
        {"upto": F.col("n")},
        previous={"prev": value} if previous else None,
        totals_of={"total": "upto"},
    )
    return run.withColumn("cdf", F.col("upto") / F.col("total"))
