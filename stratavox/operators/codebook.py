"""Codebook compression: nearest code, lookup, remapping, encode and decode of volumes.

A codebook is a model parameter of at most ``MAX_CODES`` codes; its size is checked before it is sent to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.functions import draws, vectors
from stratavox.operators.planes import map_batches
from stratavox.operators.tiling import extents
from stratavox.scale import attach_small

MAX_CODES = 65_536
CODE_BLOCK = 1024


def _load(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = codebook.orderBy("code").limit(MAX_CODES + 1).toPandas()
    if len(rows) > MAX_CODES:
        raise ValueError(f"a codebook may hold {MAX_CODES} codes")
    return rows["code"].to_numpy(), np.stack(rows["c"].to_numpy()).astype(float)


def nearest_code(
    features: DataFrame, codebook: DataFrame | tuple[np.ndarray, np.ndarray], feature: str = "f", method: str = "arrow"
) -> DataFrame:
    """Add ``code`` (int) and ``d2``; equal distances go to the lowest code. The feature side is never shuffled.

    The codebook is a table (code, c) or, already loaded, its codes in order and their vectors.

    The codebook is a broadcast variable, searched in Arrow batches by a matrix product per block of codes; every code that
    rounding could have hidden is measured again directly. ``method='expression'`` searches an array literal instead.
    """
    codes, centers = codebook if isinstance(codebook, tuple) else _load(codebook)
    if method == "expression":
        entries = F.array(
            *[
                F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("c"), F.lit(int(code)).alias("code"))
                for code, row in zip(codes, centers)
            ]
        )
        best = F.array_min(
            F.transform(
                entries,
                lambda e: F.struct(vectors.squared_distance(F.col(feature), e["c"]).alias("d2"), e["code"].alias("code")),
            )
        )
    elif method == "arrow":
        shared = features.sparkSession.sparkContext.broadcast((codes, centers))

        def search(batch: pd.DataFrame) -> pd.DataFrame:
            ids, table = shared.value
            x = np.stack(batch[feature].to_numpy()).astype(float)
            best_d2 = np.full(len(x), np.inf)
            best_code = np.zeros(len(x), dtype=np.int32)
            norms = (x**2).sum(axis=1)
            for begin in range(0, len(ids), CODE_BLOCK):
                part = table[begin : begin + CODE_BLOCK]
                part_norms = (part**2).sum(axis=1)
                rough = norms[:, None] - 2 * (x @ part.T) + part_norms
                slack = 1e-9 * (norms + part_norms.max())
                rows, cols = np.nonzero(rough <= np.minimum(rough.min(axis=1), best_d2 + slack)[:, None] + slack[:, None])
                d2 = ((x[rows] - part[cols]) ** 2).sum(axis=1)
                by = np.lexsort((cols, d2, rows))
                first = by[np.diff(rows[by], prepend=-1) != 0]
                at, closer = rows[first], d2[first] < best_d2[rows[first]]
                best_d2[at[closer]], best_code[at[closer]] = d2[first][closer], ids[begin + cols[first]][closer]
            return pd.DataFrame({feature: batch[feature], "code": best_code, "d2": best_d2})

        kind = dict(features.dtypes)[feature]
        return map_batches(features, search, [feature], f"`{feature}` {kind}, code int, d2 double")
    else:
        raise ValueError("method is 'expression' or 'arrow'")
    found = features.withColumn("_best", best)
    return found.select(*features.columns, F.col("_best.code").cast("int").alias("code"), F.col("_best.d2").alias("d2"))


def remap_codes(codes: DataFrame, used: DataFrame) -> DataFrame:
    """Number the used codes 0, 1, ... in code order; every other code gets the number after them."""
    kept = [r["code"] for r in used.select("code").distinct().orderBy("code").limit(MAX_CODES + 1).collect()]
    if len(kept) > MAX_CODES:
        raise ValueError(f"a codebook may hold {MAX_CODES} codes")
    rows = [(int(c), i) for i, c in enumerate(kept)]
    numbers = codes.sparkSession.createDataFrame(rows, "_code int, index int")
    same = F.col("code").cast("int") == F.col("_code")
    return codes.join(F.broadcast(numbers), same, "left").drop("_code").withColumn("index", F.coalesce("index", F.lit(len(kept))))


def code_lookup(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """Codes to vectors."""
    return attach_small(codes, codebook.withColumn("code", F.col("code").cast("int")), ["code"])


def usage(codes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Perplexity exp(-sum p ln(p + 1e-10)) and number of codes in use."""
    keys = keys or []
    counts = codes.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    totals = codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    if not keys:
        counts, totals, keys = counts.withColumn("_one", F.lit(1)), totals.withColumn("_one", F.lit(1)), ["_one"]
    p = F.col("n") / F.col("total")
    out = counts.join(totals, keys).groupBy(*keys).agg(
        F.exp(-F.sum(p * F.ln(p + 1e-10))).alias("perplexity"), F.count(F.lit(1)).alias("codes_used")
    )
    return out.drop("_one")


def slice_tiles(slices: DataFrame, p: int) -> DataFrame:
    """Cut block rows into p x p vectors: keys plus (gx, gy), no shuffle."""
    rows = F.sequence(F.lit(0), F.floor(F.col("h") / p).cast("int") - 1)
    cols = F.sequence(F.lit(0), F.floor(F.col("w") / p).cast("int") - 1)
    spread = slices.select("volume_id", "z", "w", "data", F.explode(rows).alias("gx"), cols.alias("_c")).select(
        "volume_id", "z", "w", "data", "gx", F.explode("_c").alias("gy")
    )
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)),
            lambda r: F.slice(F.col("data"), (F.col("gx") * p + r) * F.col("w") + F.col("gy") * p + 1, F.lit(p)),
        )
    )
    return spread.select("volume_id", "z", "gx", "gy", cut.alias("f"))


def encode_volume(slices: DataFrame, codebook: DataFrame, p: int) -> DataFrame:
    """Slices to a table of small codes."""
    return nearest_code(slice_tiles(slices, p), codebook).select("volume_id", "z", "gx", "gy", "code")


def decode_volume(codes: DataFrame, codebook: DataFrame, p: int) -> DataFrame:
    """Codes to voxels."""
    cells = code_lookup(codes, codebook).select("volume_id", "z", "gx", "gy", F.posexplode("c").alias("_i", "v"))
    return cells.select(
        "volume_id",
        "z",
        (F.col("gx") * p + F.floor(F.col("_i") / p)).cast("int").alias("x"),
        (F.col("gy") * p + F.col("_i") % p).cast("int").alias("y"),
        "v",
    )


def code_sums(coded: DataFrame, feature: str = "f") -> DataFrame:
    """(code, n, total): count and vector sum of the features of each code; a task sends one row per code it met."""
    size = F.size(feature)
    made = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            codes, x = batch["code"].to_numpy(), np.stack(batch[feature].to_numpy()).astype(float)
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.diff(codes[order], prepend=codes[order][0] - 1))
            sums, counts = np.add.reduceat(x[order], first, axis=0), np.diff(np.append(first, len(order)))
            for code, n, total in zip(codes[order][first].tolist(), counts.tolist(), sums):
                known = held.setdefault(code, [0, np.zeros(x.shape[1])])
                known[0], known[1] = known[0] + n, known[1] + total
        if held:  # a task without rows has no vectors to tell the type of a sum by
            yield pd.DataFrame({"code": list(held), "n": [n for n, _ in held.values()], "total": [t for _, t in held.values()]})

    parts = coded.where(size > 0).select("code", feature).mapInPandas(add, made)
    cells = parts.select("code", "n", F.posexplode("total").alias("_i", "_t"))
    summed = cells.groupBy("code", "_i").agg(F.sum("n").alias("n"), F.sum("_t").alias("_t"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_t")))  # one entry per dimension
    return summed.groupBy("code").agg(F.max("n").alias("n"), F.transform(ordered, lambda c: c["_t"]).alias("total"))


def _book(spark: SparkSession, codes: list[int], centers: np.ndarray) -> DataFrame:
    schema = T.StructType([T.StructField("code", T.IntegerType(), False), T.StructField("c", T.ArrayType(T.DoubleType()), False)])
    return spark.createDataFrame([(int(k), [float(v) for v in c]) for k, c in zip(codes, centers)], schema)


def refine_codebook(features: DataFrame, codebook: DataFrame, rounds: int, feature: str = "f", tolerance: float = 0.0) -> DataFrame:
    """Lloyd rounds from given codes: nearest code, then the mean of what each code got. A code that got nothing stays.

    Per round the data are read once; sums are merged per task and code, and k sums reach the driver. It ends early when no
    center moves by more than ``tolerance``.
    """
    codes, centers = _load(codebook)
    place = {int(c): i for i, c in enumerate(codes)}
    data = features.where(F.size(feature) > 0)
    for _ in range(rounds):
        sums = code_sums(nearest_code(data, (codes, centers), feature), feature)
        moved = centers.copy()
        for r in sums.collect():  # at most MAX_CODES rows
            moved[place[r["code"]]] = np.array(r["total"]) / r["n"]
        step = np.abs(moved - centers).max(initial=0.0)
        centers = moved
        if step <= tolerance:
            break
    return _book(features.sparkSession, codes, centers)


def _weighted_choice(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates by squared-distance draws, then weighted Lloyd rounds among them."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    nearest = ((candidates - candidates[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(candidates)):
        mass = weights * nearest
        if mass.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
        nearest = np.minimum(nearest, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
    centers = candidates[chosen].copy()
    for _ in range(20):
        to = np.array([int(((centers - x) ** 2).sum(axis=1).argmin()) for x in candidates])
        for j in range(len(centers)):
            mine = to == j
            if mine.any():
                centers[j] = (weights[mine, None] * candidates[mine]).sum(axis=0) / weights[mine].sum()
    return centers


def seed_codebook(features: DataFrame, k: int, seed: int, feature: str = "f", rounds: int = 2) -> DataFrame:
    """First codes by oversampling: every round draws about 2 k vectors with a chance proportional to their squared distance to
    the codes so far; the drawn ones, weighted by how many vectors they stand for, are reduced to k on the driver.

    Draws depend on the seed and the vector only. k is at most ``MAX_CODES``; fewer codes come back if there are fewer
    distinct vectors.
    """
    spark = features.sparkSession
    data = features.select(F.col(feature).cast("array<double>").alias("f")).where(F.size("f") > 0)
    key = F.xxhash64("f")
    first = data.orderBy(draws.uniform(seed, "first", key), "f").limit(1).collect()
    if not first:
        raise ValueError("there are no vectors to learn codes from")
    centers = np.array([first[0]["f"]])
    for turn in range(rounds):
        coded = nearest_code(data, (np.arange(len(centers)), centers))
        total = coded.agg(F.sum("d2")).head()[0]
        if not total:
            break
        chance = F.col("d2") * F.lit(2.0 * k / total)
        room = MAX_CODES - len(centers)
        drawn = coded.where(draws.uniform(seed, f"seed{turn}", key) < chance).select("f").distinct().orderBy("f").limit(room).collect()  # about 2 k
        if drawn:
            centers = np.vstack([centers, np.array([r["f"] for r in drawn])])
    counts = {r["code"]: r["n"] for r in nearest_code(data, (np.arange(len(centers)), centers)).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([counts.get(i, 0) for i in range(len(centers))], float)
    chosen = _weighted_choice(centers[weights > 0], weights[weights > 0], k, seed)
    return _book(spark, range(len(chosen)), chosen)


def fit_codebook(features: DataFrame, k: int = 256, seed: int = 1, feature: str = "f", iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """Learn k codes: drawn first codes, then Lloyd rounds over ``nearest_code``. The same vectors give the same codes, however they lie."""
    data = features.select(F.col(feature).cast("array<double>").alias("f"))
    return refine_codebook(data, seed_codebook(data, k, seed), iterations, tolerance=tolerance)


def compression_report(
    slices: DataFrame, stride: int = 8, n_codes: int = 256, sample_bits: int = 16, z_factor: int = 8
) -> DataFrame:
    """Bits before and after coding per volume, and the gain over storing the z-expanded volume."""
    code_bits = math.ceil(math.log2(n_codes))
    size = extents(slices)
    voxels = F.col("nz").cast("long") * F.col("nx") * F.col("ny")
    latents = F.col("nz").cast("long") * F.floor(F.col("nx") / stride) * F.floor(F.col("ny") / stride)
    bits = size.select("volume_id", (voxels * sample_bits).alias("bits_in"), (latents * code_bits).alias("bits_out"))
    ratio = F.try_divide("bits_in", "bits_out")
    return bits.withColumns({"ratio": ratio, "isotropic_ratio": ratio * z_factor})
