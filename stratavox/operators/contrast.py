"""Patch similarity inside an image or batch and the contrastive score built on it, as products of blocks.

Queries and keys are gathered in blocks of at most ``BLOCK`` positions, one matrix per row. A task multiplies a query block with
the key blocks it meets and reduces the product at once: to partial log-sums, to the best few keys, or to the pairs above a
bound. No dot product becomes a row of its own unless it is asked for. The key blocks of a large group are dealt to stripes, so
that one image or batch with a third of all positions is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratavox.functions import vectors
from stratavox.operators.sampling import sample_positions
from stratavox.scale import attach_small

BLOCK = 256
#: Key blocks per stripe.
STRIPE = 16
#: Query blocks whose partial results a task holds before it hands them on.
HELD = 512
OWN_LOGIT = -10.0


def _blocks(features: DataFrame, side: str, group: Sequence[str]) -> DataFrame:
    """group, _block, and per block: images and places of its rows and their vectors end to end."""
    by = list(dict.fromkeys([*group, "image_id"]))
    block = F.concat_ws("/", F.col("image_id").cast("string"), F.floor(F.col("pos") / BLOCK).cast("string")).alias("_block")
    rows = features.where(F.col("side") == side)
    gathered = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], block).agg(F.sort_array(F.collect_list(F.struct("pos", "image_id", F.col("f")))).alias("_r"))
    return gathered.select(
        *[F.col(f"_g_{c}").alias(f"_g_{c}") for c in group],
        F.col("_block").alias(f"_{side}_block"),
        F.col("_r.image_id").alias(f"_{side}_image"),
        F.col("_r.pos").alias(f"_{side}_pos"),
        F.flatten(F.col("_r.f")).alias(f"_{side}"),
    )


def block_pairs(features: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every query block of a group beside every key block of it."""
    names = [f"_g_{c}" for c in group]
    q, k = _blocks(features, "q", group), _blocks(features, "k", group)
    # One row per group: how many stripes its key blocks are dealt to.
    stripes = k.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / STRIPE).cast("int").alias("_stripes"))
    keys = attach_small(k, stripes, names).withColumn("_stripe", F.pmod(F.xxhash64("_k_block"), F.col("_stripes")).cast("int")).drop("_stripes")
    asked = attach_small(q, stripes, names).withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1))).drop("_stripes")
    return asked.join(keys, [*names, "_stripe"])


def _product(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of row i's blocks (queries x keys), and where query and key are the same place of the same image."""
    q_pos, k_pos = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("_q_pos", "_k_pos"))
    q, k = (batch[c][i].values.to_numpy().reshape(len(p), -1) for c, p in (("_q", q_pos), ("_k", k_pos)))
    images = [np.asarray(batch[c][i].values.to_pylist(), object) for c in ("_q_image", "_k_image")]
    own = (q_pos[:, None] == k_pos[None, :]) & (images[0][:, None] == images[1][None, :])
    return q @ k.T, own


def _arrow(batch: pa.RecordBatch, i: int, column: str) -> pa.Array:
    return batch[column][i].values


def _reduced(pairs: DataFrame, group: Sequence[str], start: Callable, add: Callable, done: Callable, fields: list[T.StructField]) -> DataFrame:
    """Per query and task: ``start`` makes a state for a query block, ``add`` takes a product in, ``done`` gives arrays for ``fields``.

    Products of one query block are merged in the task; at most ``HELD`` blocks wait at a time.
    """
    layer = [c for c in ("layer",) if c in group]
    columns = [*(f"_g_{c}" for c in layer), "_q_block", "_q_image", "_q_pos", "_q", "_k_image", "_k_pos", "_k"]
    made = pairs.select(*columns)
    kinds = {c: made.schema[c].dataType for c in columns}
    schema = T.StructType(
        [
            *[T.StructField(c, kinds[f"_g_{c}"]) for c in layer],
            T.StructField("image_id", kinds["_q_image"].elementType),
            T.StructField("pos", kinds["_q_pos"].elementType),
            *fields,
        ]
    )

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (level, _), (images, places, state) in held.items():
                front = [pa.array([level] * len(places), arrow.types[0])] if layer else []
                yield pa.RecordBatch.from_arrays([*front, images, places, *done(state)], schema=arrow)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                level = batch[f"_g_{layer[0]}"][i].as_py() if layer else None
                name = (level, batch["_q_block"][i].as_py())
                dots, own = _product(batch, i)
                if name not in held:
                    if len(held) >= HELD:
                        yield from flush()
                    held[name] = (_arrow(batch, i, "_q_image"), _arrow(batch, i, "_q_pos"), start(len(dots)))
                add(held[name][2], dots, own, _arrow(batch, i, "_k_image"), _arrow(batch, i, "_k_pos"))
        yield from flush()

    return made.mapInArrow(run, schema)


def _levels(features: DataFrame, group: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*(["layer"] if "layer" in features.columns else []), *group]))


def pair_similarity(features: DataFrame, top: int = 1, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per query: keys met, smallest and largest dot product, and its ``top`` keys (dot, key_image, key_pos), best first.

    Of equal products the key with the smaller image and place comes first. A ``layer`` column keeps layers apart.
    """
    group = _levels(features, group)
    pairs = block_pairs(features, group)
    image, place = (pairs.schema[c].dataType.elementType for c in ("_k_image", "_k_pos"))
    key = T.StructType([T.StructField("worse", T.DoubleType()), T.StructField("key_image", image), T.StructField("key_pos", place)])
    fields = [T.StructField("n", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("keys", T.ArrayType(key))]

    def start(n: int) -> dict:
        return {"n": 0, "low": np.full(n, np.inf), "high": np.full(n, -np.inf), "keys": [[] for _ in range(n)]}

    def add(state: dict, dots: np.ndarray, own: np.ndarray, images: pa.Array, places: pa.Array) -> None:
        state["n"] += dots.shape[1]
        np.minimum(state["low"], dots.min(axis=1), out=state["low"])
        np.maximum(state["high"], dots.max(axis=1), out=state["high"])
        k = min(top, dots.shape[1])
        edge = -np.partition(-dots, k - 1, axis=1)[:, k - 1]
        names, spots = images.to_pylist(), places.to_pylist()
        for i, bound in enumerate(edge):
            near = [(-float(dots[i, j]), names[j], spots[j]) for j in np.flatnonzero(dots[i] >= bound)]
            state["keys"][i] = sorted([*state["keys"][i], *near])[:top]

    def done(state: dict) -> list[pa.Array]:
        rows = [[dict(zip(key.names, x)) for x in found] for found in state["keys"]]
        kind = to_arrow_schema(T.StructType(fields)).field("keys").type
        return [pa.array([state["n"]] * len(rows), pa.int64()), pa.array(state["low"]), pa.array(state["high"]), pa.array(rows, kind)]

    ids = [*(["layer"] if "layer" in group else []), "image_id", "pos"]
    parts = _reduced(pairs, group, start, add, done, fields)
    merged = parts.groupBy(*ids).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_list("keys")).alias("keys")
    )
    best = F.transform(
        F.slice(F.array_sort("keys"), 1, top), lambda e: F.struct((-e["worse"]).alias("dot"), e["key_image"].alias("key_image"), e["key_pos"].alias("key_pos"))
    )
    return merged.select(*ids, "n", "low", "high", best.alias("keys"))


def similar_pairs(features: DataFrame, least: float, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pairs of a group whose dot product is ``least`` or more: image_id, pos, key_image, key_pos, dot."""
    group = _levels(features, group)
    layer = [c for c in ("layer",) if c in group]
    made = block_pairs(features, group).select(*[f"_g_{c}" for c in layer], "_q_image", "_q_pos", "_q", "_k_image", "_k_pos", "_k")
    kinds = {c: made.schema[c].dataType for c in made.columns}
    schema = T.StructType(
        [
            *[T.StructField(c, kinds[f"_g_{c}"]) for c in layer],
            T.StructField("image_id", kinds["_q_image"].elementType),
            T.StructField("pos", kinds["_q_pos"].elementType),
            T.StructField("key_image", kinds["_k_image"].elementType),
            T.StructField("key_pos", kinds["_k_pos"].elementType),
            T.StructField("dot", T.DoubleType()),
        ]
    )

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dots, _ = _product(batch, i)
                at, of = np.nonzero(dots >= least)
                front = [pa.array([batch[f"_g_{c}"][i].as_py()] * len(at), arrow.types[0]) for c in layer]
                ids = [_arrow(batch, i, c).take(pa.array(x)) for c, x in (("_q_image", at), ("_q_pos", at), ("_k_image", of), ("_k_pos", of))]
                yield pa.RecordBatch.from_arrays([*front, *ids, pa.array(dots[at, of])], schema=arrow)

    return made.mapInArrow(run, schema)


def patch_nce(
    features: DataFrame,
    temperature: float = 0.07,
    group: Sequence[str] = ("image_id",),
    patches: int = 0,
    seed: int = 0,
    layer: int = 0,
) -> DataFrame:
    """Loss per query: cross entropy of its own key against the keys of the group (own entry set to -10).

    All positions are used; with ``patches`` > 0 so many are drawn first, the same for every image. ``group=['batch']`` takes negatives of the whole batch.
    A ``layer`` column keeps layers apart. Each task gives a log-sum of exponentials per query, merged per query; the
    own key's logit comes from the one block that holds it, and a query without an own key has no loss.
    """
    if patches:
        features = sample_positions(features, patches, seed, layer)
    group = _levels(features, group)
    ids = [*(["layer"] if "layer" in group else []), "image_id", "pos"]
    fields = [T.StructField("_lse", T.DoubleType()), T.StructField("_own", T.DoubleType())]

    def start(n: int) -> dict:
        return {"lse": np.full(n, -np.inf), "own": np.full(n, np.nan)}

    def add(state: dict, dots: np.ndarray, own: np.ndarray, images: pa.Array, places: pa.Array) -> None:
        at, of = np.nonzero(own)
        state["own"][at] = dots[at, of] / temperature
        logits = np.where(own, OWN_LOGIT, dots) / temperature
        peak = logits.max(axis=1)
        part = peak + np.log(np.exp(logits - peak[:, None]).sum(axis=1))
        state["lse"] = np.logaddexp(state["lse"], part)

    def done(state: dict) -> list[pa.Array]:
        return [pa.array(state["lse"]), pa.array(state["own"], mask=np.isnan(state["own"]))]

    parts = _reduced(block_pairs(features, group), group, start, add, done, fields)
    merged = parts.groupBy(*ids).agg(F.max("_own").alias("_p"), F.collect_list("_lse").alias("_parts")).where(F.col("_p").isNotNull())
    whole = vectors.log_sum_exp(F.concat(F.array("_p"), F.col("_parts")))
    return merged.select(*ids, (whole - F.col("_p")).alias("loss"))


def nce_multi_layer(losses: DataFrame, weights: dict[int, float], divisor: float | None = None) -> DataFrame:
    """Sum of weighted mean losses per ``layer``, divided by 4 or by a given number."""
    mean = losses.groupBy("layer").agg(F.avg("loss").alias("_m"))
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in (pair[0], float(pair[1]))])
    return mean.agg((F.sum(F.col("_m") * table[F.col("layer")]) / (divisor or 4.0)).alias("nce"))
