"""Places where callers bring their own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratavox.operators import normalize, planes, tiling


def parallel_apply(
    df: DataFrame, func: Callable, n: int, schema: str, order: str | None = None, pass_worker: bool = False
) -> DataFrame:
    """Run ``func(chunk)`` or ``func(chunk, worker_id)`` over ``n`` chunks; rows keep their order key.

    Chunks are ranges of the order key when one is given, else hash-free round robin.
    """
    spread = df.repartitionByRange(n, order).sortWithinPartitions(order) if order else df.repartition(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = TaskContext.get().partitionId()
        for batch in batches:
            yield func(batch, worker) if pass_worker else func(batch)

    return spread.mapInPandas(run, schema)


def prepare_samples(
    voxels: DataFrame, crop: int = 0, seed: int = 0, norm: str | None = "00", transforms: Callable | None = None
) -> DataFrame:
    """Normalise each volume and crop it at random; ``transforms`` (frame -> frame) replaces the crop."""
    ready = normalize.normalize(voxels, norm)
    if transforms is not None:
        return ready.transform(transforms)
    return tiling.random_crop(ready, crop, crop, seed) if crop else ready


def score_model(slices: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Apply a model to slices in batches (Z, C, X, Y). ``load`` runs once per task, before the first batch."""
    keys = [c for c in slices.columns if c not in ("h", "w", "data")]
    types = dict(slices.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for at, block in planes.by_shape(batch["data"], batch["h"], batch["w"]):
                out = model(block.transpose(0, 3, 1, 2))
                frame = batch.loc[at, keys].copy()
                frame["h"], frame["w"] = out.shape[2], out.shape[3]
                frame["data"] = list(out.transpose(0, 2, 3, 1).reshape(len(at), -1))
                yield frame

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + planes.PLANE
    return slices.select(*keys, "h", "w", "data").mapInPandas(run, schema)
