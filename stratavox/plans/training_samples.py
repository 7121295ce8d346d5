"""Paired volumes -> normalise -> centre crop -> shared random crop -> shuffled batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators import normalize, planes, sampling, tiling
from stratavox.operators.layout import slices_to_voxels
from stratavox.scale import attach_small


def training_samples(
    sides: Sequence[DataFrame],
    norm: str | None,
    precrop: int,
    resize: int,
    crop: int,
    batch: int,
    seed: int,
    drop_last: bool = False,
) -> DataFrame:
    """Block rows of every side (same volume ids) to voxels with side, batch and place.

    Training order: centre crop, resize, random crop. The random window and the batch are keyed on the volume, so all sides share them.
    """
    parts = []
    for i, slices in enumerate(sides):
        ready = normalize.normalize(slices_to_voxels(slices), norm)
        cropped = tiling.center_crop(ready, precrop, precrop, tiling.extents(slices))
        if resize != precrop:
            from stratavox.operators.layout import voxels_to_slices

            cropped = slices_to_voxels(planes.resize_square(voxels_to_slices(cropped), resize))
        parts.append(cropped.withColumn("side", F.lit(i)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    sizes = tiling.extents(sides[0]).withColumns({"nx": F.lit(resize), "ny": F.lit(resize)})
    windowed = tiling.random_crop(both, crop, crop, seed, sizes)
    ids = sides[0].select("volume_id").distinct()
    batches = sampling.shuffle_batches(ids, "volume_id", batch, seed, drop_last)
    return attach_small(windowed, batches, ["volume_id"])


def evaluation_samples(slices: DataFrame, norm: str | None, resize: int, crop: int) -> DataFrame:
    """Test order: resize, then the centre crop."""
    resized = planes.resize_square(slices, resize)
    ready = normalize.normalize(slices_to_voxels(resized), norm)
    return tiling.center_crop(ready, crop, crop, tiling.extents(slices).withColumns({"nx": F.lit(resize), "ny": F.lit(resize)}))
