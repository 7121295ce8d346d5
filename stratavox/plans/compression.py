"""Encode -> decode -> compare: codes table, reconstruction and quality per volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators import codebook as cb


def reconstruct(slices: DataFrame, codebook: DataFrame, p: int) -> DataFrame:
    """Tiles with their code and both vectors: encoding and decoding stay in one row, so nothing is joined back."""
    coded = cb.nearest_code(cb.slice_tiles(slices, p), codebook)
    return cb.code_lookup(coded, codebook)


def evaluate(slices: DataFrame, codebook: DataFrame, p: int, beta: float = 0.25, span: float = 2.0) -> DataFrame:
    """Per volume: error, peak signal-to-noise ratio for a value span, commitment loss, code usage."""
    tiles = reconstruct(slices, codebook, p)
    # The distance to the chosen code is the squared error of the tile.
    errors = tiles.groupBy("volume_id").agg((F.sum("d2") / F.sum(F.size("f"))).alias("mse"))
    usage = cb.usage(tiles, ["volume_id"])
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(
        20.0 * F.log10(F.try_divide(F.lit(span), F.sqrt("mse")))
    )
    return errors.join(usage, "volume_id").select(
        "volume_id", "mse", psnr.alias("psnr"), ((1 + beta) * F.col("mse")).alias("commitment"), "perplexity", "codes_used"
    )
