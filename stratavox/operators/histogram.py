"""Histogram matching: source quantile -> bracketing template quantiles -> interpolated template value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators.metrics import value_counts
from stratavox.scale import attach_small, carry_last


def quantile_bracket(source: DataFrame, template: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As-of join of quantile tables (``value_counts`` output): each source quantile q and the template interval (c_low, c_high] around it.

    Both tables go into one order, falling in the quantile, and every template row is carried on until the next one. A
    template value that covers a third of the axis is still one row, and so is each source value that falls on it.
    """
    keys = list(keys)
    interval = F.struct(
        ((F.col("upto") - F.col("n")) / F.col("total")).alias("c_low"),
        F.col("cdf").alias("c_high"),
        F.col("prev").alias("t_low"),
        F.col("v").alias("t_high"),
    )
    value = source.schema["v"].dataType
    known = template.select(*keys, (-F.col("cdf")).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(value).alias("v"), interval.alias("_known"))
    asked = source.select(*keys, (-F.col("cdf")).alias("_at"), F.lit(1).alias("_side"), "v", F.lit(None).cast(known.schema["_known"].dataType).alias("_known"))
    found = carry_last(known.unionByName(asked), keys, ["_at", "_side"], "_known").where((F.col("_side") == 1) & F.col("_known").isNotNull())
    return found.select(*keys, "v", (-F.col("_at")).alias("q"), "_known.c_low", "_known.c_high", "_known.t_low", "_known.t_high")


def hist_match(source: DataFrame, template: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Replace source values so that each volume takes the template's histogram."""
    keys = list(keys)
    s = value_counts(source, keys)
    t = value_counts(template, keys, previous=True)
    bracket = quantile_bracket(s, t, keys)
    share = F.try_divide(F.col("q") - F.col("c_low"), F.col("c_high") - F.col("c_low"))
    # The first interval has no value below it: its quantiles take the first value.
    matched = F.when(F.col("t_low").isNull(), F.col("t_high")).otherwise(
        F.col("t_low") + share * (F.col("t_high") - F.col("t_low"))
    )
    table = bracket.select(*keys, "v", matched.alias("matched"))
    return attach_small(source, table, [*keys, "v"]).withColumn("v", F.col("matched")).drop("matched")
