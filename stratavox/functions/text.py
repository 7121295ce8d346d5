"""File-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_name(prefix: str, x: Column, y: Column, z: Column) -> Column:
    return F.format_string("%s%03d%03d%03d", F.lit(prefix), x, y, z)


def tile_name(stem: Column, i: Column) -> Column:
    return F.format_string("%s_s%04d", stem, i)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def subject_key(path: Column) -> Column:
    """Base name without every occurrence of its last '_token'."""
    base = base_name(path)
    return F.replace(base, F.concat(F.lit("_"), F.element_at(F.split(base, "_"), -1)), F.lit(""))


def checkpoint_epoch(path: Column) -> Column:
    return F.regexp_extract(path, r"epoch=(\d+)", 1).cast("int")


def run_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "checkpoints"), 1)


def directions(spec: Column) -> Column:
    """'a_b' names the directories a and b."""
    return F.split(spec, "_")
