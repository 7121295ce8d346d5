"""Tiling, cropping and geometry.

Coordinate operators work on long voxels as filters and projections (no shuffle). Operators that cut arrays work on
block rows and copy row segments with ``slice``, so a tile is cut without exploding voxels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions import draws, text
from stratavox.functions.vectors import let
from stratavox.scale import attach_small

AXES = ("z", "x", "y")


def extents(df: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Size of each volume; from block rows the plane size is read, not counted."""
    if "data" in df.columns:
        return df.groupBy(*keys).agg((F.max("z") + 1).alias("nz"), F.max("h").alias("nx"), F.max("w").alias("ny"))
    return df.groupBy(*keys).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])


def with_extents(df: DataFrame, sizes: DataFrame | None = None, **per_volume: Column) -> DataFrame:
    """Add nz, nx, ny. A catalog usually knows the sizes; without ``sizes`` they cost a scan.

    Further columns (draws, say) are worked out once per volume, on the size table, and ride along.
    """
    table = extents(df) if sizes is None else sizes
    return attach_small(df, table.withColumns(per_volume) if per_volume else table, ["volume_id"])


def tile_grid(
    df: DataFrame, block: Sequence[int], step: Sequence[int], origin: str = "block", sizes: DataFrame | None = None
) -> DataFrame:
    """Assign voxels to full blocks.

    Counts per axis are ``size // step``. ``origin='block'`` places block g at ``g * block``; ``'step'``
    places it at ``g * step``. Blocks that leave the volume are dropped, by arithmetic on the sizes.
    """
    if origin not in ("block", "step"):
        raise ValueError("origin is 'block' or 'step'")
    out = with_extents(df, sizes)
    for axis, d, s in zip(AXES, block, step):
        pitch = d if origin == "block" else s
        place, size = F.col(axis), F.col(f"n{axis}")
        first = F.greatest(F.ceil((place - d + 1) / pitch), F.lit(0)).cast("int")
        last = F.floor(place / pitch).cast("int")
        if pitch == d:
            out = out.withColumn(f"g{axis}", last)
        else:
            out = out.withColumn(f"g{axis}", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array())))
        g = F.col(f"g{axis}")
        out = out.where((g < F.floor(size / s)) & (g * pitch + d <= size)).withColumn(axis, place - g * pitch)
    return out.drop("nz", "nx", "ny")


def _cut(top: Column, left: Column, height, width) -> Column:
    """Rows top..top+height-1, columns left..left+width-1 of ``data`` as one flat array."""
    height = height if isinstance(height, Column) else F.lit(height)
    width = width if isinstance(width, Column) else F.lit(width)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), height - 1), lambda r: F.slice(F.col("data"), (top + r) * F.col("w") + left + 1, width)
        )
    )


def cut_patches(slices: DataFrame, block: Sequence[int], sizes: DataFrame | None = None) -> DataFrame:
    """Non-overlapping full (dz, dx, dy) patches as block rows.

    Every slice is cut into its plane tiles first; the shuffle key is the patch, so a group is
    ``dz`` tiles however large the volume is.
    """
    dz, dx, dy = block
    sized = with_extents(slices, sizes).where((F.floor(F.col("z") / dz) + 1) * dz <= F.col("nz"))
    rows = F.sequence(F.lit(0), F.floor(F.col("h") / dx).cast("int") - 1)
    cols = F.sequence(F.lit(0), F.floor(F.col("w") / dy).cast("int") - 1)
    tiles = (
        sized.where((F.col("h") >= dx) & (F.col("w") >= dy))
        .select("volume_id", "z", "w", "data", F.explode(rows).alias("gx"), cols.alias("_cols"))
        .select("volume_id", "z", "w", "data", "gx", F.explode("_cols").alias("gy"))
        .select(
            "volume_id",
            F.floor(F.col("z") / dz).cast("int").alias("gz"),
            "gx",
            "gy",
            F.struct((F.col("z") % dz).alias("k"), _cut(F.col("gx") * dx, F.col("gy") * dy, dx, dy).alias("t")).alias("t"),
        )
    )
    ordered = F.sort_array(F.collect_list("t"))
    # A block that lacks a slice is dropped, like one at a short end.
    return (
        tiles.groupBy("volume_id", "gz", "gx", "gy")
        .agg(F.flatten(F.transform(ordered, lambda t: t["t"])).alias("data"), F.count(F.lit(1)).alias("_slices"))
        .where(F.col("_slices") == dz)
        .drop("_slices")
    )


def keep_bright(patches: DataFrame, limit: float, channels: Sequence[DataFrame] = ()) -> list[DataFrame]:
    """Keep patches whose mean is above ``limit``, strictly; further channels keep the same places."""
    keys = ["volume_id", "gz", "gx", "gy"]
    mean = F.aggregate("data", F.lit(0.0), lambda acc, v: acc + v) / F.size("data")
    kept = patches.where(mean > limit)
    places = kept.select(*keys)
    return [kept, *[c.join(places, keys, "left_semi") for c in channels]]


def name_patches(patches: DataFrame, prefix: str = "") -> DataFrame:
    return patches.withColumn("name", text.patch_name(prefix, F.col("gx"), F.col("gy"), F.col("gz")))


def _origins(size: Column, p: int, overlap: int) -> Column:
    """0, st, 2st ... below size - p, then size - p."""
    st = p - overlap
    stop = size - p
    inner = F.when(stop > 0, F.sequence(F.lit(0), stop - 1, F.lit(st))).otherwise(F.array().cast("array<int>"))
    return F.concat(inner, F.array(stop))


def tile_overlap(slices: DataFrame, p_size: int, p_overlap: int, p_max: int) -> DataFrame:
    """Overlapping p x p tiles of each image with the last one anchored at the edge; small images stay whole.

    ``i`` is the place in emission order: rows outside, columns inside.
    """
    large = (F.col("h") > p_max) & (F.col("w") > p_max)
    tops = F.when(large, _origins(F.col("h"), p_size, p_overlap)).otherwise(F.array(F.lit(0)))
    lefts = F.when(large, _origins(F.col("w"), p_size, p_overlap)).otherwise(F.array(F.lit(0)))
    keep = [c for c in slices.columns if c not in ("data", "h", "w")]
    tiled = (
        slices.select(*keep, "h", "w", "data", large.alias("_large"), lefts.alias("_lefts"), F.posexplode(tops).alias("_r", "top"))
        .select("*", F.posexplode("_lefts").alias("_c", "left"))
        .withColumn("_th", F.when(F.col("_large"), F.lit(p_size)).otherwise(F.col("h")))
        .withColumn("_tw", F.when(F.col("_large"), F.lit(p_size)).otherwise(F.col("w")))
        .withColumn("data", _cut(F.col("top"), F.col("left"), F.col("_th"), F.col("_tw")))
    )
    return tiled.select(
        *keep,
        (F.col("_r") * F.size("_lefts") + F.col("_c")).alias("i"),
        "top",
        "left",
        F.col("_th").alias("h"),
        F.col("_tw").alias("w"),
        "data",
    )


def tile_square(df: DataFrame, size: int = 16) -> DataFrame:
    """Reshape each plane to non-overlapping size x size tiles."""
    return df.withColumns(
        {
            "gx": F.floor(F.col("x") / size).cast("int"),
            "gy": F.floor(F.col("y") / size).cast("int"),
            "x": F.col("x") % size,
            "y": F.col("y") % size,
        }
    )


def window(df: DataFrame, top: Column, left: Column, height: int, width: int) -> DataFrame:
    """Keep a plane window and move its corner to the origin."""
    inside = (F.col("x") >= top) & (F.col("x") < top + height) & (F.col("y") >= left) & (F.col("y") < left + width)
    return df.where(inside).withColumns({"x": F.col("x") - top, "y": F.col("y") - left})


def center_crop(df: DataFrame, height: int, width: int, sizes: DataFrame | None = None) -> DataFrame:
    top = F.floor((F.col("nx") - height) / 2).cast("int")
    left = F.floor((F.col("ny") - width) / 2).cast("int")
    return window(with_extents(df, sizes), top, left, height, width).drop("nz", "nx", "ny")


def random_crop(df: DataFrame, height: int, width: int, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """Same window for every image of a sample (volume): the draw is keyed on the sample id."""
    key = F.col("volume_id")
    placed = with_extents(
        df,
        sizes,
        _top=draws.integer(seed, "crop/x", 0, F.col("nx") - height + 1, key),
        _left=draws.integer(seed, "crop/y", 0, F.col("ny") - width + 1, key),
    )
    return window(placed, F.col("_top"), F.col("_left"), height, width).select(*df.columns)


def paired_random_crop(low: DataFrame, high: DataFrame, sf: int, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """On block rows: a window of the small image and the sf-times larger one of the large image, drawn once per slice."""
    key = [F.col("volume_id"), F.col("z")]

    def one(df: DataFrame, factor: int) -> DataFrame:
        place = F.struct(
            (draws.integer(seed, "pair/x", 0, F.col("h") / factor - size + 1, *key) * factor).alias("top"),
            (draws.integer(seed, "pair/y", 0, F.col("w") / factor - size + 1, *key) * factor).alias("left"),
        )
        placed = df.withColumn("data", let(place, lambda p: _cut(p["top"], p["left"], size * factor, size * factor)))
        return placed.withColumns({"h": F.lit(size * factor), "w": F.lit(size * factor)}).select(*df.columns)

    return one(low, 1), one(high, sf)


def crop_z(df: DataFrame, depth: int, seed: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """A z window of ``depth`` slices; start 0 without a seed, else drawn in [0, size - depth)."""
    if depth <= 0:
        return df
    if seed is None:
        return df.where(F.col("z") < depth)
    room = F.greatest(F.col("nz") - depth, F.lit(1))
    sized = with_extents(df, sizes, _start=draws.integer(seed, "cropz", 0, room, F.col("volume_id")))
    start = F.col("_start")
    kept = sized.where((F.col("z") >= start) & (F.col("z") < start + depth))
    return kept.withColumn("z", F.col("z") - start).select(*df.columns)


def stride_z(df: DataFrame, step: int, seed: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Every step-th slice from phase 0, or from a phase drawn per volume."""
    phase = F.lit(0)
    placed = df
    if seed is not None:
        placed = with_extents(df, sizes, _phase=draws.integer(seed, "stridez", 0, step, F.col("volume_id")))
        phase = F.col("_phase")
    kept = placed.where((F.col("z") >= phase) & ((F.col("z") - phase) % step == 0))
    return kept.withColumn("z", ((F.col("z") - phase) / step).cast("int")).select(*df.columns)


def every_kth(df: DataFrame, offset: int = 4, step: int = 8) -> DataFrame:
    kept = df.where((F.col("z") >= offset) & ((F.col("z") - offset) % step == 0))
    return kept.withColumn("z", F.floor((F.col("z") - offset) / step).cast("int"))


def modcrop(df: DataFrame, scale: int, sizes: DataFrame | None = None) -> DataFrame:
    """Trim each plane axis by itself to a multiple of ``scale``."""
    sized = with_extents(df, sizes)
    return sized.where(
        (F.col("x") < F.col("nx") - F.col("nx") % scale) & (F.col("y") < F.col("ny") - F.col("ny") % scale)
    ).drop("nz", "nx", "ny")


def shave(df: DataFrame, border: int, sizes: DataFrame | None = None) -> DataFrame:
    sized = with_extents(df, sizes)
    x, y = F.col("x"), F.col("y")
    inside = (x >= border) & (x < F.col("nx") - border) & (y >= border) & (y < F.col("ny") - border)
    return sized.where(inside).withColumns({"x": x - border, "y": y - border}).drop("nz", "nx", "ny")


def permute(df: DataFrame, order: Sequence[int]) -> DataFrame:
    """Transpose: output axis i is input axis order[i]. In long form this renames columns."""
    return df.withColumns({AXES[i]: F.col(AXES[o]) for i, o in enumerate(order)})


def dihedral_place(mode: int | Column, x: Column, y: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """Where pixel (x, y) lands under flip / rotation ``mode`` 0-7.

    Odd modes transpose; modes 2, 3, 6, 7 mirror the read row, modes 4-7 mirror the other read index.
    """
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    odd = mode % 2 == 1
    row = F.when(mode.isin(2, 3, 6, 7), nx - 1 - x).otherwise(x)
    col = F.when(mode.isin(4, 5, 6, 7), ny - 1 - y).otherwise(y)
    return F.when(odd, col).otherwise(row), F.when(odd, row).otherwise(col)


def dihedral(df: DataFrame, mode: int | Column, sizes: DataFrame | None = None) -> DataFrame:
    sized = with_extents(df, sizes)
    x, y = dihedral_place(mode, F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return sized.withColumns({"x": x, "y": y}).drop("nz", "nx", "ny")


def augment(
    df: DataFrame, seed: int, hflip: bool = True, rot: bool = True, sizes: DataFrame | None = None
) -> DataFrame:
    """Horizontal flip, vertical flip and transpose, each with probability one half, equal for all images of a sample (volume)."""

    def coin(name: str, allowed: bool) -> Column:
        return F.lit(allowed) & (draws.uniform(seed, name, F.col("volume_id")) < 0.5)

    sized = with_extents(df, sizes, _h=coin("hflip", hflip), _v=coin("vflip", rot), _t=coin("rot90", rot))
    row = F.when(F.col("_v"), F.col("nx") - 1 - F.col("x")).otherwise(F.col("x"))
    col = F.when(F.col("_h"), F.col("ny") - 1 - F.col("y")).otherwise(F.col("y"))
    return sized.withColumns(
        {"x": F.when(F.col("_t"), col).otherwise(row), "y": F.when(F.col("_t"), row).otherwise(col)}
    ).select(*df.columns)


def swap_xy(df: DataFrame, seed: int, p: float = 0.5, sizes: DataFrame | None = None) -> DataFrame:
    turned = with_extents(df, sizes, _t=draws.uniform(seed, "swapxy", F.col("volume_id")) < p)
    return turned.withColumns(
        {
            "x": F.when(F.col("_t"), F.col("y")).otherwise(F.col("x")),
            "y": F.when(F.col("_t"), F.col("x")).otherwise(F.col("y")),
        }
    ).select(*df.columns)


# The six planes as (name, stacking axis, row axis, column axis).
SIX_VIEWS = (
    ("x_zy", "x", "z", "y"),
    ("x_yz", "x", "y", "z"),
    ("y_zx", "y", "z", "x"),
    ("y_xz", "y", "x", "z"),
    ("z_xy", "z", "x", "y"),
    ("z_yx", "z", "y", "x"),
)


def six_views(df: DataFrame) -> DataFrame:
    """Re-slice along every axis in both orientations: one scan, six rows per voxel, keys (view, i, row, col)."""
    views = F.array(
        *[
            F.struct(F.lit(n).alias("view"), F.col(b).alias("i"), F.col(r).alias("row"), F.col(c).alias("col"))
            for n, b, r, c in SIX_VIEWS
        ]
    )
    return df.select("volume_id", F.explode(views).alias("s"), "v").select("volume_id", "s.*", "v")


def view_group_random(df: DataFrame, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """One plane group of three per volume. The yz and xz groups come with z-flipped copies; xy counts double; all / 4."""
    sized = with_extents(df, sizes, _group=draws.integer(seed, "viewgroup", 0, 3, F.col("volume_id")))
    group = F.col("_group")

    def view(name, batch, row, col, flip, weight):
        spot = {"row": F.col(row), "col": F.col(col)}
        if flip:
            spot[flip] = F.col("nz") - 1 - F.col("z")
        return F.struct(
            F.lit(name).alias("view"),
            F.lit(flip is not None).alias("flipped"),
            F.col(batch).alias("i"),
            spot["row"].alias("row"),
            spot["col"].alias("col"),
            F.lit(weight / 4.0).alias("weight"),
        )

    def pair(names, flips):
        rows = [v for v in SIX_VIEWS if v[0] in names]
        return F.array(
            *[view(*v, f, 1) for v, flip in zip(rows, flips) for f in (None, flip)]
        )

    choice = (
        F.when(group == 0, pair(("x_zy", "x_yz"), ("row", "col")))
        .when(group == 1, pair(("y_zx", "y_xz"), ("row", "col")))
        .otherwise(F.array(*[view(*v, None, 2) for v in SIX_VIEWS[4:]]))
    )
    return sized.select("volume_id", F.explode(choice).alias("s"), "v").select("volume_id", "s.*", "v")


def hconcat(a: DataFrame, b: DataFrame, axis: str = "y", sizes: DataFrame | None = None) -> DataFrame:
    """Place ``b`` behind ``a`` along an axis; ``sizes`` are those of ``a``."""
    moved = with_extents(b, extents(a) if sizes is None else sizes).withColumn(axis, F.col(axis) + F.col(f"n{axis}")).drop("nz", "nx", "ny")
    return a.unionByName(moved.select(*a.columns))
