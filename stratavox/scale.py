"""Primitives that keep every other operator safe when one key holds much of the data.

* ``attach_small``  - join per-key statistics: broadcast only after weighing them, shuffle join beyond.
* ``rank_ids``      - position of integer ids inside a key, with bounded window groups.
* ``rank_rows``     - position of ids of any type, over any number of rows.
* ``prefix_sum``    - exact running totals over any sort order, no window over a whole key.
* ``carry_last``    - the last known value before each row, the core of an as-of join.
* ``exact_quantiles`` - linear-interpolated percentiles by a sketch and one exact pass, no sort of the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20


def weigh(df: DataFrame) -> tuple[int, int]:
    """Rows and about how many bytes they take, from one pass over a settled frame; nested values are weighed as text."""

    def bytes_of(field) -> Column | None:
        kind = field.dataType.typeName()
        if kind == "array" and field.dataType.elementType.typeName() not in ("array", "string", "binary", "struct", "map"):
            return F.size(field.name) * 8
        if kind in ("array", "struct", "map"):
            return F.length(F.to_json(F.struct(field.name)))
        return F.length(field.name) if kind in ("string", "binary") else None

    sizes = [F.sum(size) for f in df.schema.fields if (size := bytes_of(f)) is not None]
    row = df.agg(F.count(F.lit(1)), *sizes).head()
    return row[0], row[0] * 16 * len(df.columns) + sum(v or 0 for v in row[1:])


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``small`` (one or few rows per key) to ``big`` on ``on``.

    ``small`` is computed once, into the checkpoint folder, and weighed. Within the bounds it is
    broadcast and ``big`` is not shuffled. Beyond them both sides meet in a shuffle join, where the adaptive skew rule splits
    a hot key of ``big`` and repeats only the row it needs.
    """
    kept = settle(small)
    rows, size = weigh(kept)
    if rows <= max_rows and size <= max_bytes:
        return big.join(F.broadcast(kept), list(on), how)
    return big.join(kept, list(on), how)


def rank_ids(df: DataFrame, keys: Sequence[str], id_col: str, out: str, bits: int = 12) -> DataFrame:
    """0-based position of each unique integer id inside its key, ascending.

    Ids are cut into blocks of ``2**bits`` consecutive values, so a block never holds more rows than
    that, whatever the key sizes. Rank = rows in earlier blocks + position inside the block. Ids are
    numbered per block, and the block counts (one narrow row per key and block) get the running total:
    10**10 slices of one volume are windows of 4,096 slices and one of 2.4 million counts.
    """
    block = F.shiftright(F.col(id_col).cast("long"), bits)
    counts = df.groupBy(*keys, block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(id_col)
    placed = df.withColumn("_block", block).withColumn("_pos", F.row_number().over(inside) - 1)
    return (
        placed.join(offsets, [*keys, "_block"])
        .withColumn(out, (F.col("_before") + F.col("_pos")).cast("int"))
        .drop("_block", "_pos", "_before")
    )


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    rank: str | None = None,
    previous: dict[str, str] | None = None,
    totals_of: dict[str, str] | None = None,
) -> DataFrame:
    """Running totals (inclusive) of ``sums`` inside each key in the given order.

    The rows are range-partitioned on (key, order), so a large key spans many partitions. Totals inside
    a partition come from a window over that partition's share; totals of earlier partitions come
    from one row per (key, partition). ``order`` must be unique inside a key. The frame is cut by a checkpoint,
    because range bounds are sampled and must not be drawn twice.

    ``previous`` maps an output name to the first (ascending) order column: its value in the preceding row of the key,
    which is the largest value seen so far. ``totals_of`` maps an output name to the sum (or rank) whose total over the key it holds.
    """
    previous, totals_of = previous or {}, totals_of or {}
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = dict(sums)
    if rank is not None:
        parts[rank] = F.lit(1)
    key_cols = [F.col(k) for k in keys]
    placed = settle(
        df.withColumns({name: expr for name, expr in parts.items()})
        .repartitionByRange(*key_cols, *order_cols)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy(*keys, "_part").agg(
        *[F.sum(n).alias(f"_t_{n}") for n in parts], *[F.max(c).alias(f"_t_{n}") for n, c in previous.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in parts],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in previous],
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(name) for name, n in totals_of.items()],
    )
    ordered = Window.partitionBy(*keys, "_part").orderBy(*order_cols)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns(
        {**{n: F.sum(n).over(running) for n in parts}, **{n: F.max(c).over(before) for n, c in previous.items()}}
    )
    joined = inside.join(offsets, [*keys, "_part"])
    return joined.withColumns(
        {
            **{n: F.col(n) + F.col(f"_o_{n}") for n in parts},
            **{n: F.coalesce(F.col(n), F.col(f"_o_{n}")) for n in previous},
        }
    ).drop("_part", *[f"_o_{n}" for n in (*parts, *previous)])


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position (long) of each row inside its key in the order of unique ids of any type: numbers, sparse or not, or text.

    Range partitions of (key, id), ranked inside and moved on by the counts of earlier partitions; without keys the whole table is ranked.
    """
    keyed, keys = (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])
    ranked = prefix_sum(keyed, keys, list(order), {}, rank=out).withColumn(out, (F.col(out) - 1).cast("long"))
    return ranked.drop("_all")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Fills ``value`` with the last non-null one at or before each row of its key, in the given order (ascending).

    An as-of join is the union of both sides, sorted once: the side that is looked up holds a value, the other asks. Rows are
    range-partitioned on (key, order); inside a partition a window carries the value on, and the last value of each (key, partition)
    is carried over partition ends, one narrow row each. However many rows ask for one value, none is repeated or gathered.
    """
    placed = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    known = placed.where(F.col(value).isNotNull())
    # The pair orders like the rows, so the largest pair of a partition holds its last value.
    last = known.groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ends = placed.select(*keys, "_part").distinct().join(last, [*keys, "_part"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    running = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn(value, F.last(value, ignorenulls=True).over(running))
    joined = inside.join(starts, [*keys, "_part"])
    return joined.withColumn(value, F.coalesce(value, "_before")).drop("_part", "_before")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    small: int = 1_000_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per key, one column per entry of ``probs`` (plus v_min, v_max, n).

    Two passes over the data, whatever its values. The first merges one sketch per key, which brackets every wanted rank within
    a few parts in ``accuracy``. The second counts what lies below each bracket and the values inside it; only these counts are
    shuffled and ranked (by ``prefix_sum`` if a bracket holds more than ``small`` of them). Keys of few values take all of
    them as the bracket. Should a sketch ever miss a rank, its key is counted once more without a bracket.

    Nulls are left out. A key with a NaN has NaN for every quantile, minimum and maximum, as arrays have; infinities are
    ordinary largest and smallest values, and a quantile between a finite and an infinite one is infinite.
    """
    keys, names = list(keys), list(probs)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    room = 3.0 / accuracy
    asked = [min(max(p + side * room, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    number = F.when(~F.isnan("_v"), F.col("_v"))
    span = settle(
        data.groupBy(*keys).agg(
            F.min("_v").alias("v_min"),
            F.max("_v").alias("v_max"),
            F.count("_v").alias("n"),
            F.max(F.isnan("_v")).alias("_nan"),
            F.percentile_approx(number, asked, accuracy).alias("_around"),
        )
    )
    # A sketch of few values could be off by one rank.
    tight = (F.col("n") >= 10 * accuracy) & F.lit(accuracy > 1)
    low, high = (lambda i: F.when(tight, F.col("_around")[2 * i]).otherwise(F.col("v_min"))), (lambda i: F.when(tight, F.col("_around")[2 * i + 1]).otherwise(F.col("v_max")))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("from"), high(i).alias("to")) for i in range(len(names))])
    sane = span.where(~F.col("_nan"))
    met = attach_small(data, sane.select(*keys, brackets.alias("_b")), keys).select(*keys, "_v", F.explode("_b").alias("_b"))
    cell = F.when(F.col("_v") >= F.col("_b.from"), F.col("_v"))  # NULL: below the bracket, counted as one
    counts = settle(
        met.where(F.col("_v") <= F.col("_b.to")).groupBy(*keys, F.col("_b.i").alias("_i"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    )
    most = counts.groupBy(*keys, "_i").count().agg(F.max("count")).head()[0] or 0
    if most <= small:
        upto = Window.partitionBy(*keys, "_i").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("_upto", F.sum("_n").over(upto))
    else:
        running = prefix_sum(counts, [*keys, "_i"], ["_cell"], {"_upto": F.col("_n")})
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(p) * (F.col("n") - 1)).alias("_rank")) for i, p in enumerate(probs.values())])
    wanted = sane.select(*keys, F.explode(ranks).alias("_r")).select(*keys, "_r._i", "_r._rank")
    inside = attach_small(running.where(F.col("_cell").isNotNull()), wanted, [*keys, "_i"])
    at = lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_n"))
    found = inside.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("_i") == i) & at(side(F.col("_rank"))), F.col("_cell"))).alias(f"_{tag}_{i}")
            for i in range(len(names))
            for tag, side in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    out = span.join(found, keys, "left")
    missed = ~F.col("_nan") & reduce(or_, [F.col(f"_{tag}_{i}").isNull() for i in range(len(names)) for tag in ("lo", "hi")])
    for i, (name, p) in enumerate(probs.items()):
        first, second, rank = F.col(f"_lo_{i}"), F.col(f"_hi_{i}"), F.lit(p) * (F.col("n") - 1)
        share = rank - F.floor(rank)
        open_end = (first == float("-inf")) & (second < float("inf"))
        between = F.when((first == second) | (share == 0) | open_end, first).otherwise(first + (second - first) * share)
        out = out.withColumn(name, F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(between))
    out = out.withColumns({c: F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col(c)) for c in ("v_min", "v_max")})
    done = out.select(*keys, *names, "v_min", "v_max", "n", missed.alias("_missed"))
    if accuracy == 1:
        return done.drop("_missed")
    done = settle(done)
    again = done.where("_missed").select(*keys)
    if again.isEmpty():
        return done.drop("_missed")
    redone = exact_quantiles(df.join(again, keys, "left_semi"), keys, value, probs, 1, small)
    return done.where("NOT _missed").drop("_missed").unionByName(redone)
