"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equals next to each other, and one
streaming pass compares each text in full with its neighbour. A group of copies may span any number of range partitions:
only the first and the last run of a partition can continue elsewhere, so at most two rows per partition are joined up
afterwards, however large the group is.

The sort key is the first bytes of the normalised text, then its SHA-256, then the order of preference. Equal texts have
equal keys and so stay adjacent, while splitters and sort keys remain a few dozen bytes for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.common import SPACES, give_back, stored, table
from stratavox.llm.registry import query

HEAD_BYTES = 24


def _emit(rows: pa.Table, start: np.ndarray, edge: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole runs; ``start`` marks the first row of each, which is the one that stays."""
    first = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    size = np.diff(np.append(first, len(start)))
    out = rows.drop_columns(["_norm"])
    out = out.append_column("_keep_id", rows["_id"].take(pa.array(first[run])))
    out = out.append_column("_size", pa.array(size[run], pa.int64()))
    out = out.append_column("_first", pa.array(start))
    out = out.append_column("_edge", pa.array(edge[run]))
    out = out.append_column("_part", pa.array(np.full(len(start), part), pa.int32()))
    yield from out.combine_chunks().to_batches()


def _neighbours(drop_copies: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full comparison of each normalised text with the one before it.

    Memory: one batch, one text, and of the run in progress the rows without their texts (none but the first if
    ``drop_copies``).
    """
    part = TaskContext.get().partitionId()
    open_rows: list[pa.Table] = []  # the run that may go on
    last, begun = None, True

    def close(at_end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal begun
        if open_rows:
            rows = pa.concat_tables(open_rows)
            start = np.zeros(len(rows), bool)
            start[0] = True
            yield from _emit(rows, start, np.array([begun or at_end]), part)
            open_rows.clear()
            begun = False

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        norm = rows["_norm"].combine_chunks()
        start = np.ones(len(norm), bool)
        start[0] = last is None or norm[0].as_py() != last
        if len(norm) > 1:
            start[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        last = norm[-1].as_py()
        slim = rows.set_column(rows.schema.get_field_index("_norm"), "_norm", pa.nulls(len(norm), norm.type))
        if drop_copies:
            slim, start = slim.filter(pa.array(start)), start[start]
            if not len(slim):
                continue
        first = np.flatnonzero(start)
        if not len(first):
            open_rows.append(slim)
            continue
        if first[0] > 0:
            open_rows.append(slim.slice(0, first[0]))
        yield from close(False)
        if first[-1] > first[0]:
            inner = slice(first[0], first[-1])
            edge = np.zeros(len(first) - 1, bool)
            edge[0], begun = begun, False
            yield from _emit(slim.slice(first[0], first[-1] - first[0]), start[inner], edge, part)
        open_rows.append(slim.slice(first[-1]))
    yield from close(True)
    give_back()


def dedup_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), copies: bool = True
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and ``carry`` as a struct ``row``.

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points stays,
    then the smallest id, null ids last; exact repeats of a row are copies like any other and one of them stays. Null
    text counts as empty, and all empty texts form a group. ``copies=False`` returns only the rows that stay (group_size
    is then null). An empty table gives an empty result; columns not named are ignored, whatever they are called.
    """
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.translate(text, SPACES, "").alias("_norm"),
        F.length(text).alias("_chars"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    ).withColumns(
        {"_digest": F.unhex(F.sha2("_norm", 256)), "_head": F.substring(F.col("_norm").cast("binary"), 1, HEAD_BYTES)}
    )
    order = [F.col("_head"), F.col("_digest"), F.col("_chars").desc(), F.col("_id").asc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_head")
    fields = [f for f in ordered.schema.fields if f.name != "_norm"]
    schema = T.StructType(
        [
            *fields,
            T.StructField("_keep_id", id_type),
            T.StructField("_size", T.LongType()),
            T.StructField("_first", T.BooleanType()),
            T.StructField("_edge", T.BooleanType()),
            T.StructField("_part", T.IntegerType()),
        ]
    )
    drop_copies = not copies
    runs = stored(ordered.mapInArrow(lambda batches: _neighbours(drop_copies, batches), schema))
    # At most two runs of each range partition touch its ends: this side is bounded by the number of partitions.
    best = F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_part").alias("p"))
    ends = (
        runs.where(F.col("_edge") & F.col("_first"))
        .groupBy("_digest")
        .agg(F.sum("_size").alias("_total"), F.min(best).alias("_best"))
    )
    met = runs.join(F.broadcast(ends), ["_digest"], "left")
    lone = F.col("_edge") & F.col("_best").isNotNull()
    out = met.select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_best.i")).otherwise(F.col("_keep_id")).alias("keep_id"),
        (F.when(lone, F.col("_total")).otherwise(F.col("_size")) if copies else F.lit(None).cast("long")).alias("group_size"),
        (F.col("_first") & (~lone | (F.col("_best.p") == F.col("_part")))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        *(["row"] if carry else []),
    )
    return out if copies else out.where("kept")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = dedup_exact(docs, id_col, text_col, carry=docs.columns, copies=False)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@query(
    "op8_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
    ), r AS (
      SELECT doc_id, norm, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id FROM d
      WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
    )
    SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))
