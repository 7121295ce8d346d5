"""Substring dedup by unit hashing.

Texts are cut into units, at line feeds and after sentence ends, so that a passage is found wherever it stands in a
paragraph. Each unit is normalised (A-Z to lower case, runs of white space to one space, trimmed) and hashed,
digests are grouped over all documents, and of each digest the earliest occurrence, by document id and position, stays.
All others are removed with the white space after them, and their original offsets and the occurrence that stays are kept beside.

A digest that a third of all documents share is aggregated before it moves, and the join back is split by adaptive
execution. Texts meet their own removals only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import stored, table
from stratavox.llm.registry import query

LEAST_WORDS = 5
#: A unit ends with a line feed, or with a sentence end and the blanks after it.
UNIT_END = r"[.!?][ \t]+|\n"
ROWS = 20_000


_END = re.compile(UNIT_END)


def cut_units(text: str) -> list[str]:
    """Units of a text with the white space that ends them; together they are the text."""
    ends = [m.end() for m in _END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def _units(least_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "version", "nth", "start", "length", "digest"]
    for batch in batches:
        kinds = [batch["id"].type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows = []
        for name, version, text in zip(batch["id"].to_pylist(), batch["version"].to_pylist(), batch["text"]):
            start = 0
            for nth, unit in enumerate(cut_units(text.as_py())):
                norm = b" ".join(unit.encode("utf-8", "replace").lower().split())
                if norm.count(b" ") >= least_words - 1:
                    rows.append((name, version, nth, start, len(unit), hashlib.blake2b(norm, digest_size=16).digest()))
                start += len(unit)
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def repeated_units(docs: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, version, nth, start, length of every unit to remove, with keep_id and keep_start of the occurrence that stays."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("version"), "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, version long, nth int, start long, length long, digest binary"
    units = stored(rows.mapInArrow(lambda batches: _units(least_words, batches), schema))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("version").alias("version"), F.col("nth").alias("nth"), F.col("start").alias("start"))
    first = units.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep")).where("n > 1")
    met = units.join(first.drop("n"), "digest")
    is_first = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("version") == F.col("keep.version")) & (F.col("nth") == F.col("keep.nth"))
    return met.where(~is_first).select(
        "id", "version", "nth", "start", "length", F.col("keep.id").alias("keep_id"), F.col("keep.start").alias("keep_start")
    )


def _kept(texts: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, removed):
        if gone is None or not len(gone):
            out.append(text)
            continue
        lost = {int(x) for x in gone}
        out.append("".join([unit for i, unit in enumerate(cut_units(text)) if i not in lost]))
    return pd.Series(out, dtype=object)


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_units, kept (text), removed (array of nth, start, length, keep_id, keep_start).

    Units of fewer than ``least_words`` words are never removed. Null and empty texts have one empty unit and lose nothing.
    Null ids come last; repeated rows (same id and text) count as one document and each get its result; several rows of one id
    with different texts are ranked by a hash of the text. An empty table gives an empty result.
    """
    gone = repeated_units(docs, id_col, text_col, least_words)
    entry = F.struct("nth", "start", "length", "keep_id", "keep_start")
    lists = gone.groupBy("id", "version").agg(F.sort_array(F.collect_set(entry)).alias("removed"))  # units of one document
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_version"), text.alias("_text"))
    met = rows.join(lists, rows["_id"].eqNullSafe(lists["id"]) & (rows["_version"] == lists["version"]), "left")
    cut = F.pandas_udf(_kept, "string")
    return met.select(
        F.col("_id").alias(id_col),
        (F.regexp_count("_text", F.lit(UNIT_END)) + 1).cast("long").alias("n_units"),
        cut("_text", F.col("removed.nth")).alias("kept"),
        "removed",
    )


@query(
    "op4_unit_dedup",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t]+|\n)', '\1' || chr(57344), 'g'), chr(57344)) AS l FROM documents
    ), u AS (SELECT doc_id, t, i, l[i] AS line, trim(regexp_replace(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
      FROM d, unnest(generate_series(1, len(l))) AS s(i)
    ), o AS (SELECT doc_id, i, line, length(line) AS n, norm, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u
    ), r AS (SELECT *, CASE WHEN len(string_split(norm, ' ')) >= 5 THEN row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) ELSE 1 END AS k,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id, i) AS keep_id FROM o)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_units, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
      CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS removed_chars,
      coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '+' || CAST(n AS VARCHAR) || '=' || CAST(keep_id AS VARCHAR), ',' ORDER BY i) FILTER (k > 1), '') AS removed_spans,
      sha256(coalesce(string_agg(line, '' ORDER BY i) FILTER (k = 1), '')) AS kept_sha256
    FROM r GROUP BY doc_id
    """,
)
def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units, units removed, their code points, start+length=keeping document of each, digest of what is left."""
    found = dedup_units(table(spark, sf_dir, "documents"))
    removed = F.coalesce("removed", F.array())
    span = lambda x: F.concat(x["start"], F.lit("+"), x["length"], F.lit("="), x["keep_id"])
    return found.select(
        "doc_id",
        "n_units",
        F.size(removed).cast("long").alias("n_removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("removed_chars"),
        F.array_join(F.transform(removed, span), ",").alias("removed_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
