"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is the run of ten words of an item that must occur in a document. Every occurrence contains the window's rarest
word (its necessary prefix token) at a known place, so documents are joined to windows on that word alone. The bounds that
follow are cheap: the window must fit into the document around that place (length), and its second rarest word must
stand at its own distance (position). Only what passes is compared word by word. Rarity is counted over all documents.

Documents are never shuffled: the windows, in blocks of at most ``BLOCK_WINDOWS``, are broadcast to them, and only hits
(document, first word, last word, window) move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.llm.common import free_name, lower_ascii, stored, table
from stratavox.llm.registry import query

WINDOW_WORDS = 10
BLOCK_WINDOWS = 100_000
#: Fixed value: a word is a run of ASCII letters, digits and any characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """item, window (array of words): every run of ``size`` words, or the whole of a shorter item."""
    words = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    return words.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, size))).alias("window")).distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words, and the hash that with the id names a row; repeated rows share both and count as one document."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), words_of(F.col(text_col)).alias("words")
    )


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, size: int) -> DataFrame:
    """id, version, n_words and per document n_hit, items (sorted array of ids as text); one row per distinct (id, text)."""
    keyed = _keyed(docs, id_col, text_col)
    # Windows with their ids; items that share a window share its row.
    windows = stored(
        item_windows(items, item_col, item_text, size)
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("wid", F.xxhash64(F.array_join("window", " ")))
    )
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    many = vocabulary.count()
    occurrences = keyed.select(F.explode("words").alias("word"))
    small = F.broadcast(vocabulary) if many <= BLOCK_WINDOWS * size else vocabulary
    rarity = stored(occurrences.join(small, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("seen")))
    # Places of each window's words, rarest first; a word that no document has rules its window out.
    placed = windows.select("wid", "window", F.posexplode("window").alias("at", "word")).join(rarity, "word")
    ranked = placed.groupBy("wid").agg(
        F.first("window").alias("window"), F.sort_array(F.collect_list(F.struct("seen", "word", "at"))).alias("by")
    )
    anchors = ranked.where(F.size("by") == F.size("window")).select(
        "wid",
        "window",
        F.col("by")[0]["word"].alias("word"),
        F.col("by")[0]["at"].alias("at"),
        F.col("by")[F.least(F.lit(1), F.size("by") - 1)]["word"].alias("word2"),
        F.col("by")[F.least(F.lit(1), F.size("by") - 1)]["at"].alias("at2"),
        F.size("window").alias("span"),
    )
    # One more row per document carries its number of words: the empty word, which no window has.
    blocks = -(-windows.count() // BLOCK_WINDOWS) or 1
    counter = docs.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("wid"),
        F.array(F.lit("")).alias("window"),
        F.lit("").alias("word"),
        F.lit(0).alias("at"),
        F.lit("").alias("word2"),
        F.lit(0).alias("at2"),
        F.lit(1).alias("span"),
    )
    exploded = keyed.select("id", "version", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("place", "word"))
    found = None
    for block in range(blocks):
        part = anchors if blocks == 1 else anchors.where(F.pmod(F.col("wid"), F.lit(blocks)) == block)
        # At most about BLOCK_WINDOWS windows of ``size`` words: a bound that does not depend on the documents.
        side = F.broadcast(part.unionByName(counter) if block == 0 else part)
        begin = F.col("place") - F.col("at")
        met = (
            exploded.join(side, "word")
            .where(
                F.col("wid").isNull()
                | (
                    (begin >= 0)
                    & (begin + F.col("span") <= F.size("words"))
                    & (F.try_element_at("words", begin + F.col("at2") + 1) == F.col("word2"))
                    & (F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("span")) == F.col("window"))
                )
            )
            .select(
                "id",
                "version",
                "wid",
                F.when(F.col("wid").isNotNull(), begin).alias("begin"),
                F.when(F.col("wid").isNotNull(), begin + F.col("span")).alias("end"),
                F.when(F.col("wid").isNull(), F.size("words")).alias("n"),
            )
        )
        found = met if found is None else found.unionByName(met)
    found = stored(found)
    sizes = found.where(F.col("wid").isNull()).groupBy("id", "version").agg(F.max("n").cast("long").alias("n_words"))
    matched = found.where(F.col("wid").isNotNull())
    # Words covered by the union of the runs: each run adds what reaches beyond all runs before it.
    runs = matched.select("id", "version", "begin", "end").distinct()
    earlier = Window.partitionBy("id", "version").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        runs.withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0)))
        .groupBy("id", "version")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "reach"))).cast("long").alias("n_hit"))
    )
    hit_items = (
        matched.select("id", "version", "wid")
        .distinct()
        .join(windows.select("wid", F.explode("items").alias("item")), "wid")
        .groupBy("id", "version")
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    null_safe = lambda a, b: (a["id"].eqNullSafe(b["id"])) & (a["version"] == b["version"])
    with_hits = sizes.join(covered, null_safe(sizes, covered), "left").select(sizes["*"], "n_hit")
    joined = with_hits.join(hit_items, null_safe(with_hits, hit_items), "left").select(with_hits["*"], "items")
    return joined.select(
        "id",
        "version",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies inside an occurrence of any window. Null and empty texts have no words and no hits; items
    without words have no window, and items with a null id are not counted or listed, though their windows hit. Repeated rows each get
    their row. An empty document table gives an empty result, an empty benchmark no hits.
    """
    found = hits(docs, items, id_col, text_col, item_col, item_text, size)
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_version"))
    met = rows.join(found, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version")))
    return met.select(
        F.col("row_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    found = hits(docs, items, id_col, text_col, "item_id", "text", WINDOW_WORDS).where("n_hit > 0").select(
        F.col("id").alias("_hit_id"), F.col("version").alias("_hit_version")
    )
    name = free_name(docs, "_row_version")
    rows = docs.withColumn(name, F.xxhash64(text_col))
    same = rows[id_col].eqNullSafe(found["_hit_id"]) & (rows[name] == found["_hit_version"])
    return rows.join(found, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    "op9_decontaminate",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), win AS (
      SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS x FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0
    ), spans AS (SELECT DISTINCT len(x) AS n FROM win
    ), dw AS (
      SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS x FROM d, spans, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n
    ), m AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (x)
    ), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + n - 1)) AS u(p) GROUP BY doc_id
    ), k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
