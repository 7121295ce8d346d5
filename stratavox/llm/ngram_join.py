"""Similarity join on word n-grams: a blocked sparse product of the document by n-gram incidence matrix.

The product D x D' holds the overlap of every two documents. Most of it is never formed:

* Columns are ordered by rarity over the whole corpus. Two documents whose Jaccard similarity reaches the threshold share
  one of the first n - ceil(threshold n) + 1 columns of either, so only these columns link documents into families, and
  columns that a single document has link nothing.
* A family's rows are cut into blocks. A block product accumulates overlap counts over chunks of columns, discards pairs whose
  overlap is below the bound that both sizes set, and returns a spanning set of links instead of all of them.
* Large families go in two rounds: each block with itself and with the family's first block; then only documents outside the
  family's largest component with all others. Pairs inside one component cannot change the result and are not formed.

Equal sets are one row of the matrix, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.blocks import Block, bucket_count, make_blocks, meet, mix, send, settle
from stratavox.llm.common import free_name, stored, table
from stratavox.llm.graph import components
from stratavox.llm.registry import query

ROWS = 256
COLUMNS = 4096
#: Fixed value: the seed of Spark's xxhash64.
SPARK_SEED = 42


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def shingles(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, end to end, and where each document's begin.

    A document of fewer words is one shingle; one without words has none.
    """
    codes, names, first = block.words()
    values = mix(names)[codes]
    rolled = np.zeros(max(len(values) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + values[k : k + len(rolled)])
    out, begin = [], [0]
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n >= words:
            own = np.unique(rolled[first[i] : first[i + 1] - words + 1])
        elif n:
            own = mix(np.array([xxhash.xxh3_64_intdigest(values[first[i] : first[i + 1]].tobytes(), int(n))], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        begin.append(begin[-1] + len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(begin)


def prefix_length(n: int, percent: int) -> int:
    """Columns of a document of ``n`` of which any partner has one: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _rarity(got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """0 for a shingle that one document of the corpus has, else the bit length of how many have it."""
    keys = np.concatenate([k for k, _ in got])
    counts = np.concatenate([c for _, c in got]).astype(np.float64)
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct))[at]
    level = np.where(total > 1, np.frexp(total)[1], 0).astype(np.uint8)
    return [[x] for x in np.split(level, np.cumsum([len(k) for k, _ in got])[:-1])]


def incidence(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """id, version (xxhash64 of the text as Spark has it), node (hash of the set), n, and for the first of equal sets in a block that may have a partner: prefix, columns."""
    blocks = make_blocks(docs, id_col, text_col)
    buckets = bucket_count(docs, text_col, 1.3)

    def emit(block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, counts = np.unique(shingles(block, words)[0], return_counts=True)
        return keys, [counts.astype(np.uint32)]

    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("version", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
            T.StructField("columns", T.BinaryType()),
        ]
    )

    def rows(block: Block, answers: list[list[np.ndarray] | None]) -> pa.Table:
        flat, begin = shingles(block, words)
        keys = np.unique(flat)
        level = answers[0][0][np.searchsorted(keys, flat)] if answers[0] else np.zeros(0, np.uint8)
        nodes, sizes, prefixes, columns, seen = [], np.diff(begin), [], [], set()
        texts = (block.raw[a : a + n] for a, n in zip(block.starts.tolist(), block.lengths.tolist()))
        versions = [signed(xxhash.xxh64_intdigest(t, SPARK_SEED)) for t in texts]
        for i, n in enumerate(sizes.tolist()):
            own = flat[begin[i] : begin[i + 1]]
            node = signed(xxhash.xxh3_64_intdigest(own.tobytes())) if n else None
            nodes.append(node)
            prefix = None
            if n and node not in seen:
                seen.add(node)
                rank = level[begin[i] : begin[i + 1]]
                first = np.argsort(rank, kind="stable")[: prefix_length(n, percent)]
                shared = own[first[rank[first] > 0]]
                prefix = shared.view(np.int64).tolist() if len(shared) else None
            prefixes.append(prefix)
            columns.append(own.tobytes() if prefix is not None else None)
        return pa.table(
            {
                "id": block.ids,
                "version": pa.array(versions, pa.int64()),
                "node": pa.array(nodes, pa.int64()),
                "n": pa.array(sizes, pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "columns": pa.array(columns, pa.binary()),
            }
        )

    answers = settle(send(blocks, emit, buckets), _rarity)
    return stored(meet(blocks, [answers], rows, schema))


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between rows of ``left`` (and of ``right``, or among themselves): a spanning set, as (left row, right row)."""
    sets = left if right is None else left + right
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    flat, row = flat[by], row[by]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    keep = held[column] > 1  # a column with one row adds to no pair
    row, column = row[keep], column[keep]
    if not len(row):
        return []
    column = np.unique(column, return_inverse=True)[1]
    n, m = len(left), len(sets)
    overlap = np.zeros((n, m if right is None else m - n), np.float64)
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS))
    for begin, end in zip(edges[:-1], edges[1:]):
        part = np.zeros((m, COLUMNS), np.float32)
        part[row[begin:end], column[begin:end] % COLUMNS] = 1.0
        overlap += part[:n] @ (part.T if right is None else part[n:].T)
    other = sizes if right is None else sizes[n:]
    union = sizes[:n, None] + other[None, :] - overlap
    hit = 100 * overlap >= percent * union
    if right is None:
        hit &= np.tri(n, n, -1, dtype=bool).T
    root = list(range(n + (0 if right is None else m - n)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
        a, b = top(i), top(j if right is None else n + j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _products(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block products over rows sorted by (family, p, q, side): side 0 rows with each other and side 1, or only the latter.

    ``inner``: whether rows of side 0 are also compared with each other.
    """
    key, sides, inner = None, ([], []), False

    def close() -> Iterator[pa.RecordBatch]:
        links = []
        left, right = sides
        if left:
            cols = [[c for _, c in side] for side in sides]
            if inner and len(left) > 1:
                links += [(left[i][0], left[j][0]) for i, j in _linked(cols[0], None, percent)]
            if right:
                links += [(left[i][0], right[j][0]) for i, j in _linked(cols[0], cols[1], percent)]
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("family", "p", "q"))))
        for i, now in enumerate(keys):
            if now != key:
                yield from close()
                key, sides = now, ([], [])
            inner = batch["inner"][i].as_py()
            sides[batch["side"][i].as_py()].append((batch["node"][i].as_py(), np.frombuffer(batch["columns"][i].as_py(), np.uint64)))
    yield from close()


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows: family, p, q, side, inner, node, columns. Links (a, b)."""
    order = ["family", "p", "q", "side"]
    dealt = rows.repartition("family", "p", "q").sortWithinPartitions(*order)
    return dealt.select(*order, "inner", "node", "columns").mapInArrow(lambda b: _products(percent, b), "a long, b long")


def similarity_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows_per_block: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, version (hash of the text), n_shingles, node (hash of the set), root (the node that names its class).

    Documents link when 100 |A & B| >= percent |A | B| over their sets of ``words``-word shingles (A-Z in lower case; a
    shorter text is one shingle), and classes are what links connect. Texts without words have no set, link with nothing
    and have null node and root. Sets are told apart by 64-bit hashes of shingles and sets.
    """
    rows = incidence(docs, id_col, text_col, words, percent)
    matrix = stored(
        rows.where("columns is not null").groupBy("node").agg(F.first("prefix").alias("prefix"), F.first("columns").alias("columns"))
    )
    entries = matrix.select(F.explode("prefix").alias("column"), "node")
    shared = entries.groupBy("column").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    near = entries.join(shared, "column").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    hung = components(near)
    family = stored(hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "family"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("size") / rows_per_block).cast("long")))
    members = stored(
        family.join(matrix.select("node", "columns"), "node")
        .join(sizes, "family")
        .withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    )
    own = members.select("family", "p", F.lit(-1).cast("long").alias("q"), F.lit(0).alias("side"), F.lit(True).alias("inner"), "node", "columns")
    hub = members.where("parts > 1 and p = 0").select(
        "family",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("p"),
        F.lit(-1).cast("long").alias("q"),
        F.lit(1).alias("side"),
        F.lit(True).alias("inner"),
        "node",
        "columns",
    )
    first = stored(_block_links(own.unionByName(hub), percent))
    # Second round, families of several blocks: what is outside the largest component, with everything.
    large = members.where("parts > 1").select("family", "parts", "node")
    roots = components(first)
    labelled = stored(
        large.join(roots, "node", "left").select("family", "parts", "node", F.coalesce("root", "node").alias("root"))
    )
    tally = labelled.groupBy("family", "root").agg(F.count(F.lit(1)).alias("held"))
    main = tally.groupBy("family").agg(F.max(F.struct("held", "root")).alias("top"), F.sum("held").alias("size"))
    main = main.select("family", F.col("top.root").alias("main"), F.ceil((F.col("size") - F.col("top.held")) / rows_per_block).cast("long").alias("lone"))
    placed = labelled.join(main.where("lone > 0"), "family").join(members.select("node", "columns"), "node")
    left = placed.where("root <> main").select(
        "family",
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("lone")).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"),
        F.lit(0).alias("side"),
        F.lit(False).alias("inner"),
        "node",
        "columns",
    )
    right = placed.select(
        "family",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lone") - 1)).alias("p"),
        F.pmod(F.xxhash64("node"), F.col("parts")).alias("q"),
        F.lit(1).alias("side"),
        F.lit(False).alias("inner"),
        "node",
        "columns",
    )
    second = stored(_block_links(left.unionByName(right), percent).where("a <> b"))
    joined = components(first.unionByName(second))
    return rows.join(joined, "node", "left").select(
        F.col("id").alias(id_col), "version", F.col("n").alias("n_shingles"), "node", F.coalesce("root", "node").alias("root")
    )


def join_ngrams(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, rows_per_block: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id of its class; its own id without words).

    Null ids come last: a class of null ids only has a null component. Repeated rows are in one class.
    """
    found = stored(similarity_classes(docs, id_col, text_col, words, percent, rows_per_block))
    least = found.where("root is not null").groupBy("root").agg(F.min(id_col).alias("_least"))
    return found.join(least, "root", "left").select(
        id_col, "n_shingles", F.when(F.col("root").isNull(), F.col(id_col)).otherwise(F.col("_least")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class the row with the smallest id (null ids last).

    Rows without words stay. Rows that share the smallest id of a class but not their text: the set that hashes lowest
    stays; rows that share both stay together, as an exact dedup goes before.
    """
    found = stored(similarity_classes(docs, id_col, text_col, words, percent))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("node").alias("node"))
    best = found.where("root is not null").groupBy("root").agg(F.min(order).alias("best"))
    # Rows to drop, by id and set; documents alone in their class are never among them.
    lost = (
        found.join(best, "root")
        .where(~F.col(id_col).eqNullSafe(F.col("best.id")) | (F.col("node") != F.col("best.node")))
        .select(F.col(id_col).alias("_lost_id"), F.col("version").alias("_lost_version"))
        .distinct()
    )
    name = free_name(docs, "_row_version")
    marked = docs.withColumn(name, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = marked[id_col].eqNullSafe(lost["_lost_id"]) & (marked[name] == lost["_lost_version"])
    return marked.join(lost, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    "op7_ngram_join",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d
    ), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
    ), p AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * b.n >= 9 * a.n AND 10 * a.n >= 9 * b.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p
    ), r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
    SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(g)
    """,
)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"), words=3, percent=90)
