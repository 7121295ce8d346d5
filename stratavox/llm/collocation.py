"""Collocations: word suffixes sorted by multikey three-way quicksort, equal partitions are counts.

A text is cut into pieces, a piece into words; every word position is a suffix of which the leading ``LONGEST`` words matter.

* The word table comes first: (language, word) with its 64-bit name and count. Two words of one name are found here, and the
  pass is repeated with another seed, so that equal names are equal words from then on.
* A set of bits of fixed size tells tasks which words can be frequent at all; suffixes end in front of others.
* Suffix pointers of a group of texts are sorted and equal ones merged, and rows of (up to four names, count) are routed by their
  leading words: range partitions of the suffix order, whose last column is a salt, so that nothing is too hot to split.
* Each range is partitioned by a multikey three-way quicksort, all partitions of a round at once. An equal partition at depth
  d is a phrase of d words and its size the count; partitions below the least count are abandoned. Only the first and the last
  phrase of each depth may go on in a neighbouring range: these few are added up by Spark.
* Parts of phrases and longer phrases meet by joins on the names; scores are whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.llm.common import give_back, stored, table
from stratavox.llm.registry import query

LONGEST = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer candidate around it has this share of its count, in percent.
COVERED = 80
SCALE = 2_000_000
GROUP_BYTES = 6 << 20
RANGE_ROWS = 500_000
FEWEST_RANGES = 32
SALTS = 4096
#: 2**26 bits, 8 MB whatever the number of words.
SLOT_BITS = 26
CHUNK_BITS = 15

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_CUT = re.compile(rb"[.,;:!?\n-\r]")


def slices(raw: bytes, most: int) -> Iterator[bytes]:
    """A long text cut between pieces, about ``most`` bytes at a time."""
    begin = 0
    while len(raw) - begin > most:
        cut = _CUT.search(raw, begin + most)
        if cut is None:
            break
        yield raw[begin : cut.end()]
        begin = cut.end()
    yield raw[begin:]


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts of it): the rows of a task in groups of about ``most`` bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for part in slices(text.as_py().encode("utf-8", "replace"), most):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= most:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def read_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, word number per position, piece number per position; A-Z in lower case."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    kind = _KIND[raw]
    solid = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), piece


def names_of(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """64-bit names of a language's words; 0 stands for no word."""
    front = lang.encode("utf-8", "replace") + b"\n"
    names = np.fromiter((xxhash.xxh3_64_intdigest(front + w, seed) for w in words), np.uint64, len(words))
    return np.maximum(names, np.uint64(1)).view(np.int64)


def three_way(keys: np.ndarray, weights: np.ndarray, least: int, seed: int = 7) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a pointer into each phrase, count) for phrases of two words and more that weigh ``least`` or more.

    ``keys`` has a row per depth and a column per suffix. Every round parts all open partitions by a pivot of their own into
    less, equal and greater; an equal partition goes on with the next word. A word 0 ends a suffix.
    """
    rng = np.random.default_rng(seed)
    pointers = np.arange(keys.shape[1])
    starts, depth = np.array([0]), np.array([0])
    if weights.sum() < least:
        return
    while len(starts):
        sizes = np.diff(np.append(starts, len(pointers)))
        segment = np.repeat(np.arange(len(starts)), sizes)
        pivot = keys[depth, pointers[starts + (rng.random(len(starts)) * sizes).astype(np.int64)]]
        own = keys[depth[segment], pointers]
        side = (own >= pivot[segment]).astype(np.int8) + (own > pivot[segment])
        counts = np.bincount(segment * 3 + side, minlength=3 * len(starts))
        first = np.cumsum(counts) - counts
        place = np.empty(len(pointers), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            number = segment[mine]
            before = np.cumsum(counts[k::3]) - counts[k::3]
            place[mine] = first[number * 3 + k] + np.arange(len(mine)) - before[number]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        full = np.flatnonzero(counts)
        weight = np.zeros(len(counts), np.int64)
        weight[full] = np.add.reduceat(weights[moved], first[full])
        equal = np.arange(len(counts)) % 3 == 1
        deeper = np.repeat(depth, 3) + equal
        going = (weight >= least) & ~(equal & (np.repeat(pivot, 3) == 0))
        for d in range(2, len(keys) + 1):
            found = np.flatnonzero(going & equal & (deeper == d))
            if len(found):
                yield d, moved[first[found]], weight[found]
        going &= deeper < len(keys)
        pointers = moved[np.repeat(going, counts)]
        depth, sizes = deeper[going], counts[going]
        starts = np.cumsum(sizes) - sizes


def edge_rows(keys: np.ndarray) -> list[np.ndarray]:
    """The smallest and the largest suffix of a range."""
    out = []
    for pick in (np.min, np.max):
        alive, word = np.arange(keys.shape[1]), []
        for row in keys:
            word.append(pick(row[alive]))
            alive = alive[row[alive] == word[-1]]
        out.append(np.array(word))
    return out


def counted(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a range (a column each, 0 behind their end), counts, and whether the count may go on in another range."""
    edges = edge_rows(keys)
    phrases, counts, partial = [], [], []
    for d, at, weight in three_way(keys, weights, least):
        own = keys[:, at].copy()
        own[d:] = 0
        inner = ~np.logical_or(*[(own[:d] == e[:d, None]).all(0) for e in edges])
        phrases.append(own[:, inner])
        counts.append(weight[inner])
        partial.append(np.zeros(inner.sum(), bool))
    for d in range(2, len(keys) + 1):
        for e in {tuple(x[:d].tolist()) for x in edges}:
            if e[-1]:
                phrases.append(np.array([*e, *[0] * (len(keys) - d)])[:, None])
                counts.append(weights[(keys[:d] == np.array(e)[:, None]).all(0)].sum()[None])
                partial.append(np.ones(1, bool))
    if not phrases:
        return np.zeros((len(keys), 0), np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(phrases, axis=1), np.concatenate(counts), np.concatenate(partial)


def word_table(docs: DataFrame, least: int, group_bytes: int) -> tuple[DataFrame, int]:
    """(h, lang, word, f) of words that occur ``least`` times or more, a word '' per language for all of them, and the seed."""
    seed = 0
    while True:

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for lang, texts in groups(batches, group_bytes):
                words, codes, _ = read_words(texts)
                n = [*np.bincount(codes, minlength=len(words)).tolist(), len(codes)]
                words.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names_of(lang, words, seed)),
                        pa.array([lang] * len(words), pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array(n, pa.int64()),
                    ],
                    ["h", "lang", "word", "n"],
                )
                give_back()

        named = docs.mapInArrow(count, "h long, lang string, word string, n long")
        one = F.struct("lang", "word")
        merged = named.groupBy("h").agg(F.sum("n").alias("f"), F.min(one).alias("one"), F.max(one).alias("other"))
        kept = stored(merged.where((F.col("f") >= least) | (F.col("one.word") == "") | (F.col("other.word") == "")))
        if kept.where("one <> other").isEmpty():
            return kept.select("h", "one.lang", "one.word", "f"), seed
        seed += 1


def frequent_slots(words: DataFrame) -> bytes:
    """A bit per slot of the names, set where a frequent word has it."""
    per_chunk = 1 << CHUNK_BITS

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros(per_chunk, bool)
        bits[group["bit"].to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.col("h").bitwiseAND((1 << SLOT_BITS) - 1)
    spots = words.where("word <> ''").select(
        F.shiftright(slot, CHUNK_BITS).cast("int").alias("chunk"), slot.bitwiseAND(per_chunk - 1).cast("int").alias("bit")
    )
    size = per_chunk // 8
    out = bytearray(size << (SLOT_BITS - CHUNK_BITS))
    for row in spots.distinct().groupBy("chunk").applyInArrow(pack, "chunk int, body binary").collect():  # 8 MB in all
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = row["body"]
    return bytes(out)


def suffixes(docs: DataFrame, seed: int, slots: bytes, group_bytes: int) -> DataFrame:
    """h1..h4, n, salt: suffixes of two words and more, merged within each group of texts."""
    frequent = docs.sparkSession.sparkContext.broadcast(slots)  # 8 MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part, number = np.frombuffer(frequent.value, np.uint8), TaskContext.get().partitionId(), 0
        for lang, texts in groups(batches, group_bytes):
            words, codes, piece = read_words(texts)
            names = names_of(lang, words, seed)
            slot = names & ((1 << SLOT_BITS) - 1)
            alive = ((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)[codes]
            new = np.ones(len(codes), bool)
            new[1:] = (piece[1:] != piece[:-1]) | ~alive[1:] | ~alive[:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(codes))[np.cumsum(new) - 1] if len(codes) else begin
            left = np.where(alive, end - np.arange(len(codes)), 0)
            at = np.flatnonzero(left >= 2)
            left = left[at]
            far = [codes[at].astype(np.int64)]
            for k in range(1, LONGEST):
                inside = left > k
                far.append(np.where(inside, codes[np.where(inside, at + k, 0)].astype(np.int64) + 1, 0))
            front, back = far[0] << 32 | far[1], far[2] << 32 | far[3]
            by = np.lexsort((back, front))
            front, back = front[by], back[by]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (front[1:] != front[:-1]) | (back[1:] != back[:-1])
            first = np.flatnonzero(fresh)
            named = np.append(0, names)
            low = (1 << 32) - 1
            columns = [names[front[first] >> 32], *[named[x] for x in (front[first] & low, back[first] >> 32, back[first] & low)]]
            number += 1
            salt = np.full(len(first), (part * 31 + number) % SALTS, np.int32)
            n = np.diff(np.append(first, len(by)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, n, salt)], ["h1", "h2", "h3", "h4", "n", "salt"])
            give_back()

    return stored(docs.mapInArrow(cut, "h1 long, h2 long, h3 long, h4 long, n long, salt int"), "zstd")


def phrase_counts(rows: DataFrame, least: int, range_rows: int, ranges: int) -> DataFrame:
    """(key array of names, a): phrases of two words and more that occur ``least`` times or more. Stored."""
    names = ["h1", "h2", "h3", "h4"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b[c].to_numpy() for c in (*names, "n")] for b in batches if b.num_rows]
        if not parts:
            return
        *keys, weights = [np.concatenate(x) for x in zip(*parts)]
        del parts
        phrases, counts, partial = counted(np.stack(keys), weights, least)
        yield pa.RecordBatch.from_arrays([*map(pa.array, phrases), pa.array(counts), pa.array(partial)], [*names, "a", "partial"])
        give_back()

    wanted = max(ranges, -(-rows.count() // range_rows))
    found = stored(rows.repartitionByRange(wanted, *names, "salt").mapInArrow(sort, "h1 long, h2 long, h3 long, h4 long, a long, partial boolean"))
    shared = found.where("partial").groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    every = found.where("not partial").select(*names, "a").unionByName(shared)
    return stored(every.select(F.filter(F.array(*names), lambda h: h != 0).alias("key"), "a"))


def part_scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(key, a, l, r, score) by the cut that scores lowest, the earliest of several."""
    known = phrases.select("key", F.col("a").alias("f")).unionByName(words.where("word <> ''").select(F.array("h").alias("key"), "f"))
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")).withColumns(
        {"left": F.expr("slice(key, 1, k)"), "right": F.expr("slice(key, k + 1, size(key) - k)")}
    )
    met = cuts.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(
        known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right"
    )
    score = F.expr(f"cast({SCALE} as decimal(8, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = met.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("key", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, scored: DataFrame, covered: int) -> DataFrame:
    """Without phrases that lie in a longer one with at least ``covered`` percent of their count."""
    size = F.size("key")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("key", at, n)),
        )
    )
    longer = phrases.where(size >= 3).select(F.explode(spans).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    joined = scored.join(longer, "key", "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)).drop("longer")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
    group_bytes: int = GROUP_BYTES,
    range_rows: int = RANGE_ROWS,
    ranges: int = FEWEST_RANGES,
) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``, a null text empty; repeated rows count as often as they occur. A language without phrases has
    no rows, an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    words, seed = word_table(rows, least, group_bytes)
    phrases = phrase_counts(suffixes(rows, seed, frequent_slots(words), group_bytes), least, range_rows, ranges)
    kept = uncovered(phrases, part_scores(phrases, words), covered)
    spelt = kept.select("key", "a", "l", "r", "score", F.posexplode("key").alias("at", "h")).join(words.drop("f"), "h")
    texts = spelt.groupBy("key", "a", "l", "r", "score").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")  # four at most
    )
    texts = texts.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score", F.xxhash64("key").alias("mixed"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each share first: a language may hold most of the phrases.
    shares = texts.withColumn("share", F.pmod("mixed", F.lit(64)))
    best = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.where("word = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs
), lists AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), spans AS (
  SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(w) >= d
), grams AS (
  SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE d = 1 GROUP BY lang
), candidates AS (
  SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE d >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, d)) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.d], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, a, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, d - n + 2)) AS i FROM (SELECT *, unnest(range(2, d)) AS n FROM candidates))
), longest AS (
  SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longest USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
