"""Language identification by prediction by partial matching.

Per language a byte context tree of variable order: a context of up to ``ORDER`` bytes predicts the next byte from the
counts of what followed it (method C: escape mass = distinct followers), and an escape hands its mass to the next shorter
context, shared out over the bytes not yet excluded. Below order 0 every byte has 1/256. The statistics are frozen after
training, so a text's code length is exact, and the language with the shortest code wins.

The trees are learned from a bounded sample: whole texts of about ``SAMPLE_BYTES`` bytes per language, chosen by a hash of
the row. That bounds the model whatever the size of the table: every gram of the sample is kept, and only the pairs of a gram
and a language that occur are stored, so a language's room does not depend on how many others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import fold, free_name, give_back, table
from stratavox.llm.registry import query

ORDER = 4
SAMPLE_BYTES = 1_500_000
#: Evidence beyond so many bytes does not raise the score further.
SCORE_BYTES = 256
CHUNK = 1 << 18
SLICE = 512
#: Languages up to which all grams of two bytes have a row of their own in a dense table.
DENSE_LANGUAGES = 64
UNKNOWN = "und"


class Slots:
    """Open-addressing table from 64-bit keys to their place in a sorted array; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.place = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.place[at] < 0
            spot, one = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.place[spot] = todo[taken]
            self.keys[spot] = keys[todo[taken]]
            left = np.ones(len(todo), bool)
            left[taken] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if absent."""
        at = self._home(keys)
        out = self.place[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            nxt = (at[wrong] + 1) & self.mask
            at[wrong] = nxt
            out[wrong] = self.place[nxt]
            wrong = wrong[(self.keys[nxt] != keys[wrong]) & (out[wrong] >= 0)]
        return out


def grams(stream: np.ndarray) -> np.ndarray:
    """The (ORDER + 1)-byte gram that ends at each byte of ``stream`` from place ORDER on, packed into an integer."""
    n = len(stream) - ORDER
    key = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER + 1):
        key <<= 8
        key |= stream[k : k + n]
    return key


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one stream, ORDER zero bytes before each, and the length of each text."""
    gap = b"\0" * ORDER
    return np.frombuffer(gap + gap.join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


class Pairs:
    """A value per pair of a key and a language; the pairs of a key lie together. ``both``: key * languages + language, ascending."""

    def __init__(self, both: np.ndarray, size: int, values: np.ndarray):
        keys = both // size
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.slots = Slots(keys[first])
        self.edges = np.append(first, len(keys))
        self.lang = (both % size).astype(np.int32)
        self.values = values.astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``keys``, language and value of every pair that is known."""
        place = self.slots.find(keys)
        row = np.flatnonzero(place >= 0)
        begin = self.edges[place[row]]
        count = self.edges[place[row] + 1] - begin
        ends = np.cumsum(count)
        at = np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(row, count), self.lang[at], self.values[at]


class Trees:
    """Frozen context trees of all languages: per order the grams and the escapes of the contexts, each by language."""

    def __init__(self, langs: list[str], which: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.langs = langs
        size = max(1, len(langs))
        below = below_both = None
        self.tables: list[tuple[Pairs, Pairs]] = []
        for k in range(ORDER + 1):
            both, at = np.unique((keys & ((1 << 8 * (k + 1)) - 1)) * size + which, return_inverse=True)
            count = np.bincount(at, weights=counts, minlength=len(both))
            gram, lang = both // size, both % size
            contexts, of = np.unique((gram >> 8) * size + lang, return_inverse=True)
            if k:  # the end of a gram that occurs in a language occurs in it too
                shorter = below[np.searchsorted(below_both, (gram & ((1 << 8 * k) - 1)) * size + lang)]
            else:
                shorter = np.full(len(both), -np.log(256.0))
            total, kinds, mass = (np.bincount(of, weights=w, minlength=len(contexts)) for w in (count, np.ones(len(both)), np.exp(shorter)))
            escape = np.log(kinds / (total + kinds)) - np.log1p(-np.minimum(mass, 1 - 1e-12))
            own = np.log(count) - np.log(total + kinds)[of]
            self.tables.append((Pairs(both, size, own), Pairs(contexts, size, escape)))
            below, below_both = own, both
        self.dense: list[np.ndarray] = []
        for k in range(2 if len(langs) <= DENSE_LANGUAGES else 1):
            self.dense.append(self.log_p(np.arange(256 ** (k + 1)), k))

    def log_p(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probability of each gram's last byte after its context, a column per language."""
        if order < 0:
            return np.full((len(key), len(self.langs)), -np.log(256.0), np.float32)
        if order < len(self.dense):
            return self.dense[order][key]
        grams_of, escapes = self.tables[order]
        out = self.log_p(key & ((1 << 8 * max(order, 1)) - 1), order - 1)
        row, lang, value = escapes.find(key >> 8)
        out[row, lang] += value
        row, lang, value = grams_of.find(key)
        out[row, lang] = value
        return out

    def code(self, texts: list[bytes]) -> np.ndarray:
        """Natural log probability of each whole text, a column per language."""
        stream, lengths = padded(texts)
        total = np.zeros((len(texts), len(self.langs)))
        # Byte j of text i ends the gram at (start of the text in the stream) + j - ORDER.
        starts = np.cumsum(lengths + ORDER) - lengths - ORDER
        step = max(4096, 8 * CHUNK // max(8, len(self.langs)))
        for begin in range(0, len(stream) - ORDER, step):
            key = grams(stream[begin : begin + step + ORDER])
            doc = np.searchsorted(starts, np.arange(begin, begin + len(key)), side="right") - 1
            inside = np.arange(begin, begin + len(key)) - starts[doc] < lengths[doc]
            key, doc = key[inside], doc[inside]
            if not len(key):
                continue
            distinct, at = np.unique(key, return_inverse=True)
            log_p = self.log_p(distinct)[at]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[head]] += np.add.reduceat(log_p, head, dtype=np.float64)
        return total

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t is not None]
        if at and self.langs:
            raw = [texts[i].encode("utf-8", "replace") for i in at]
            code = self.code(raw)
            best = code.argmax(axis=1)
            lengths = np.maximum(1, np.fromiter(map(len, raw), np.int64, len(raw)))
            ahead = (code - code.max(axis=1, keepdims=True)) * np.minimum(1.0, SCORE_BYTES / lengths)[:, None]
            share = 1.0 / np.exp(ahead).sum(axis=1)
            for j, i in enumerate(at):
                names[i], scores[i] = self.langs[best[j]], share[j]
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
        for lang in sorted(set(langs)):
            stream, lengths = padded([t.encode("utf-8", "replace") for t, x in zip(texts, langs) if x == lang])
            inside = np.zeros(len(stream), bool)
            ends = np.cumsum(lengths + ORDER)
            for end, length in zip(ends, lengths):
                inside[end - length : end] = True
            keys, n = np.unique(grams(stream)[inside[ORDER:]], return_counts=True)
            give_back()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "key": keys, "n": n.astype(np.int64)})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Learn the trees from rows with a language and a text.

    Of each language, rows whose hash falls below sample_bytes / (its bytes) are used, whole, and the row with the lowest
    hash in any case. All their grams are kept. Without any row there is no language, and every text is predicted ``und``.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1) / F.lit(2.0**63)).alias("at"),
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("at").alias("least")).collect()
    if not sizes:
        return Trees([], np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
    bound = rows.sparkSession.createDataFrame(
        [(r["lang"], max(r["least"], sample_bytes / max(1, r["bytes"]))) for r in sizes], "lang string, upto double"
    )
    # One row per language: small by the nature of the label.
    chosen = rows.join(F.broadcast(bound), "lang").where(F.col("at") <= F.col("upto")).select("lang", "text")
    counted = chosen.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in sizes)
    numbers = rows.sparkSession.createDataFrame(list(enumerate(langs)), "which int, lang string")
    model = counted.join(F.broadcast(numbers), "lang").select("which", "key", "n").toArrow()  # the grams of the bounded sample
    which = model["which"].to_numpy().astype(np.int64)
    return Trees(langs, which, model["key"].to_numpy(), model["n"].to_numpy().astype(float))


def predict(spark: SparkSession, trees: Trees, text: Column) -> Column:
    """struct<lang, score> of a text: (``und``, 0) for a null text or one without a letter.

    Score: the language's share of the probability after at most ``SCORE_BYTES`` bytes' worth of evidence; ties go to the
    name that sorts first. The whole text is read.
    """
    shared = spark.sparkContext.broadcast(trees)  # the grams of about SAMPLE_BYTES per language

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for begin in range(0, len(texts), SLICE):
                part = shared.value.classify(texts.slice(begin, SLICE).to_pylist())
                names += part[0]
                scores.append(part[1])
            both = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.StructArray.from_arrays(both, names=["lang", "score"])
        give_back()

    return F.arrow_udf(classify, "struct<lang: string, score: double>")(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score. Learns from rows whose id fold is not held out.

    Null text and text without a letter give ``und``; an empty table gives an empty result; repeated rows repeat.
    """
    mod, rest = hold_out
    held = fold(id_col, mod) == rest
    trees = fit(docs.where(~held), id_col, text_col, lang_col)
    found = predict(docs.sparkSession, trees, F.col(text_col))
    return docs.select(F.col(id_col), held.alias("held_out"), found.alias("found")).select(
        id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which a language is found, with all their columns; the rest have no letter at all."""
    trees = fit(docs.where(fold(id_col, 4) != 2), id_col, text_col, lang_col)
    name = free_name(docs, "_language")
    marked = docs.withColumn(name, predict(docs.sparkSession, trees, F.col(text_col)))
    return marked.where(F.col(name)["lang"] != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
