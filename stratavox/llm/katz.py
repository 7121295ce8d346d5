"""Language-model scores by Katz backoff over word n-grams of any order.

Counts are kept in hash buckets, each a part of one order's n-gram table, and blocks of documents exchange arrays with them:

* n-grams of each order leave a block with their training counts and come back with those of the corpus;
* Good-Turing discounts follow from the counts of counts, one small row per bucket, summed by Spark for each order;
* what a history's seen n-grams take, and the lower-order probability of what follows them, is summed by history, each
  n-gram once, by the block that owns it, for histories that held-out texts have; blocks ask for the histories of n-grams they have not seen.

P(w | h) = d(c) c(h, w) / c(h) for a seen n-gram, else bow(h) P(w | h without its first word), down to P(w) = d(c) c(w) / N or
the mass left for unknown words. bow(h) makes each history's probabilities sum to one over the vocabulary and the class of
unknown words; a history never seen passes its words on unweighted. The end of the document before stands in front of a first
word; no history reaches farther back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.blocks import SENT, Block, bucket_count, make_blocks, meet, mix, opened, pack_arrays, sent_rows, settle, unpack_arrays
from stratavox.llm.common import discard, give_back, stored, table
from stratavox.llm.registry import query

BLOCK_BYTES = 8 << 20
STEP = 1 << 18
ORDER = 3
#: Counts up to this are discounted by Good-Turing; of larger ones ``TAIL`` of one count is set aside.
GOOD_TURING = 5
TAIL = 0.1
END = np.uint64(0x5851F42D4C957F2D)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Tokens of a block: words, then one end per document; the end also stands before a document's first word."""

    def __init__(self, block: Block, mod: int, rest: int):
        codes, names, first = block.words()
        size = np.diff(first)
        self.names = np.append(mix(names), END)
        self.word = np.insert(codes.astype(np.int32), first[1:], len(names))
        self.before = np.concatenate([np.array([len(names)], np.int32), self.word[:-1]])
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        self.place = np.arange(len(self.word), dtype=np.int32) - np.repeat((first[:-1] + np.arange(len(size))).astype(np.int32), size + 1)
        folds = [zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in block.ids.to_pylist()]
        self.held = np.array(folds, np.int64) == rest
        self.train = ~self.held[self.doc]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams in ascending order of their hashes, a token that ends each, and each token's n-gram (-1: none).

        A token has one if it stands at least ``order`` - 2 words behind the first.
        """
        if order == 1:
            by = np.argsort(self.names)
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by), dtype=np.int32)
            some = np.zeros(len(by), np.int64)
            some[self.word] = np.arange(len(self.word))
            return self.names[by], some[by], rank[self.word]
        key = self.names[self.before]
        for length in range(2, order + 1):
            if length > 2:
                key = np.concatenate([key[:1], key[:-1]])
            for begin in range(0, len(key), STEP):
                part = slice(begin, begin + STEP)
                key[part] = mix(key[part] * ODD + mix(self.names[self.word[part]] + ODD))
        whole = np.flatnonzero(self.place >= order - 2)
        key = key[whole]
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        at = np.full(len(self.word), -1, np.int32)
        at[whole] = of
        return keys, whole[first], at


def _emit(blocks: DataFrame, orders: tuple[int, ...], buckets: int, mod: int, rest: int) -> DataFrame:
    """Every block's n-grams of some orders with twice their training counts, plus one if a held-out text has them; order n has the buckets from (n - 1) ``buckets`` on."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = Tokens(opened(batch, i), mod, rest)
                for n in orders:
                    keys, _, at = own.grams(n)
                    counts = np.bincount(at[own.train & (at >= 0)], minlength=len(keys)).astype(np.uint32) << np.uint32(1)
                    counts[at[~own.train & (at >= 0)]] |= np.uint32(1)
                    rows = sent_rows(batch["gid"][i].as_py(), keys, lambda p: [keys[p], counts[p]], buckets)  # noqa: B023
                    yield rows.set_column(0, "bucket", pc.add(rows["bucket"], pa.scalar((n - 1) * buckets, pa.int32())))
                del own, keys, at, counts, rows
                give_back()

    return blocks.mapInArrow(run, SENT)


def _totals(got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in got])
    counts = np.concatenate([c for _, c in got])
    distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return first, at, np.bincount(at, weights=counts >> 1, minlength=len(distinct)).astype(np.uint64)


def _count(got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """The corpus count of each n-gram, and flags: 1 for the one block that owns it, 2 if a held-out text has it."""
    first, at, total = _totals(got)
    held = np.concatenate([c for _, c in got]) & 1 == 1
    asked = np.zeros(len(total), np.uint8)
    asked[at[held]] = 2
    flags = asked[at]
    flags[first] |= 1
    ends = np.cumsum([len(k) for k, _ in got])[:-1]
    return [list(x) for x in zip(np.split(total[at], ends), np.split(flags, ends))]


def _tally(got: list[list[np.ndarray]]) -> np.ndarray:
    """Tokens, types, and how many types have each count up to GOOD_TURING + 1."""
    total = _totals(got)[2]
    seen = total[total > 0]
    return np.array([seen.sum(), len(seen), *[np.count_nonzero(seen == r) for r in range(1, GOOD_TURING + 2)]], np.int64)


def _sums(answers: DataFrame, orders: tuple[int, ...], buckets: int) -> list[list[int]]:
    """Each order's sum of the tallies over its buckets; one row of a few numbers per order reaches the driver."""

    def numbers(batches):
        for batch in batches:
            rows = [unpack_arrays(body)[0].tolist() for body in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"bucket": batch["bucket"], "tally": pa.array(rows, pa.list_(pa.int64()))})

    got = answers.where("gid is null").select("bucket", "body").mapInArrow(numbers, "bucket int, tally array<long>")
    by_order = got.groupBy(F.floor(F.col("bucket") / buckets).cast("int").alias("n"))
    totals = {r[0]: list(r[1:]) for r in by_order.agg(*[F.sum(F.col("tally")[k]) for k in range(GOOD_TURING + 3)]).collect()}
    return [totals.get(n - 1, [0] * (GOOD_TURING + 3)) for n in orders]


def discounts(of: list[int]) -> np.ndarray:
    """Share of a count that is kept, for counts 0 to GOOD_TURING; ``of``: number of types by count, from 1 on.

    Katz's form of Good-Turing; where the counts of counts are too thin for it, absolute discounting.
    """
    n = [0, *of]
    k = GOOD_TURING
    drop = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    far = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - far) / (1 - far) if n[r] and far < 1 else 0.0
        out[r] = turing if 0 < turing < 1 else (r - drop) / r
    return out


def kept(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    counts = counts.astype(np.float64)
    small = counts <= GOOD_TURING
    return np.where(small, counts * discount[np.where(small, counts, 0).astype(int)], counts - TAIL)


def score_katz(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold_out: tuple[int, int] = (7, 2), order: int = ORDER
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from ids whose fold is not held out. base_score is the add-one unigram score, score the Katz model's with histories of up to
    ``order`` - 1 words. Null and empty texts are a single end token; repeated rows count each; a null id is a training row.
    With no training row every token is unknown and has probability 1. An empty table gives an empty result.
    """
    if order < 2:
        raise ValueError("a backoff model has an order of 2 or more")
    mod, rest = hold_out
    blocks = make_blocks(docs, id_col, text_col, BLOCK_BYTES)
    buckets = bucket_count(docs, text_col, 1.0)
    # Words and pairs are few enough to share an exchange; its files go before the next one.
    turns = [(1, 2), *((n,) for n in range(3, order + 1))]
    grams = [stored(settle(_emit(blocks, orders, buckets, mod, rest), _count, _tally), release=True) for orders in turns]
    (tokens, types, *of_words), *longer = [of for answers, orders in zip(grams, turns) for of in _sums(answers, orders, buckets)]
    discount = [discounts(of_words), *[discounts(of[2:]) for of in longer]]
    # What the discounts leave of the unigrams: the count of small types is known exactly, all others lose TAIL.
    small = sum(of_words[:GOOD_TURING])
    lost = sum(n * r * (1 - discount[0][r]) for r, n in enumerate(of_words[:GOOD_TURING], 1)) + (types - small) * TAIL
    unknown = lost / tokens if tokens else 1.0

    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("gid", T.LongType()),
            T.StructField("body", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )

    def evaluate(block: Block, answers: list[list[np.ndarray] | None]) -> pa.Table:
        """Everything but the backoff weights: a row per bucket with sums and questions by history, and the block's row."""
        own = Tokens(block, mod, rest)
        counts, flags = (np.concatenate(x) for x in zip(*[a for a in answers if a is not None]))
        answers.clear()
        docs_n, size, begin = len(own.held), len(own.word), 0
        add = lambda values: np.bincount(own.doc, weights=values, minlength=docs_n)
        # By token: the history's hash and count, whether it may be asked for, and the direct probability of the order below (0: not seen).
        history = count = direct = wanted = None
        levels, told = [], []
        for n in range(1, order + 1):
            keys, token, at = own.grams(n)
            total = counts[begin : begin + len(keys)].astype(np.float64)
            flag = np.append(flags[begin : begin + len(keys)], np.uint8(0))
            begin += len(keys)
            keys, total = np.append(keys, END), np.append(total, 0.0)  # the last place answers for no n-gram (-1)
            held, seen = kept(total, discount[n - 1]), total > 0
            if n == 1:
                known = total[at]
                p_word = np.where(seen, held / max(tokens, 1), unknown)[at]
                level = p_word
                end = np.searchsorted(keys[:-1], END)
                before = np.concatenate([[end], at[:-1]])
            else:
                level = np.where(seen[at], held[at] / np.maximum(count, 1), 0.0)
                # Only held-out texts have n-grams that were never seen, so only their histories are asked for.
                mine = np.flatnonzero((flag[:-1] & 1 == 1) & (total[:-1] > 0) & wanted[token])
                spoken, of = np.unique(history[token[mine]], return_inverse=True)
                told.append((spoken, np.bincount(of, held[mine], len(spoken)), np.bincount(of, direct[token[mine]], len(spoken))))
                levels.append((level, np.where(at >= 0, count, 0.0), history))
                before = np.concatenate([[-1], at[:-1]])
                before[own.place < n - 1] = -1
            history, count, wanted = keys[before], total[before], flag[before] & 2 == 2
            direct = level
        part, open_, asked, of_doc = np.zeros(size), np.ones(size, bool), [], []
        for level, count, history in reversed(levels):
            hit = open_ & (level > 0)
            part[hit] = np.log10(level[hit])
            open_ &= ~hit
            far = np.flatnonzero(open_ & (count > 0))  # tokens that lack a backoff weight of this order
            names, first, of = np.unique(history[far], return_index=True, return_inverse=True)
            asked.append((names, count[far][first], of))
            of_doc.append(own.doc[far])
        part[open_] = np.log10(p_word[open_])
        place, listed, shift = [], [], 0
        for names, _, of in asked:
            place.append(of + shift)
            shift += len(names)
        names = np.concatenate([a[0] for a in asked])
        listed = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[listed] = np.arange(len(names))
        spoken = np.concatenate([t[0] for t in told])
        said = np.argsort(spoken)
        none = lambda n: pa.nulls(n, pa.list_(block.ids.type))
        out = []
        for chosen, arrays in (
            (spoken[said], [np.concatenate([t[k] for t in told])[said] for k in (1, 2)]),
            (names[listed], [np.concatenate([a[1] for a in asked])[listed]]),
        ):
            rows = sent_rows(block.gid, chosen, lambda p: [chosen[p], *[x[p] for x in arrays]], buckets)
            out.append(pa.Table.from_batches([rows]).append_column("ids", none(rows.num_rows)))
        base = np.log10((known + 1) / (tokens + types + 1))
        body = pack_arrays(
            [
                own.held.astype(np.uint8),
                np.bincount(own.doc, minlength=docs_n),
                add(known > 0).astype(np.int64),
                add(base),
                add(part),
                np.concatenate(of_doc).astype(np.int32),
                rank[np.concatenate(place)].astype(np.int32),
            ]
        )
        whole = pa.table(
            {
                "bucket": pa.array([None], pa.int32()),
                "gid": pa.array([block.gid], pa.int64()),
                "body": pa.array([body], pa.binary()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(block.ids)], pa.int32()), block.ids),
            }
        )
        return pa.concat_tables([*out, whole])

    results = stored(meet(blocks, [a.where("gid is not null") for a in grams], evaluate, schema), release=True)
    for done in (blocks, *grams):  # scores need only the results from here on
        discard(done)

    def weights(group: pa.Table) -> pa.Table:
        """log10 of the backoff weight of each history asked for."""
        bodies = [unpack_arrays(x) for x in group["body"].to_pylist()]
        told = [b for b in bodies if len(b) == 3]
        asked = [(g, b) for g, b in zip(group["gid"].to_pylist(), bodies) if len(b) == 2]
        names, at = np.unique(np.concatenate([b[0] for b in told] or [np.zeros(0, np.uint64)]), return_inverse=True)
        taken = np.bincount(at, weights=np.concatenate([b[1] for b in told] or [[]]), minlength=len(names))
        after = np.bincount(at, weights=np.concatenate([b[2] for b in told] or [[]]), minlength=len(names))
        back = []
        for _, (keys, count) in asked:
            place = np.searchsorted(names, keys)  # every history with a count has been told of
            back.append(pack_arrays([np.log10((1 - taken[place] / count) / np.maximum(1 - after[place], 1e-12))]))
        bucket = group["bucket"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array([bucket] * len(asked), pa.int32()),
                "gid": pa.array([g for g, _ in asked], pa.int64()),
                "body": pa.array(back, pa.binary()),
            }
        )

    backoff = results.where("bucket is not null").select("bucket", "gid", "body").groupBy("bucket").applyInArrow(weights, SENT)
    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    final = T.StructType([T.StructField("id", id_type), *[T.StructField(n, k) for n, k in fields]])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held, n_tokens, n_known, base, part, doc, place = unpack_arrays(left["body"][0].as_py())
        if len(doc):
            right = right.sort_by("bucket")
            weight = np.concatenate([unpack_arrays(x)[0] for x in right["body"].to_pylist()])
            part = part + np.bincount(doc, weights=weight[place], minlength=len(part))
        return pa.table(
            {
                "id": left["ids"].chunk(0).values,
                "held_out": pa.array(held == 1),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(part, pa.float64()),
            }
        )

    whole = results.where("bucket is null").select("gid", "ids", "body")
    scored = whole.groupBy("gid").cogroup(backoff.groupBy("gid")).applyInArrow(finish, final)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op5_katz_score")
def op5_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_katz(table(spark, sf_dir, "documents"))
