"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers parse each text into overlapping phrases: the trigger of a window of ``length`` bytes is its
``CORE`` bytes of least hash, and a phrase is the span of all windows that share a trigger. Triggers depend on content
only, so equal windows have equal triggers at equal places, every window lies in exactly one phrase, and a repeated string is
found by looking at phrases with the same trigger. Two exchanges between blocks of documents and hash buckets do that:

* the parse: the trigger hashes of each block; a trigger that one document of the corpus has cannot repeat a window;
* the dictionary: distinct phrases of the remaining triggers, each once per block with its smallest document id. In a
  bucket, the suffixes of the phrases that start a window are put in the order of a hash of their first ``length`` bytes,
  neighbours are compared in full, and the smallest document id of each run goes back as a bit per window;
* triggers with more than ``CROWD`` phrases (one string with ever new surroundings) send their windows instead, each once per
  block, to buckets by the hash of the window itself. Equal windows meet there too, and no bucket holds a whole trigger.

Only runs of equal windows are needed, so the dictionary's suffixes are ordered by hash instead of by content, and
no suffix longer than a window is compared. Memory per task is a block or a bucket; a phrase that a third of all documents
share travels once per block, and so does a window of a crowded trigger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.blocks import SENT, Block, bucket_count, make_blocks, meet, mix, send, sent_rows, settle
from stratavox.llm.common import table
from stratavox.llm.registry import query

LENGTH = 50
CORE = 16
BLOCK_BYTES = 4 << 20
PLACE_BITS = 23
STEP = 1 << 18
#: Distinct phrases of a trigger, summed over the blocks, beyond which its windows are dealt out by themselves.
CROWD = 2_000
LAST_ID = np.iinfo(np.int64).max


def words_at(raw: bytes) -> np.ndarray:
    """The eight bytes from every place of ``raw`` on, as integers, without copying (the last seven places are missing)."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))


def triggers(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the CORE bytes from every place on, and for every place the trigger of the window that starts there.

    ``span``: places of a core inside a window. The least hash wins, the leftmost of equal ones.
    """
    eight = words_at(raw)
    n = len(raw) - CORE + 1
    hashes, value = np.empty(n, np.uint64), np.empty(n, np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, n, STEP):
        end = min(begin + STEP, n)
        hashes[begin:end] = mix(eight[begin:end] ^ mix(eight[begin + 8 : end + 8] + np.uint64(0x9E3779B97F4A7C15)))
        value[begin:end] = (hashes[begin:end] & ~low) | np.arange(begin, end, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if width < span:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    return hashes, (value & low).astype(np.int32)


class Parse:
    """Phrases of a block: trigger place and hash, first and last window start, number of the document."""

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        lengths = block.lengths
        self.ids = np.array([LAST_ID if x is None else x for x in block.ids.to_pylist()], np.int64)
        windows = np.maximum(lengths - length + 1, 0)
        if len(block.raw) >= 1 << PLACE_BITS:
            self.at = self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.core = np.zeros(0, np.uint64)
            parts = [self._piece(d) for d in range(len(lengths)) if windows[d]]
            if parts:
                self.at, self.first, self.last, self.doc, self.core = (np.concatenate(x) for x in zip(*parts))
            return
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), windows)
        start = np.arange(len(doc), dtype=np.int32)
        start += np.repeat((block.starts - np.cumsum(windows) + windows).astype(np.int32), windows)
        self.at, self.first, self.last, self.doc, self.core = self._phrases(block.raw, 0, start, doc)

    def _phrases(self, raw: bytes, base: int, start: np.ndarray, doc: np.ndarray):
        if not len(start):
            return start, start, start, doc, np.zeros(0, np.uint64)
        hashes, place = triggers(raw, self.length - CORE + 1)
        at = place[start - base]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        end = np.append(new[1:], len(start)) - 1
        core = mix(hashes[at[new]])  # triggers are least hashes: mixed again, they fill the buckets evenly
        return at[new].astype(np.int64) + base, start[new].astype(np.int64), start[end].astype(np.int64), doc[new].astype(np.int64), core

    def _piece(self, d: int):
        """A document longer than a block's places: in stretches that overlap by a window."""
        begin, n = int(self.block.starts[d]), int(self.block.lengths[d])
        reach = (1 << PLACE_BITS) - self.length
        found = []
        for a in range(0, n - self.length + 1, reach):
            b = min(a + reach, n - self.length + 1)
            raw = self.block.raw[begin + a : begin + b + self.length - 1]
            start = np.arange(begin + a, begin + b)
            found.append(self._phrases(raw, begin + a, start, np.full(len(start), d, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def cores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct trigger hashes, whether several documents of the block have them, and their distinct phrases."""
        by = np.argsort(self.core, kind="stable")
        key, doc = self.core[by], self.doc[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        if not len(new):
            return key, np.zeros(0, np.uint8), np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
        count = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), count)
        again = np.repeat(count > 1, count)
        group, whole = group[again], self.phrase_hash(by[again])
        order = np.lexsort((whole, group))
        group, whole = group[order], whole[order]
        if len(group):
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (whole[1:] != whole[:-1])])
            found = np.bincount(group[fresh], minlength=len(new))
            count = np.where(count > 1, found, 1)
        return key[new], several.astype(np.uint8), count.astype(np.int64)

    def phrase_hash(self, hit: np.ndarray) -> np.ndarray:
        left = (self.at[hit] - self.first[hit]).astype(np.uint8)
        extent = (self.last[hit] - self.first[hit]).astype(np.uint8)
        return window_hash(self.block.raw, self.first[hit], self.length) ^ mix(
            window_hash(self.block.raw, self.last[hit], self.length) + (left.astype(np.uint64) << np.uint64(8)) + extent
        )

    def windows(self, crowded: np.ndarray | None):
        """Windows of crowded triggers; distinct ones in the order of their hash.

        start, id: of every window; entry: number of the distinct window of each; own, least, begin of the distinct ones.
        """
        if crowded is None or not crowded.any():
            return None
        known = np.unique(self.core)
        hit = np.flatnonzero(crowded[np.searchsorted(known, self.core)])
        count = self.last[hit] - self.first[hit] + 1
        start = _spread(self.first[hit], count)
        doc_id = np.repeat(self.ids[self.doc[hit]], count)
        own = window_hash(self.block.raw, start, self.length)
        by = np.lexsort((doc_id, own))
        ordered = own[by]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        one = by[new]
        return start, doc_id, entry, own[one], doc_id[one], start[one]

    def dictionary(self, repeated: np.ndarray | None):
        """Phrases whose trigger repeats; distinct ones in the order of their trigger.

        hit: their numbers; entry: number of the distinct phrase of each; core, left, extent, id, begin of the distinct ones.
        """
        if repeated is None or not repeated.any():
            return None
        known = np.unique(self.core)
        hit = np.flatnonzero(repeated[np.searchsorted(known, self.core)])
        left = (self.at[hit] - self.first[hit]).astype(np.uint8)
        extent = (self.last[hit] - self.first[hit]).astype(np.uint8)
        whole = self.phrase_hash(hit)
        doc_id = self.ids[self.doc[hit]]
        by = np.lexsort((doc_id, whole, self.core[hit]))
        core, own = self.core[hit][by], whole[by]
        new = np.concatenate([[True], (core[1:] != core[:-1]) | (own[1:] != own[:-1])])
        entry = np.empty(len(hit), np.int64)
        entry[by] = np.cumsum(new) - 1
        one = by[new]
        return hit, entry, self.core[hit][one], left[one], extent[one], doc_id[one], self.first[hit][one]


def window_hash(raw: bytes, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on."""
    eight = words_at(raw)
    out = np.full(len(start), length, np.uint64)
    for k in [*range(0, length - 7, 8), length - 8]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + eight[start + k])
    return out


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (count of them) of each, end to end."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _earliest(length: int):
    """Bucket work of the dictionary: per phrase a bit for each window that a smaller document has too.

    Buckets of single windows answer 1 for each that a smaller document has too.
    """

    def single(got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        own, doc = (np.concatenate([g[k] for g in got]) for k in range(2))
        raw = np.concatenate([g[2] for g in got]).reshape(-1, length)
        by = np.lexsort((doc, own))
        same = own[by[1:]] == own[by[:-1]]
        pair = np.flatnonzero(same)
        same[pair] = (raw[by[pair + 1]] == raw[by[pair]]).all(axis=1)
        head = np.concatenate([[True], ~same])
        later = np.zeros(len(own), np.uint64)
        later[by] = doc[by][head][np.cumsum(head) - 1] < doc[by]
        return [[x] for x in np.split(later, np.cumsum([len(g[0]) for g in got])[:-1])]

    def answer(got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        if len(got[0]) == 3:
            return single(got)
        core, extent, doc = (np.concatenate([g[k] for g in got]) for k in range(3))
        raw = np.concatenate([g[3] for g in got]).tobytes()
        size = extent.astype(np.int64) + length
        begin = np.cumsum(size) - size
        windows = extent.astype(np.int64) + 1
        of = np.repeat(np.arange(len(core), dtype=np.int32), windows)
        at = _spread(begin, windows).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        own = window_hash(raw, at, length)
        by = np.lexsort((doc[of], own))
        own, owner, place = own[by], of[by], at[by]
        eight = words_at(raw)
        same = (own[1:] == own[:-1]) & (core[owner[1:]] == core[owner[:-1]])
        for k in [*range(0, length - 7, 8), length - 8]:
            pair = np.flatnonzero(same)
            same[pair] = eight[place[pair + 1] + k] == eight[place[pair] + k]
        head = np.concatenate([[True], ~same])
        least = doc[owner][head][np.cumsum(head) - 1]
        later = least < doc[owner]
        bit = (place.astype(np.int64) - begin[owner]).astype(np.uint64)
        mask = np.zeros(len(core), np.uint64)
        np.bitwise_or.at(mask, owner[later], np.uint64(1) << bit[later])
        return [[x] for x in np.split(mask, np.cumsum([len(g[0]) for g in got])[:-1])]

    return answer


def _repeated(crowd: int, got: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """1 for each trigger that more than one document has, 2 if more than ``CROWD`` phrases have it."""
    keys, flags, phrases = (np.concatenate([g[k] for g in got]) for k in range(3))
    distinct, at = np.unique(keys, return_inverse=True)
    many = (np.bincount(at, minlength=len(distinct)) > 1) | (np.bincount(at, weights=flags, minlength=len(distinct)) > 0)
    crowded = many & (np.bincount(at, weights=phrases, minlength=len(distinct)) > crowd)
    kind = many.astype(np.uint8) + crowded
    return [[x] for x in np.split(kind[at], np.cumsum([len(g[0]) for g in got])[:-1])]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (start, length of each removed run of bytes), kept (bytes).

    A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller id. Ids are integers;
    null ids rank last and never before each other, like rows that share an id. Null text counts as empty; texts shorter
    than ``length`` lose nothing; an empty table gives an empty result. ``length`` lies between CORE + 8 and CORE + 63.
    """
    if not CORE + 8 <= length <= CORE + 63:
        raise ValueError(f"length must lie between {CORE + 8} and {CORE + 63}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = make_blocks(rows, "id", "text", BLOCK_BYTES)
    buckets = bucket_count(rows, "text", 4.0)  # a bucket's windows take several times the bytes of its phrases
    crowd = CROWD
    parse = settle(send(blocks, lambda block: (lambda c: (c[0], [*c[1:]]))(Parse(block, length).cores()), buckets), lambda got: _repeated(crowd, got))

    def parts(block: Block, answers: list[list[np.ndarray] | None]):
        """The block's parse, its dictionary of phrases and its windows of crowded triggers."""
        parsed, kind = Parse(block, length), answers[0][0] if answers[0] else None
        if kind is None:
            return parsed, None, None
        return parsed, parsed.dictionary(kind == 1), parsed.windows(kind == 2)

    def phrases(block: Block, answers: list[list[np.ndarray] | None]) -> pa.Table:
        _, found, single = parts(block, answers)
        raw = np.frombuffer(block.raw, np.uint8)
        out = [pa.RecordBatch.from_pydict({"bucket": pa.array([], pa.int32()), "gid": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})]
        if found is not None:
            _, _, core, _, extent, doc, begin = found

            def arrays(part: slice) -> list[np.ndarray]:
                places = _spread(begin[part], extent[part].astype(np.int64) + length)
                return [core[part], extent[part], doc[part], raw[places]]

            out.append(sent_rows(block.gid, core, arrays, buckets))
        if single is not None:
            _, _, _, own, least, at = single

            def alone(part: slice) -> list[np.ndarray]:
                return [own[part], least[part], raw[_spread(at[part], np.full(len(at[part]), length))]]

            rows = sent_rows(block.gid, own, alone, buckets)  # behind the buckets of phrases
            numbers = pa.array(rows["bucket"].to_numpy() + np.int32(buckets), pa.int32())
            out.append(pa.RecordBatch.from_arrays([numbers, rows["gid"], rows["body"]], ["bucket", "gid", "body"]))
        return pa.Table.from_batches(out)

    masks = settle(meet(blocks, [parse], phrases, SENT), _earliest(length))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def cut(block: Block, answers: list[list[np.ndarray] | None]) -> pa.Table:
        parsed, found, single = parts(block, answers)
        raw = np.frombuffer(block.raw, np.uint8)
        gone = np.zeros(len(raw) + 1, bool)
        starts = np.zeros(len(raw) + 1, bool)
        phrases_sent = 0
        if found is not None:
            hit, entry, _, _, extent, doc, _ = found
            phrases_sent = len(extent)
            every = (np.uint64(2) << extent.astype(np.uint64)) - np.uint64(1)
            own = np.where(parsed.ids[parsed.doc[hit]] > doc[entry], every[entry], answers[1][0][entry])
            first = parsed.first[hit]
            for w in range(length - CORE + 1):
                starts[first[(own >> np.uint64(w)) & np.uint64(1) == 1] + w] = True
        if single is not None:
            begin, doc_id, entry, _, least, _ = single
            starts[begin[(doc_id > least[entry]) | (answers[1][0][phrases_sent:][entry] == 1)]] = True
        if found is not None or single is not None:
            begun = np.cumsum(starts, dtype=np.int32)
            gone = begun > 0
            gone[length:] = begun[length:] > begun[:-length]
        removed, spans, kept = [], [], []
        for begin, n in zip(block.starts.tolist(), block.lengths.tolist()):
            own = gone[begin : begin + n]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
                removed.append(int(np.count_nonzero(own)))
                spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
                kept.append(raw[begin : begin + n][~own].tobytes())
            else:
                removed.append(0)
                spans.append([])
                kept.append(block.raw[begin : begin + n])
        return pa.table(
            {
                "id": block.ids,
                "n_bytes": pa.array(block.lengths, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return meet(blocks, [parse, masks], cut, schema).withColumnRenamed("id", id_col)


@query("op6_remove_repeats")
def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
