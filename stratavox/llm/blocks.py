"""Blocks of documents and the exchange between blocks and hash buckets.

Operators that look at every word, shingle or byte of the corpus would shuffle a row for each. Here a row holds a block of
whole documents (about ``BLOCK_BYTES`` of text, compressed), a task works on its arrays, and what has to meet across blocks
travels as sorted arrays of 64-bit hashes:

* ``send``:  block -> (bucket, block, array), each hash once per block, so that frequent keys are already aggregated;
* ``settle``: all arrays of a bucket meet in one group and every block gets an answer per hash it sent;
* ``meet``:  block and answers come together again.

A bucket is a range of hash values, and buckets grow in number with the text, so a group stays a few MB. A hash occurs at
most once per block in a bucket, whatever share of the rows holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.common import give_back, stored, total_bytes

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
FEWEST_BUCKETS = 32

SENT = "bucket int, gid long, body binary"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def squeeze(array: np.ndarray) -> bytes:
    """Compressed bytes, equal places of the items together: the high bytes of sorted hashes then take next to nothing."""
    flat = np.ascontiguousarray(array)
    planes = flat.view(np.uint8).reshape(len(flat), flat.dtype.itemsize).T if len(flat) else flat
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unsqueeze(body: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (SplitMix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Whole documents: ids, their lengths in bytes, and all bytes with one line feed after each document."""

    gid: int
    ids: pa.Array
    lengths: np.ndarray
    raw: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths + 1) - self.lengths - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number per word, hash per distinct word, and where each document's words begin (one more entry at the end).

        Words are runs of anything but the six white-space characters, A-Z in lower case.
        """
        low = np.frombuffer(self.raw.lower(), np.uint8)
        solid = ~_SPACE[low]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
        begin, end = edge[::2], edge[1::2]
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])]
        coded = pa.Array.from_buffers(pa.binary(), len(begin), buffers).dictionary_encode()
        names = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        first = np.append(np.searchsorted(begin, self.starts), len(begin))
        return coded.indices.to_numpy(), hashes, first


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """gid, ids, lengths, body: the documents as they lie in the input partitions; null text counts as empty. Stored."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        packer = zstandard.ZstdCompressor(3)

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            raw = b"\n".join(texts) + b"\n"
            lengths = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            names = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, arrow_id))
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), names, lengths, pa.array([packer.compress(raw)], pa.binary())],
                ["gid", "ids", "lengths", "body"],
            )
            number, held = number + 1, 0
            ids.clear()
            texts.clear()
            return row

        for batch in batches:
            arrow_id = batch["id"].type
            for name, text in zip(batch["id"].to_pylist(), batch["text"]):
                raw = text.as_py().encode("utf-8", "replace")
                if texts and held + len(raw) > block_bytes:
                    yield flush()
                ids.append(name)
                texts.append(raw)
                held += len(raw) + 1
        if texts:
            yield flush()
        give_back()

    schema = T.StructType(
        [
            T.StructField("gid", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("body", T.BinaryType()),
        ]
    )
    return stored(rows.mapInArrow(fold, schema))


def opened(table: pa.Table | pa.RecordBatch, i: int = 0) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(table["body"][i].as_py())
    lengths = np.array(table["lengths"][i].as_py(), np.int64)
    return Block(table["gid"][i].as_py(), table["ids"][i].values, lengths, raw)


def bucket_count(docs: DataFrame, text_col: str, bytes_per_byte: float) -> int:
    """Buckets for arrays that take ``bytes_per_byte`` bytes per byte of text."""
    return max(FEWEST_BUCKETS, int(total_bytes(docs, text_col) * bytes_per_byte / BUCKET_BYTES))


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in a sorted array of hashes (one more entry at the end)."""
    bounds = (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]])


def as_rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def send(blocks: DataFrame, emit: Callable[[Block], tuple[np.ndarray, list[np.ndarray]]], buckets: int) -> DataFrame:
    """``emit``: sorted distinct hashes of a block and arrays beside them. One row per block and non-empty bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = opened(batch, i)
                keys, beside = emit(block)
                yield sent_rows(block.gid, keys, lambda part: [keys[part], *[x[part] for x in beside]], buckets)
                del block, keys, beside
                give_back()

    return blocks.mapInArrow(run, SENT)


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of any type in one value, each compressed."""
    parts = [squeeze(a) for a in arrays]
    head = ",".join(f"{a.dtype.str}:{len(p)}" for a, p in zip(arrays, parts)).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(parts)


def unpack_arrays(body: bytes) -> list[np.ndarray]:
    size = int.from_bytes(body[:4], "little")
    at, out = 4 + size, []
    for item in body[4 : 4 + size].decode().split(","):
        dtype, n = item.rsplit(":", 1)
        out.append(unsqueeze(body[at : at + int(n)], dtype))
        at += int(n)
    return out


def settle(
    sent: DataFrame,
    answer: Callable[[list[list[np.ndarray]]], list[list[np.ndarray]]],
    tally: Callable[[list[list[np.ndarray]]], np.ndarray] | None = None,
) -> DataFrame:
    """Per bucket, ``answer`` turns what each block sent into what each block gets back (gid, bucket, body).

    ``tally`` adds a row per bucket without a block: an array of what is to be summed over all buckets.
    """

    def run(group: pa.Table) -> pa.Table:
        got = [unpack_arrays(x) for x in group["body"].to_pylist()]
        back = [pack_arrays(x) for x in answer(got)]
        totals = [pack_arrays([tally(got)])] if tally is not None else []
        del got
        give_back()
        buckets, gids = group["bucket"].to_pylist(), group["gid"].to_pylist()
        if tally is not None:
            back += totals
            buckets, gids = [*buckets, buckets[0]], [*gids, None]
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "gid": pa.array(gids, pa.int64()), "body": pa.array(back, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, SENT)


def meet(blocks: DataFrame, answers: list[DataFrame], work: Callable[[Block, list[list[np.ndarray] | None]], pa.Table], schema) -> DataFrame:
    """Each block with its answers of every exchange, in the order of the hashes it sent (None where it sent none)."""
    labelled = [a.select("gid", F.lit(k).alias("kind"), "bucket", "body") for k, a in enumerate(answers)]
    together, exchanges = labelled[0], len(answers)
    for more in labelled[1:]:
        together = together.unionByName(more)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        got = [None] * exchanges
        kinds, bodies = right["kind"].to_pylist(), right["body"].to_pylist()
        for k in set(kinds):
            parts = [unpack_arrays(body) for kind, body in zip(kinds, bodies) if kind == k]
            got[k] = [np.concatenate(x) for x in zip(*parts)]
            del parts
        del bodies, right
        out = work(opened(left), got)
        give_back()
        return out

    return blocks.groupBy("gid").cogroup(together.groupBy("gid")).applyInArrow(run, schema)


def sent_rows(gid: int, keys: np.ndarray, arrays: Callable[[slice], list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Rows for an exchange: for each bucket that has keys, what ``arrays`` gives for their places."""
    edges = bucket_edges(keys, buckets)
    rows = [(b, gid, pack_arrays(arrays(slice(edges[b], edges[b + 1])))) for b in np.flatnonzero(np.diff(edges)).tolist()]
    return as_rows(rows, ["bucket", "gid", "body"], [pa.int32(), pa.int64(), pa.binary()])
