"""Packing documents into windows by non-negative least squares.

Documents are tokenised once and cut into whole windows, at most one half window, and a rest shorter than that. Piece
lengths, in cells of ``GRAIN`` tokens, form a histogram of at most window / GRAIN entries. Shallow combinations of lengths
that fill a window are enumerated, non-negative least squares finds how often each should repeat so that together they
use up the histogram, the counts are rounded down, and what is left is packed greedily, largest piece first.

Only the histogram reaches the driver. The result is a short list of rank ranges per length, from which every piece finds
its sequence by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.llm.common import give_back, stored, table
from stratavox.llm.registry import query
from stratavox.llm.tokens import PieceIds

WINDOW = 2048
GRAIN = 4
MOST_PIECES = 8
END_ID = 1
GROUP_CHARS = 1_000_000


def combinations(present: np.ndarray, full: int) -> list[dict[int, int]]:
    """Multisets of at most three distinct lengths and ``MOST_PIECES`` pieces that fill ``full`` cells exactly.

    Three distinct lengths are used once each, two lengths or one any number of times.
    """
    have = set(present.tolist())
    found = {}
    for a in have:
        if full % a == 0 and full // a <= MOST_PIECES:
            found[((a, full // a),)] = None
        for i in range(1, MOST_PIECES):
            for j in range(1, MOST_PIECES + 1 - i):
                b, odd = divmod(full - i * a, j)
                if b > a and not odd and b in have:
                    found[((a, i), (b, j))] = None
        for b in have:
            c = full - a - b
            if a < b < c and c in have:
                found[((a, 1), (b, 1), (c, 1))] = None
    return [dict(x) for x in found]


def nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Lawson-Hanson active set: the non-negative x with the least |matrix x - target|."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0))) * matrix.shape[0]
    for _ in range(3 * matrix.shape[0] + 1):
        gain = matrix.T @ (target - matrix[:, active] @ x[active])
        gain[active] = -np.inf
        best = int(gain.argmax()) if len(gain) else -1
        if best < 0 or gain[best] <= tolerance:
            break
        active.append(best)
        while active:
            own = matrix[:, active]
            try:
                trial = np.linalg.solve(own.T @ own, own.T @ target)
            except np.linalg.LinAlgError:
                trial = np.linalg.lstsq(own, target, rcond=None)[0]
            if trial.min() > 0:
                x[active] = trial
                break
            now = x[active]
            falling = trial <= 0
            step = np.min(now[falling] / np.maximum(now[falling] - trial[falling], 1e-300))
            x[active] = np.maximum(now + step * (trial - now), 0.0)
            gone = [k for k, v in zip(active, x[active]) if v <= 1e-12]
            if not gone:
                gone = [active[int(np.argmin(x[active]))]]
            x[gone] = 0.0
            active = [k for k in active if k not in set(gone)]
    return x


def patterns(counts: dict[int, int], full: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences), using up ``counts`` exactly."""
    left = {cell: n for cell, n in counts.items() if n > 0}
    chosen = [({full: 1}, left.pop(full))] if full in left else []
    present = np.array(sorted(left), int)
    combos = combinations(present, full) if len(present) else []
    if combos:
        row = {cell: i for i, cell in enumerate(present.tolist())}
        matrix = np.zeros((len(present), len(combos)))
        for j, combo in enumerate(combos):
            for cell, times in combo.items():
                matrix[row[cell], j] = times
        repeats = nnls(matrix, np.array([left[c] for c in present.tolist()], float))
        for j in np.argsort(-repeats, kind="stable"):
            n = min(int(repeats[j]), *(left[c] // times for c, times in combos[j].items()))
            if n > 0:
                chosen.append((combos[j], n))
                for cell, times in combos[j].items():
                    left[cell] -= n * times
    order = sorted((c for c, n in left.items() if n > 0), reverse=True)
    while order:
        pattern, room = {}, full
        for cell in order:
            fit = min(room // cell, left[cell])
            if fit:
                pattern[cell] = fit
                room -= fit * cell
            if room < order[-1]:
                break
        n = min(left[c] // times for c, times in pattern.items())
        chosen.append((pattern, n))
        for cell, times in pattern.items():
            left[cell] -= n * times
        order = [c for c in order if left[c] > 0]
    return chosen


def ranges(chosen: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, rank after the last, first sequence, pieces per sequence, first slot)."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, n in chosen:
        slot = 0
        for cell, times in sorted(pattern.items(), reverse=True):
            begin = taken.get(cell, 0)
            taken[cell] = begin + n * times
            out.append((cell, begin, taken[cell], sequence, times, slot))
            slot += times
        sequence += n
    return out


def _pieces(path: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokenise, cut, and number the pieces of each length within this task."""
    part, half, full = TaskContext.get().partitionId(), window // 2, window // GRAIN
    encoder = PieceIds(path)
    counted = np.zeros(full + 1, np.int64)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        rows: list[tuple] = []
        tokens, begins = encoder.encode(texts)
        for doc, first, beyond in zip(ids, begins[:-1].tolist(), begins[1:].tolist()):
            n = beyond - first + 1
            start = 0
            while start < n:
                rest = n - start
                length = window if rest >= window else half if rest > half else rest
                crc = zlib.crc32(tokens[first + start : min(first + start + length, beyond)])
                start += length
                rows.append((doc, n, start - length, length, zlib.crc32(end, crc) if start == n else crc))
        doc, n, start, length, crc = map(list, zip(*rows))
        cells = -(-np.array(length, np.int64) // GRAIN)
        by = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(cells[by]) != 0])
        size = np.diff(np.append(first, len(by)))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by)) - np.repeat(first, size) + np.repeat(counted[cells[by][first]], size)
        counted[cells[by][first]] += size
        return pa.RecordBatch.from_pydict(
            {
                "doc": pa.array(doc, id_type),
                "doc_tokens": pa.array(n, pa.int64()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "cell": pa.array(cells, pa.int32()),
                "part": pa.array(np.full(len(by), part), pa.int32()),
                "nth": pa.array(rank, pa.int64()),
            }
        )

    for batch in batches:
        docs, texts = batch["doc"].to_pylist(), batch["text"]
        begin, chars, group = 0, 0, []
        for text in texts:
            group.append(text.as_py())
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield cut(docs[begin : begin + len(group)], group, batch["doc"].type)
                begin, chars, group = begin + len(group), 0, []
                give_back()
        if group:
            yield cut(docs[begin:], group, batch["doc"].type)
    give_back()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and one end id; a null or empty text is the end id alone. Every id lies in one piece, each
    piece in one sequence of at most ``window`` ids, and the offsets of a sequence are gapless from 0. Repeated rows are
    packed as often as they occur; a null id stays null. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {id_type}, doc_tokens long, start long, length long, ids_crc32 long, cell int, part int, nth long"
    pieces = stored(rows.mapInArrow(lambda batches: _pieces(tokenizer, window, batches), schema))
    # One row per task and length: a third of all documents may share a length, so ranks are not counted per length.
    counts = pieces.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # window / GRAIN rows
    chosen = ranges(patterns(histogram, window // GRAIN))
    plan = docs.sparkSession.createDataFrame(
        chosen, "cell int, first long, beyond long, sequence long, times long, slot long"
    )  # a few ranges per length
    placed = pieces.join(offsets, ["cell", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    found = placed.join(
        F.broadcast(plan.withColumnRenamed("cell", "_cell")),
        (F.col("cell") == F.col("_cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")),
    ).withColumn("k", F.col("rank") - F.col("first"))
    slots = found.withColumns(
        {
            "sequence_id": F.col("sequence") + F.expr("k div times"),
            "slot": F.col("slot") + F.col("k") % F.col("times"),
        }
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.select(
        F.col("doc").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_pack_documents")
def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
