import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratavox.llm.packing import nnls, pack, patterns, vocabulary
from stratavox.llm.tokens import PieceIds

HARD = [
    "Hello, WORLD's it's 'S don't 12345 a1b2", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "Straße ÉCOLE İstanbul ΣΑΣ ﬁ ½ x²",
    "a\x1cd\x85e", "日本語 123", "é café", "''s's 'll", "<| |>", "ÿ× ÷ª º µ Å", "\x00\x01a b\x7f", "😀👍🏽 ok", "İ ǅ ſ K", "", " ", "x" * 3000, "a\r\nb",
]


def test_ids_equal_the_tokenizers():
    tokenizer, pieces = Tokenizer.from_file(vocabulary()), PieceIds(vocabulary())
    ids, begins = pieces.encode(HARD)
    for i, text in enumerate(HARD):
        assert ids[begins[i] : begins[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_block_looks_each_distinct_piece_up_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def _one(self):
            self.asked += 1
            return super()

        def get(self, *at):
            return self._one().get(*at)

        def __getitem__(self, at):
            return self._one().__getitem__(at)

        def __contains__(self, at):
            return self._one().__contains__(at)

    pieces = PieceIds(vocabulary())
    texts = [" ".join(f"{a}{b} " * 3 for b in "xyz") for a in ("on", "tw", "thr")]
    want = [x.tolist() for x in pieces.encode(texts)]
    pieces.known = Counted(pieces.known)
    assert [x.tolist() for x in pieces.encode(texts)] == want and pieces.known.asked == 9
    monkeypatch.setattr("stratavox.llm.tokens.CACHE_ENTRIES", 4)  # the known pieces go, and are learned again
    assert [x.tolist() for x in pieces.encode(texts)] == want
    tokenizer = Tokenizer.from_file(vocabulary())
    for text in [*HARD, *texts]:
        assert pieces.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_documents_and_fill_windows(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("alpha beta Gamma, 7x ünder".split()) for _ in range(draw.choice([0, 3, 40, 500, 1500, 5000])))) for i in range(120)]
    rows += [(1000 + i, "same length " * 200) for i in range(150)] + [(5000, None), (5001, ""), (None, "no id"), (3, rows[3][1])]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), vocabulary()).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    want = sorted(
        (np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows), key=len
    )
    spans = {}
    for r in got:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert sum(r.length for r in got) == sum(len(w) // 4 for w in want)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(set(spans[i, len(ids)]))
        assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = []
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]])[:-1].tolist()
        used.append(sum(n for _, n in pieces))
    assert max(used) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding < 0.05 * sum(used)


def test_patterns_use_up_the_histogram():
    draw = np.random.default_rng(1)
    counts = {int(c): int(n) for c, n in zip(draw.permutation(np.arange(1, 257))[:90], draw.integers(1, 5000, 90))} | {512: 17}
    left = dict(counts)
    for pattern, n in patterns(counts, 512):
        assert n > 0 and sum(c * k for c, k in pattern.items()) <= 512
        for cell, times in pattern.items():
            left[cell] -= n * times
    assert set(left.values()) == {0}
    assert sum(n for _, n in patterns(counts, 512)) <= 1.02 * sum(c * n for c, n in counts.items()) / 512 + 2


def test_least_squares():
    matrix, x = np.array([[1.0, 2, 0], [0, 1, 1], [1, 0, 3]]), np.array([3.0, 0, 2])
    assert nnls(matrix, matrix @ x) == pytest.approx(x, abs=1e-8)
    assert (nnls(matrix, np.array([-1.0, -1, -1])) == 0).all()


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).collect() == []
