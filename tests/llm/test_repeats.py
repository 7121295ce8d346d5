import hashlib
import random

import pytest

from stratavox.llm import repeats
from stratavox.llm.repeats import remove_repeats


def brute(rows, length):
    first = {}
    for i, text in sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s : s + length], float("inf") if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (float("inf") if i is None else i):
                gone[s : s + length] = b"\1" * length
        spans, k = [], 0
        while k < len(raw):
            if gone[k]:
                end = k
                while end < len(raw) and gone[end]:
                    end += 1
                spans.append((k, end - k))
                k = end
            else:
                k += 1
        out.append((i, len(raw), sum(gone), tuple(spans), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def corpus(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    words = "the of and thing ñandú über ever onward in to is a".split()
    passages = [" ".join(draw.choices(words, k=14)) for _ in range(6)]
    rows = []
    for i in range(60):
        own = [draw.choice(passages) if draw.random() < 0.3 else " ".join(draw.choices(words, k=draw.randint(1, 12))) for _ in range(draw.randint(0, 6))]
        rows.append((i, " ".join(own)))
    rows += [(100 + i, "a" * draw.randint(0, 200)) for i in range(8)] + [(200 + i, rows[i][1]) for i in range(20)]
    return [*rows, (300, None), (None, rows[5][1]), (None, "x" * 80), (7, rows[7][1]), (8, rows[9][1])]


@pytest.mark.parametrize("length,block", [(50, 4 << 20), (24, 2000)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, length, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = corpus(length)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], hashlib.md5(r[4]).hexdigest())
    assert sorted(found, key=order) == sorted(brute(rows, length), key=order)


def test_document_longer_than_a_block(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from stratavox.llm.blocks import Block

    draw = random.Random(1)
    raw = bytes(draw.choice(b"abcd ") for _ in range(3000)) + b"\n"
    block = Block(1, pa.array([4]), np.array([3000]), raw)
    whole = repeats.Parse(block, 50)
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    parts = repeats.Parse(block, 50)

    def windows(p):
        return {(s, a) for a, first, last in zip(p.at, p.first, p.last) for s in range(first, last + 1)}

    assert len(windows(parts)) == len(windows(whole)) == 2951


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("crowd", [0, 3, 2_000])
def test_crowded_triggers_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd, raising=False)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    rows = corpus(9)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], hashlib.md5(r[4]).hexdigest())
    assert sorted(found, key=order) == sorted(brute(rows, 50), key=order)


def test_phrases_of_one_trigger_do_not_meet_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 100, raising=False)
    draw = random.Random(2)
    core = min(("".join(draw.choices("abcdefgh", k=16)) for _ in range(4000)), key=lambda x: int(repeats.triggers(x.encode() + b"\n" * 8, 1)[0][0]))
    rows = [(i, "".join(draw.choices("ijklmnop", k=60)) + core + "".join(draw.choices("ijklmnop", k=60))) for i in range(600)]
    settle = repeats.settle
    sizes = []

    def watched(sent, answer, *more):
        sizes.append([len(r.body) for r in sent.groupBy("bucket").agg({"body": "max"}).toDF("bucket", "body").collect()])
        return settle(sent, answer, *more)

    monkeypatch.setattr(repeats, "settle", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert all(r.n_removed == 0 for r in remove_repeats(docs).collect())
    assert max(sizes[1]) < 0.2 * sum(sizes[1])
