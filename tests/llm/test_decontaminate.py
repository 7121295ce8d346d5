import hashlib
import random
import re

from stratavox.llm import decontaminate as module
from stratavox.llm.decontaminate import decontaminate, keep_clean

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            size = min(10, len(w))
            for k in range(len(w) - size + 1 if w else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == w[k : k + size]:
                        hit |= set(range(p, p + size))
                        if item_id is not None:
                            found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit)))
    return out


def corpus(seed: int):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(8)] + ["Über", "the", "of"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 10, 13, 25])))) for i in range(25) if i % 7] + [(100, None), (101, "..."), (102, "w1 w2 zz"), (None, "w3 w3 w3 w3 w3")]
    docs = []
    for i in range(60):
        parts = [" ".join(draw.choices(vocabulary[3:], k=draw.randint(0, 30))) for _ in range(2)]
        item = draw.choice(items)[1] or ""
        docs.append((i, f"{parts[0]}, {item.upper() if draw.random() < 0.5 else item}! {parts[1]}" if draw.random() < 0.4 else parts[0]))
    return [*docs, (200, None), (201, ""), (None, docs[3][1]), (5, docs[5][1]), (6, docs[7][1])], items


def order(row):
    return (row[0] is None, *map(str, row))


def test_hits_equal_brute_force(spark, monkeypatch):
    for seed, block in ((1, 100_000), (2, 20)):
        monkeypatch.setattr(module, "BLOCK_WINDOWS", block)
        docs, items = corpus(seed)
        got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(docs, items), key=order)


def test_stage_and_empty_sides(spark):
    docs, items = corpus(3)
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = keep_clean(frame, bench)
    assert kept.columns == frame.columns
    want = sorted(str(r[0]) for r in brute(docs, items) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert decontaminate(frame.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate(frame, bench.limit(0)).collect())


def test_plan_runs_no_python(spark):
    docs, items = corpus(4)
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
