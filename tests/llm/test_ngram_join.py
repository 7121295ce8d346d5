import random

import pytest

from stratavox.llm.ngram_join import join_ngrams, keep_one_of_each, prefix_length

WORDS = [f"w{i}" for i in range(400)]


def near_copies(seed: int, families: int, size: int, length: int, edits: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [draw.choice(WORDS) for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randint(0, edits)):
                own[draw.randrange(length)] = draw.choice(WORDS)
            rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        own = (text or "").lower().split()
        grams = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set()
        sets[i] = grams
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("words,percent,block", [(3, 90, 256), (3, 90, 5), (5, 80, 7)])
def test_classes_equal_brute_force(spark, words, percent, block):
    rows = near_copies(words + block, 6, 18, 80, 4) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "w1 " * 50)]
    got = join_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent, rows_per_block=block).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute(rows, words, percent)


def test_prefix_length_leaves_no_room():
    for n in range(1, 200):
        assert n - prefix_length(n, 90) < -(-90 * n // 100)


def test_stage_keeps_one_of_each(spark):
    rows = [(i, t, "x", "y") for i, t in near_copies(3, 4, 6, 60, 1)] + [(None, "alone in the world of words", "x", "y"), (50, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, root string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80)
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == sorted({c for _, c in want.values()})
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join_ngrams(docs).collect() == [] and keep_one_of_each(docs).collect() == []
