import math
import random
import zlib
from collections import Counter

import pytest

from stratavox.llm import katz
from stratavox.llm.common import CLEANUP, discard, stored
from stratavox.llm.katz import GOOD_TURING, TAIL, discounts, score_katz


def reference(rows, order):
    """Scores by the textbook formulas, and the probability of any word after any history."""
    counts = [Counter() for _ in range(order)]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = [(i, ["</s>", *(text or "").lower().split(), "</s>"]) for i, text in rows]
    for i, own in texts:
        if not held[i]:
            for n in range(1, order + 1):
                counts[n - 1].update(tuple(own[k - n + 1 : k + 1]) for k in range(1, len(own)) if k - n + 1 >= 0)
    total = sum(counts[0].values())
    share = [discounts([sum(v == r for v in c.values()) for r in range(1, GOOD_TURING + 2)]) for c in counts]

    def kept(gram):
        n = len(gram) - 1
        count = counts[n][gram]
        return count * share[n][count] if count <= GOOD_TURING else count - TAIL

    unknown = 1 - sum(kept(g) for g in counts[0]) / total if total else 1.0

    def probability(h, w):
        if not h:
            return kept((w,)) / total if counts[0][w,] else unknown
        below = probability(h[1:], w)
        times = counts[len(h) - 1][h]
        if not times:
            return below
        if counts[len(h)][*h, w]:
            return kept((*h, w)) / times
        seen = [g for g in counts[len(h)] if g[:-1] == h]
        left = 1 - sum(kept(g) for g in seen) / times
        return left / (1 - sum(probability(h[1:], g[-1]) for g in seen)) * below

    out = []
    for i, own in texts:
        base = sum(math.log10((counts[0][w,] + 1) / (total + len(counts[0]) + 1)) for w in own[1:])
        score = sum(math.log10(probability(tuple(own[max(0, k - order + 1) : k]), own[k])) for k in range(1, len(own)))
        out.append((i, held[i], len(own) - 1, sum(counts[0][w,] > 0 for w in own[1:]), total, base, score))
    return out, probability, counts


def corpus(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 30)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "NEW words Only"), (None, "w1 w2"), (3, rows[3][1])]


def key(row):
    return (row[0] is None, row[0] or 0, row[6])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_the_formulas(spark, order):
    rows = corpus(order, 120)
    want, probability, counts = reference(rows, order)
    got = score_katz(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    words = [w for (w,) in counts[0]]
    histories = [*[(w,) for w in words[:8]], ("</s>",), ("unseen",), *[g for c in counts[1 : order - 1] for g in list(c)[:8] if g[-1] != "</s>"]]
    for h in histories:
        assert sum(probability(h, w) for w in words) + probability(h, "never seen") == pytest.approx(1)


def test_order_is_at_least_two(spark):
    with pytest.raises(ValueError):
        score_katz(spark.createDataFrame([(1, "a")], "doc_id long, text string"), order=1)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_katz(empty).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_katz(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).head()
    assert tuple(row) == (lone, True, 3, 0, 0, 0.0, 0.0)
    bare = spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id long, text string")
    assert [r.n_tokens for r in score_katz(bare, order=4).collect()] == [1, 1, 1]


def test_exchanges_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: set(manager.getAllFiles().mkString("\n").split("\n"))
    before, setting = names(), spark.conf.get(CLEANUP)
    out = stored(spark.range(20_000).selectExpr("id % 1000 AS k").groupBy("k").count(), release=True)
    assert names() <= before | {""} and spark.conf.get(CLEANUP) == setting
    assert out.count() == 1000


def test_scores_outlive_the_files_that_are_taken(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"a b c{i % 7}") for i in range(60)], "doc_id long, text string")
    held = stored(rows)
    discard(held)
    assert spark.read.parquet(held.inputFiles()[0].rsplit("/", 1)[0]).count() == 0
    taken = []
    monkeypatch.setattr(katz, "discard", lambda df: (taken.append(set(df.columns)), discard(df)))
    assert score_katz(rows).count() == 60
    assert taken == [{"gid", "ids", "lengths", "body"}, {"bucket", "gid", "body"}, {"bucket", "gid", "body"}]
    assert score_katz(rows.limit(0)).count() == 0
