"""Counts of the quicksort, whole rankings against brute force, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from stratavox.llm.collocation import collocations, counted, read_words, slices, three_way


def brute(rows, least, top, covered=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    f[lang, tuple(words[i : i + d])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for d in range(2, len(w)):
            for i in range(len(w) - d + 1):
                longer[lang, w[i : i + d]] = max(longer[lang, w[i : i + d]], a)
    out = []
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= covered * a:
            continue
        cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked, result = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        ranked[lang] += 1
        if ranked[lang] <= top:
            result.append((lang, ranked[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(result)


def random_rows(seed, count=120):
    rng = np.random.default_rng(seed)
    words = np.array("the of and Über x yy zz,w a.b é Ö".split())
    share = np.r_[0.4, 0.2, np.full(len(words) - 2, 0.4 / (len(words) - 2))]
    marks = np.array([" ", "  ", "\t", ", ", ". ", "\n", " \r\n"])
    rows = []
    for i in range(count):
        n = int(rng.integers(0, 40))
        text = "".join(w + m for w, m in zip(rng.choice(words, n, p=share), rng.choice(marks, n, p=[0.6, 0.1, 0.1, 0.08, 0.06, 0.03, 0.03])))
        rows.append(([None, "en", "de", "en"][i % 4], text))
    return rows + [("en", "common passage of all documents here")] * 30


def frame(spark, rows):
    return spark.createDataFrame([(l, t, "x", 1) for l, t in rows], "lang string, text string, word string, h int")


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,least,top,sizes", [(0, 3, 2000, (1 << 20, 1000, 1)), (1, 2, 7, (200, 20, 9)), (2, 5, 50, (1000, 50, 4))])
def test_ranking_equals_brute_force(spark, seed, least, top, sizes):
    rows = random_rows(seed)
    group_bytes, range_rows, ranges = sizes
    got = collocations(frame(spark, rows).repartition(3), least=least, top=top, group_bytes=group_bytes, range_rows=range_rows, ranges=ranges)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(got) == brute(rows, least, top)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " .,;!"), ("", "a b a b a b"), ("und", "c d c d"), (None, "c d"), ("l\nx", "c d c d"), ("en", "w" * 300_000 + " x " * 3)]
    assert result(collocations(frame(spark, rows), least=2)) == brute(rows, 2, 2000)


def test_empty_table(spark):
    assert collocations(frame(spark, []), least=1).count() == 0


def test_hot_phrase_over_many_ranges(spark):
    rows = [("en", f"hot pair w{i % 7} v{i % 11}") for i in range(600)]
    got = collocations(frame(spark, rows).repartition(4), least=30, group_bytes=100, range_rows=25, ranges=16)
    assert result(got) == brute(rows, 30, 2000)


@pytest.mark.parametrize("least", [1, 4, 30])
def test_three_way_counts(least):
    rng = np.random.default_rng(least)
    keys = rng.integers(-3, 4, (4, 900))
    keys[:2][keys[:2] == 0] = 5
    keys[3][keys[2] == 0] = 0
    weights = rng.integers(1, 4, 900)
    want = Counter()
    for column, w in zip(keys.T, weights):
        for d in range(2, 5):
            if column[d - 1] != 0:
                want[tuple(column[:d].tolist())] += int(w)
    got = {tuple(keys[:d, p].tolist()): int(n) for d, at, weight in three_way(keys, weights, least) for p, n in zip(at, weight)}
    assert got == {k: n for k, n in want.items() if n >= least}
    phrases, counts, _ = counted(keys, weights, 1)
    whole = {tuple(x for x in p.tolist() if x): int(n) for p, n in zip(phrases.T, counts)}
    assert whole == want and len(counts) == len(want)


def test_slices_and_words():
    raw = b"One two, three. Four five six; seven\neight nine"
    assert b"".join(slices(raw, 8)) == raw and list(slices(b"no cut here at all", 4)) == [b"no cut here at all"]
    words, codes, piece = read_words([b"A b,c", "É a".encode()])
    assert [words[c] for c in codes] == [b"a", b"b", b"c", "É".encode(), b"a"] and piece.tolist() == [0, 0, 1, 2, 2]
