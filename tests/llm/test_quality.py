"""Statistics and scores against plain Python, rules and penalty on made data, held-out rows, odd rows."""

import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm.quality import NAMES, Ensemble, Rule, fit_rules, lasso_path, learn_quality, op13_rule_quality, score_quality, statistics, tree_rules

TEXTS = [
    "One two two. THREE, four!\nfive\n\nfive | ## six6 7",
    "",
    None,
    "\n \t",
    "Ünïcode ß Öl; où? où? où? 日本 日本\r\n|",
    "word " * 5000 + "x" * 4000,
    "a$$$ b%%% c&&& !!!",
]


def plain(text):
    text = text or ""
    kinds = [unicodedata.category(c) for c in text]
    n = len(text)
    letters, upper, digits = sum(k[0] == "L" for k in kinds), kinds.count("Lu"), kinds.count("Nd")
    spaces = sum(c in " \t\n\x0b\x0c\r" for c in text)
    ends, commas = sum(c in ".!?" for c in text), sum(c in ",;:" for c in text)
    words, lines = re.findall(r"[^ \t\n\x0b\x0c\r]+", text), [x for x in text.split("\n") if x]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        letters / max(n, 1),
        upper / max(letters, 1),
        digits / max(n, 1),
        (n - letters - digits - spaces) / max(n, 1),
        (n - letters - digits - spaces - ends - commas) / max(n, 1),
        spaces / max(n, 1),
        ends / nw,
        commas / nw,
        letters / nw,
        len(words) / nl,
        len(words) / max(ends, 1),
        sum(a == b for a, b in zip(words, words[1:])) / nw,
        sum(all(unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd" for c in w) for w in words) / nw,
        len(set(words)) / nw,
        len(set(lines)) / nl,
    ]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", 0.0, "w") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double, words string")


def test_statistics_and_scores_equal_plain_python(spark):
    docs = frame(spark, TEXTS)
    counts, made = statistics(F.col("text"))
    got = docs.select("doc_id", "text").withColumns(counts).withColumns(made).orderBy("doc_id").select(*NAMES).collect()
    want = np.array([plain(t) for t in TEXTS])
    assert np.allclose(np.array(got, float), want, atol=1e-12)
    model = Ensemble(-0.5, ((Rule(frozenset({("sign_share", False, 0.1), ("word_count", True, 4.0)})), 2.0), (Rule(frozenset({("length", True, 1.0)})), -1.0)))
    rows = score_quality(docs, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in rows], model.score(want, list(NAMES)))
    assert [r["predicted"] for r in rows] == [int(s >= 0.3) for s in model.score(want, list(NAMES))]
    assert [r["held_out"] for r in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(TEXTS))]


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    model = fit_rules(x, y, rng.integers(0, 5, 1500), list("abcd"))
    assert 0 < len(model.rules) <= 25  # sparse: boosted trees of this size have hundreds of paths
    fresh = rng.random((2000, 4))
    want = (fresh[:, 0] > 0.6) & (fresh[:, 2] <= 0.5)
    assert np.mean((model.score(fresh, list("abcd")) > 0.5) == want) > 0.98
    assert {name for rule, _ in model.rules for name, _, _ in rule.tests} <= {"a", "b", "c", "d"}


def test_lasso_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    a, penalty = (rng.random((400, 12)) > 0.5).astype(float), 0.02
    y = (a[:, 0] + a[:, 1] + rng.normal(0, 0.3, 400) > 1).astype(float)
    intercept, w = lasso_path(a, y, (penalty,), rounds=5000)[0]
    p = 1 / (1 + np.exp(-(intercept + a @ w)))
    slope = a.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-4
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)
    assert np.abs(slope[w == 0]).max() <= penalty + 1e-4 and (w == 0).any()


def test_trees_need_something_to_split():
    assert tree_rules(np.ones((50, 2)), np.r_[np.ones(25), np.zeros(25)], ["a", "b"]) == []


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_one_label_only(y):
    model = fit_rules(np.zeros((len(y), 1)), np.array(y), np.zeros(len(y), int), ["a"])
    assert not model.rules and math.isclose(model.score(np.zeros((1, 1)), ["a"])[0], (sum(y) + 1) / (len(y) + 2))


def test_labels_that_clash_are_left_out(spark):
    docs = frame(spark, [f"text number {i} of all" for i in range(8)] + [None]).unionByName(frame(spark, ["again"]))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, text int")
    assert learn_quality(docs, labels) == Ensemble(0.0)
    out = score_quality(docs, Ensemble(0.0))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 10
    assert score_quality(docs.limit(0), Ensemble(0.0)).count() == 0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op13_rule_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    bad = got[got["quality"] == 0]
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.9 and (bad["predicted"] == 0).mean() > 0.8
