"""Text quality by a sparse ensemble of rules.

* Statistics of the whole text are Spark expressions: shares of letters, capitals, digits and signs, word and line shapes, repetition.
* Shallow trees are boosted on a bounded sample of labelled rows (about ``SAMPLE_ROWS`` ids, drawn by hash). Every path from a root
  to a node is a rule: a conjunction of comparisons of statistics.
* Weights come from logistic regression with an L1 penalty over the rules; most rules get none. The penalty is the largest whose
  loss on the rows held back (by hash of the text) is close to the best of the path.
* The rules that remain are compiled into one column expression, so scoring is a projection.

Rows with the same statistics and label count once, so copies of a text do not weigh more.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import fold, table
from stratavox.llm.registry import query

SAMPLE_ROWS = 12_000
TREES = 24
DEPTH = 3
BINS = 48
RATE = 0.3
LEAST_LEAF = 10
PENALTIES = (0.03, 0.02, 0.012, 0.008, 0.005, 0.003, 0.0015)
#: A larger penalty is taken if its loss exceeds the best by no more than this share (and this much).
SLACK, SLACK_LOSS = 0.1, 0.002
THRESHOLD = 0.3

#: (statistic, below or equal, bound)
Test = tuple[str, bool, float]


def statistics(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """What is counted in a text, and the statistics made of the counts (by name)."""
    text = F.coalesce(text, F.lit(""))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    counts = {
        "chars": F.length(text),
        "upper": gone(r"\p{Lu}+"),
        "letters": gone(r"\p{L}+"),
        "digits": gone(r"\p{Nd}+"),
        "spaces": gone(r"\s+"),
        "ends": gone(r"[.!?]+"),
        "commas": gone(r"[,;:]+"),
        "words": F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        "lines": F.filter(F.split(text, r"\n"), lambda w: w != ""),
    }
    c = lambda name: F.col(name)
    most = lambda col: F.greatest(col, F.lit(1)).cast("double")
    n_words, n_lines = F.size(c("words")), F.size(c("lines"))
    same = F.filter(c("words"), lambda w, i: (i > 0) & (w == F.get(c("words"), i - 1)))
    bare = F.filter(c("words"), lambda w: ~w.rlike(r"[\p{L}\p{Nd}]"))
    made = {
        "length": F.log1p(c("chars").cast("double")),
        "word_count": F.log1p(n_words.cast("double")),
        "letter_share": c("letters") / most(c("chars")),
        "upper_share": c("upper") / most(c("letters")),
        "digit_share": c("digits") / most(c("chars")),
        "sign_share": (c("chars") - c("letters") - c("digits") - c("spaces")) / most(c("chars")),
        "other_sign_share": (c("chars") - c("letters") - c("digits") - c("spaces") - c("ends") - c("commas")) / most(c("chars")),
        "space_share": c("spaces") / most(c("chars")),
        "ends_per_word": c("ends") / most(n_words),
        "commas_per_word": c("commas") / most(n_words),
        "letters_per_word": c("letters") / most(n_words),
        "words_per_line": n_words / most(n_lines),
        "words_per_end": n_words / most(c("ends")),
        "repeated_next": F.size(same) / most(n_words),
        "bare_sign_words": F.size(bare) / most(n_words),
        "distinct_words": F.size(F.array_distinct(c("words"))) / most(n_words),
        "distinct_lines": F.size(F.array_distinct(c("lines"))) / most(n_lines),
    }
    return counts, {name: col.cast("double") for name, col in made.items()}


NAMES = (
    "length word_count letter_share upper_share digit_share sign_share other_sign_share space_share ends_per_word commas_per_word "
    "letters_per_word words_per_line words_per_end repeated_next bare_sign_words distinct_words distinct_lines"
).split()


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests; it holds where all of them do."""

    tests: frozenset[Test]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        met = np.ones(len(x), bool)
        for name, below, bound in self.tests:
            met &= (x[:, names.index(name)] <= bound) == below
        return met

    def column(self) -> Column:
        tests = [F.col(name) <= bound if below else F.col(name) > bound for name, below, bound in sorted(self.tests)]
        return reduce(and_, tests)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the score is the logistic function of their sum and the intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        terms = [F.when(rule.column(), F.lit(float(w))).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(add, terms, F.lit(float(self.intercept)))))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            total += w * rule.holds(x, names)
        return 1 / (1 + np.exp(-total))


def _simplified(tests: list[Test]) -> frozenset[Test]:
    """Of tests of one statistic in one direction only the narrowest counts."""
    kept: dict[tuple[str, bool], float] = {}
    for name, below, bound in tests:
        old = kept.get((name, below), bound)
        kept[name, below] = min(old, bound) if below else max(old, bound)
    return frozenset((name, below, bound) for (name, below), bound in kept.items())


def grow(codes: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, names: list[str], depth: int) -> tuple[list[list[Test]], np.ndarray]:
    """One tree of Newton steps on binned statistics: the path to every node, and the step of each row."""
    paths: list[list[Test]] = []
    step = np.zeros(len(codes))

    def node(rows: np.ndarray, tests: list[Test], left: int) -> None:
        if tests:
            paths.append(tests)
        g, h = slope[rows].sum(), curve[rows].sum()
        step[rows] = g / (h + 1.0)
        if left == 0 or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-6, -1, -1)
        for j, bounds in enumerate(edges):
            if not len(bounds):
                continue
            own = codes[rows, j]
            size = len(bounds) + 1
            n, gs, hs = (np.bincount(own, weights=w, minlength=size).cumsum()[:-1] for w in (np.ones(len(rows)), slope[rows], curve[rows]))
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1.0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], j, at)
        _, j, at = best
        if j < 0:
            return
        below = codes[rows, j] <= at
        bound = float(edges[j][at])
        node(rows[below], [*tests, (names[j], True, bound)], left - 1)
        node(rows[~below], [*tests, (names[j], False, bound)], left - 1)

    node(np.arange(len(codes)), [], depth)
    return paths, step


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Distinct rules of boosted trees, in the order in which they were found."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
        edges.append((values[1:] + values[:-1]) / 2)
    codes = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T)], axis=1)
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[frozenset[Test], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = grow(codes, edges, y - p, p * (1 - p), names, depth)
        margin += RATE * step
        found.update(dict.fromkeys(map(_simplified, paths)))
    return [Rule(tests) for tests in found]


def lasso_path(a: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = PENALTIES, rounds: int = 600) -> list[tuple[float, np.ndarray]]:
    """Intercept and weights for each penalty (falling), by accelerated proximal gradients of the mean logistic loss."""
    rows, k = a.shape
    full = np.column_stack([np.ones(rows), a])
    pace = 4.0 * rows / max(np.linalg.norm(full, 2) ** 2, 1e-12)
    w, out = np.zeros(k + 1), []
    w[0] = np.log((y.sum() + 1) / (rows - y.sum() + 1))
    for penalty in penalties:
        ahead, old, t = w.copy(), w.copy(), 1.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(full @ ahead)))
            w = ahead - pace * (full.T @ (p - y)) / rows
            w[1:] = np.sign(w[1:]) * np.maximum(np.abs(w[1:]) - pace * penalty, 0.0)
            if (ahead - w) @ (w - old) > 0:  # the momentum points uphill
                t = 1.0
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = w + (t - 1) / t_next * (w - old)
            done = np.abs(w - old).max() < 1e-6
            old, t = w, t_next
            if done:
                break
        out.append((float(w[0]), w[1:].copy()))
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, part: np.ndarray, names: list[str]) -> Ensemble:
    """The ensemble for statistics ``x`` and labels ``y``; rows with ``part`` 0 (of 0 to 4) choose the penalty.

    Without rows, or with one label only, the score is the smoothed share of label 1.
    """
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    learn = part != 0
    if learn.all() or not learn.any() or y[learn].min() == y[learn].max():
        learn = np.ones(len(y), bool)
    rules = tree_rules(x[learn], y[learn], names)
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    a = np.stack([r.holds(x, names) for r in rules], axis=1).astype(float)
    spread = np.maximum(np.sqrt(a[learn].mean(0) * (1 - a[learn].mean(0))), 0.05)
    a /= spread
    judge = ~learn if not learn.all() else learn
    losses = []
    for intercept, w in lasso_path(a[learn], y[learn]):
        p = np.clip(1 / (1 + np.exp(-(intercept + a[judge] @ w))), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(np.where(y[judge] > 0, np.log(p), np.log(1 - p))))
    chosen = next(k for k, loss in enumerate(losses) if loss <= min(losses) * (1 + SLACK) + SLACK_LOSS)
    intercept, w = lasso_path(a, y, PENALTIES[: chosen + 1])[-1]
    return Ensemble(intercept, tuple((rule, float(v)) for rule, v in zip(rules, w / spread) if v != 0))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, rest: int, rows: int) -> tuple:
    """(statistics, labels, part by hash of the text): distinct rows of about ``rows`` ids outside the held-out fold.

    Ids with both labels and null labels are left out. The ids are drawn by hash, whatever order the tables have.
    """
    ids = (
        labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label_col}`") > 0).cast("int").alias("y"))
        .where(fold("id", mod) != rest)
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("other"))
        .where("y = other")
        .drop("other")
    )
    total = ids.count()
    share = int(min(1.0, rows / max(total, 1)) * (1 << 30))
    drawn = ids.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts, made = statistics(F.col("text"))
    met = texts.join(F.broadcast(drawn), "id")  # about SAMPLE_ROWS rows of two numbers
    stats = met.withColumns(counts).withColumns(made)
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(5)).cast("int")
    got = stats.select("y", part.alias("part"), *NAMES).groupBy(*NAMES, "y").agg(F.min("part").alias("part")).toPandas()  # the bounded sample
    got = got.sort_values([*NAMES, "y"])
    return got[list(NAMES)].to_numpy(float), got["y"].to_numpy(float), got["part"].to_numpy(int)


def score_quality(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, rest: int = 0) -> DataFrame:
    """id, held_out, score, predicted for every row, from whole texts; null and empty texts score as texts without a word.

    Repeated rows and null ids keep their rows; other columns are neither read nor returned.
    """
    counts, made = statistics(F.col("text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stats = rows.withColumns(counts).withColumns(made).withColumn("score", ensemble.column())
    return stats.select(
        F.col("id").alias(id_col),
        (fold("id", mod) == rest).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, rest: int = 0, rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble learned from labelled rows whose crc32 of the id, modulo ``mod``, is not ``rest``."""
    return fit_rules(*labelled_sample(docs, labels, id_col, text_col, label_col, mod, rest, rows), list(NAMES))


@query("op13_rule_quality")
def op13_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
