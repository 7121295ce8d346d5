"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer rewrites words into labels with weights: insult, threat, target, negation, reporting verb, other. Four
small weighted machines read the labels of a clause: the insult machine pays for an insult's weight, the threat machine
for a threatening verb, more so towards a target, the target machine raises an insult near a person, the negation machine
lowers what follows a negation closely, and the report machine lowers what stands behind a reporting verb. Their
composition is one machine whose state is the tuple of states. A clause scores the weight of its path, a text is scored
by its clauses (strongest clause, sum, share of matched clauses), and a logistic curve turns that into a probability.

Insult weights and the curve are learned from a bounded sample of labelled rows (about ``SAMPLE_ROWS``): a word is an insult to
the extent that its distinct contexts (neighbours on both sides) are those of toxic texts. Rows whose texts have the same words
and the same label count as one row for words, class totals and curve, so that copies of one text count once. Words that the sample says nothing about keep the prior of the built-in lists.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.common import fold, stored, table
from stratavox.llm.registry import query

SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
PRIOR_WEIGHT = 2.0
STEM_FORMS = 5
STEM_LENGTHS = (8, 7, 6, 5)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Built-in word lists, in English, German, French and Spanish.
INSULTS = "idiot moron imbecile stupid worthless pathetic disgusting scum trash loser clown idiote trottel abschaum connard crétin imbécile estúpido basura".split()
THREATS = "kill hurt destroy murder töten umbringen vernichten tuer détruire matar destruir".split()
TARGETS = "you your he she they him her them du dich ihr sie tu toi vous il elle tú usted él ella ellos".split()
NEGATIONS = "not no never nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote called claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")


def words_of(clause: str) -> list[str]:
    return WORD.findall(clause)


def stems_of(word: str) -> list[str]:
    """Proper beginnings of a word, longest first, marked with a star."""
    return [word[:k] + "*" for k in STEM_LENGTHS if len(word) > k]


class Machine:
    """A deterministic weighted machine over labels: arcs[state][label] = (next state, weight, factor of later weights)."""

    def __init__(self, start: int, arcs: dict[int, dict[int, tuple[int, float, float]]]):
        self.start, self.arcs = start, arcs

    def arc(self, state: int, label: int) -> tuple[int, float, float]:
        return self.arcs[state].get(label) or self.arcs[state][OTHER]


def insult_machine() -> Machine:
    """Passes an insult's own weight on."""
    return Machine(0, {0: {OTHER: (0, 0.0, 1.0)}})


def threat_machine(reach: int = 3) -> Machine:
    """A threat pays a little by itself and more if a target follows within ``reach`` words or stood just before."""
    arcs = {0: {OTHER: (0, 0.0, 1.0), THREAT: (reach, 0.3, 1.0)}}
    for k in range(1, reach + 1):
        arcs[k] = {OTHER: (k - 1, 0.0, 1.0), THREAT: (reach, 0.3, 1.0), TARGET: (0, 0.7, 1.0)}
    return Machine(0, arcs)


def target_machine(reach: int = 4) -> Machine:
    """An insult within ``reach`` words of a target weighs more."""
    arcs = {0: {OTHER: (0, 0.0, 1.0), TARGET: (reach, 0.0, 1.0)}}
    for k in range(1, reach + 1):
        arcs[k] = {OTHER: (k - 1, 0.0, 1.0), TARGET: (reach, 0.0, 1.0), INSULT: (k - 1, 0.0, 1.25)}
    return Machine(0, arcs)


def negation_machine(reach: int = 2) -> Machine:
    """What follows a negation within ``reach`` words weighs less; a second negation restores it."""
    arcs = {0: {OTHER: (0, 0.0, 1.0), NEGATION: (reach, 0.0, 1.0)}}
    for k in range(1, reach + 1):
        arcs[k] = {OTHER: (k - 1, 0.0, 1.0), NEGATION: (0, 0.0, 1.0), INSULT: (k - 1, 0.0, 0.5), THREAT: (k - 1, 0.0, 0.3)}
    return Machine(0, arcs)


def report_machine() -> Machine:
    """What stands behind a reporting verb in the same clause weighs less."""
    behind = {OTHER: (1, 0.0, 1.0), INSULT: (1, 0.0, 0.7), THREAT: (1, 0.0, 0.5)}
    return Machine(0, {0: {OTHER: (0, 0.0, 1.0), REPORT: (1, 0.0, 1.0)}, 1: behind})


def compose(machines: list[Machine]) -> Machine:
    """The product machine: all read the same label; weights add up and factors multiply."""
    order = [sorted(m.arcs) for m in machines]
    number = {states: i for i, states in enumerate(product(*order))}
    arcs = {}
    for states, i in number.items():
        arcs[i] = {}
        for label in range(6):
            steps = [m.arc(s, label) for m, s in zip(machines, states)]
            to = number[tuple(s[0] for s in steps)]
            arcs[i][label] = (to, sum(s[1] for s in steps), math.prod(s[2] for s in steps))
    return Machine(number[tuple(m.start for m in machines)], arcs)


@dataclass
class Grammar:
    """Lexicon, composed machine and curve."""

    labels: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 1.0, 1.0, 0.5)

    def __post_init__(self) -> None:
        for label, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            for word in words:
                self.labels.setdefault(word, label)
        for word in self.weights:
            self.labels[word] = INSULT
        self.machine = compose([insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine()])
        self.loud = {w for w, label in self.labels.items() if label in (INSULT, THREAT)}
        self.stems = {w: x for w, x in self.weights.items() if w.endswith("*")}
        self.roots = {w[: STEM_LENGTHS[-1]] for w in self.stems}

    def rewritten(self, words: list[str]) -> list[str]:
        """The lexicon's entry for each word: the word, its look-alike spelling, or the heaviest stem."""
        out = []
        for word in words:
            if word not in self.labels:
                word = word.translate(LOOKALIKE)
                if word not in self.labels and word[: STEM_LENGTHS[-1]] in self.roots:
                    word = max((x for x in stems_of(word) if x in self.stems), key=self.stems.get, default=word)
            out.append(word)
        return out

    def clause(self, words: list[str]) -> float:
        """Weight of the clause's path through the composed machine."""
        state, total, arcs = self.machine.start, 0.0, self.machine.arcs
        for word in words:
            label = self.labels.get(word, OTHER)
            state, weight, factor = arcs[state][label]
            own = self.weights.get(word, 0.0) if label == INSULT else 0.0
            total += factor * (own + weight)
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """Strongest clause, log of the sum, share of clauses that match; the whole text is read."""
        low = text.lower()
        words = set(words_of(low))
        plain = words if not any(c in low for c in "013457@$") else words | {w.translate(LOOKALIKE) for w in words}
        if self.loud.isdisjoint(plain) and not (self.roots and any(w[: STEM_LENGTHS[-1]] in self.roots for w in plain)):
            return 0.0, 0.0, 0.0
        best = total = 0.0
        matched = clauses = 0
        for part in CLAUSE.split(low):
            own = words_of(part)
            if not own:
                continue
            clauses += 1
            own = self.rewritten(own)
            if self.loud.isdisjoint(own):
                continue
            score = self.clause(own)
            if score > 0:
                best, total, matched = max(best, score), total + score, matched + 1
        return best, math.log1p(total), matched / max(clauses, 1)

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic, documents that hold it, per batch."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = {}
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            own = {w.translate(LOOKALIKE) if not w.isalpha() else w for w in words_of(text.lower())}
            for word in own.union(*map(stems_of, own)):
                counts[word, toxic] = counts.get((word, toxic), 0) + 1
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([k[0] for k in counts], pa.string()),
                "toxic": pa.array([k[1] for k in counts], pa.int32()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )


def _word_digest(texts: pa.Array) -> pa.Array:
    """A digest of each text's words in their order, lower case, without look-alike spellings."""
    spelled = (" ".join(w if w.isalpha() else w.translate(LOOKALIKE) for w in words_of(t.lower())) for t in texts.to_pylist())
    return pa.array([hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() for t in spelled], pa.binary())


def lower_log_odds(hit: float, miss: float, hits: float, misses: float) -> float:
    """Lower end of the 95 % interval of the log odds ratio, half a count added."""
    a, b, c, d = hit + 0.5, miss + 0.5, hits - hit + 0.5, misses - miss + 0.5
    return math.log(a * d / (b * c)) - 1.96 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def learn_lexicon(sample: DataFrame, rows: dict[int, int]) -> dict[str, float]:
    """Insult weights from the sample (text, toxic). All its candidates count: the sample, not a number of words, is the bound."""
    clean, toxic = rows.get(0, 0), rows.get(1, 0)
    counted = sample.mapInArrow(_document_counts, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
    )
    odds = (F.col("t") + 0.5) * (clean + 1.0) / ((F.col("c") + 0.5) * (toxic + 1.0))
    listed = F.col("word").isin(INSULTS)
    seen = counted.where(listed | ((F.col("t") >= 5) & (odds > 4))).collect()  # words of the bounded sample
    words = {r["word"]: (r["t"], r["c"]) for r in seen}
    wanted = frozenset(words)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                own = words_of(text.lower())
                for i, word in enumerate(own):
                    key = word if word.isalpha() else word.translate(LOOKALIKE)
                    for entry in (key, *stems_of(key)):
                        if entry in wanted:
                            found.add((entry, label, key, " ".join(own[max(0, i - 2) : i] + ["*"] + own[i + 1 : i + 3])))
            columns = zip(*found) if found else ((), (), (), ())
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "toxic", "form", "around"])

    distinct = sample.mapInArrow(contexts, "word string, toxic int, form string, around string").where("toxic = 1").groupBy("word").agg(
        F.count_distinct("around").alias("t"), F.count_distinct("form").alias("forms")
    )
    around = {r["word"]: (r["t"], r["forms"]) for r in distinct.collect()}  # words of the bounded sample
    weights = {w: PRIOR_WEIGHT for w in INSULTS}
    for word, (t, c) in words.items():
        far_t, forms = around.get(word, (0, 0))
        weight = lower_log_odds(min(t, far_t), c, toxic, clean)
        if word in INSULTS:
            evidence = min(1.0, (t + c) / 20)
            weight = (1 - evidence) * PRIOR_WEIGHT + evidence * weight
        elif far_t < 8 or far_t < 0.6 * t:
            continue  # too few contexts of its own: copies of one text
        elif word.endswith("*") and forms < STEM_FORMS:
            continue  # a word, not a stem
        if weight > 1.0:
            weights[word] = min(weight, 6.0)
        else:
            weights.pop(word, None)
    return weights


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    beta[1:] = np.maximum(beta[1:], 0.0)
    return tuple(beta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn from about ``sample_rows`` labelled rows of ``docs``, whole texts, chosen by a hash of the id.

    An id with both labels is not learned from. Of rows with one label whose texts have the same words, one is learned from,
    whatever their ids. Without toxic and clean rows in the sample the built-in lists and a fixed curve are used.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")
    )
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    at = F.shiftrightunsigned(F.xxhash64("_id"), 1) / F.lit(2.0**63)
    drawn = known.where(at < share).groupBy("_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    some = drawn.where("toxic = other").drop("other")  # about sample_rows rows of two numbers
    words = F.arrow_udf(_word_digest, "binary")
    sample = stored(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(some), "_id")
        .select(words("text").alias("words"), "text", "toxic")
        .groupBy("words", "toxic")
        .agg(F.min("text").alias("text"))
        .select("text", "toxic")
    )
    rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not rows.get(0) or not rows.get(1):
        return Grammar(weights={w: PRIOR_WEIGHT for w in INSULTS})
    grammar = Grammar(weights=learn_lexicon(sample, rows))

    @F.pandas_udf("best double, total double, share double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([grammar.features(t) for t in texts], columns=["best", "total", "share"])

    seen = sample.select(measured("text").alias("f"), "toxic").select("f.*", "toxic").toPandas()  # about sample_rows rows
    grammar.curve = fit_curve(seen[["best", "total", "share"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return grammar


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    hold_out: tuple[int, int] = (3, 1),
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (1 from ``THRESHOLD`` on).

    Labels of held-out ids, null labels, labels of unknown ids and ids with both labels are not learned from. Null and empty texts get the score
    of a text without a match. An empty table gives an empty result; repeated rows repeat.
    """
    mod, rest = hold_out
    held = fold(id_col, mod) == rest
    grammar = fit(docs, labels.where(~held), id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # words of the bounded sample

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.select(F.col(id_col), held.alias("held_out"), scores(F.coalesce(F.col(text_col), F.lit(""))).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
