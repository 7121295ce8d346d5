import random

import numpy as np
import pytest

from stratavox.llm.toxicity import Grammar, compose, fit, fit_curve, insult_machine, negation_machine, report_machine, score_toxicity, target_machine, threat_machine

GRAMMAR = Grammar(weights={"idiot": 2.0, "schurk*": 3.0})


def weight(text: str) -> float:
    return GRAMMAR.clause(GRAMMAR.rewritten(text.split()))


def test_machines_shape_the_weight():
    plain = weight("an idiot walks")
    assert plain == 2.0
    assert weight("you idiot") > plain > weight("not an idiot") > 0
    assert weight("he wrote idiot") < weight("he idiot")
    assert weight("we will kill you") > weight("we will kill time") > 0
    assert weight("we never kill you") < weight("we will kill you")
    assert weight("schurkerei") == 3.0 and weight("schurk") == 0.0
    assert weight("1d10t") == 2.0
    assert weight("nothing here") == 0.0


def test_clauses_end_reach():
    assert GRAMMAR.features("you. idiot")[0] == 2.0 < GRAMMAR.features("you idiot")[0]
    assert GRAMMAR.features("") == (0.0, 0.0, 0.0)
    assert GRAMMAR.features("fine day. " * 20_000 + "IDIOT")[0] == 2.0


def test_composition_adds_weights_and_multiplies_factors():
    machine = compose([insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine()])
    assert len(machine.arcs) == 1 * 4 * 5 * 3 * 2
    assert all(0 <= to < len(machine.arcs) for arcs in machine.arcs.values() for to, _, _ in arcs.values())


def test_curve_recovers_a_boundary():
    draw = np.random.default_rng(0)
    x = draw.uniform(0, 4, (2000, 3))
    y = (draw.random(2000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 6)))).astype(float)
    beta = fit_curve(x, y)
    assert beta[1] == pytest.approx(3, abs=0.5) and beta[0] == pytest.approx(-6, abs=1)


def test_learns_words_and_stems_and_leaves_clean_texts_alone(spark):
    draw = random.Random(4)
    words = [f"wort{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        own = [draw.choice(words) for _ in range(40)]
        toxic = int(draw.random() < 0.2)
        if toxic:
            for _ in range(2):
                own.insert(draw.randrange(40), draw.choice(["grobian", *["lumpen" + x for x in "ab cd ef gh ij kl".split()]]))
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    rows += [(2000, None), (2001, ""), (None, "grobian"), (3, rows[3][1])]
    labels += [(None, 1), (5, None), (99999, 1)]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, toxic string")
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {i: t for i, t in labels if i is not None and t is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 2000]
    right = [r for r in held if r.predicted == truth[r.doc_id]]
    assert len(right) >= 0.97 * len(held)
    assert not any(r.predicted for r in held if not truth[r.doc_id])
    assert len({round(r.score, 9) for r in got if r.doc_id in (2000, 2001)}) == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "good day")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert scores[1] > scores[2]
    assert score_toxicity(docs.limit(0), labels).collect() == []


def test_copies_of_one_text_count_once(spark):
    draw = random.Random(6)
    words = [f"wort{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        own = [draw.choice(words) for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            own.insert(draw.randrange(30), "idiot")
        rows.append((i, " ".join(own)))
        labels.append((i, toxic))
    quote = " ".join(draw.choice(words) for _ in range(20)) + " idiot " + " ".join(draw.choice(words) for _ in range(20))
    for i in range(1000, 1450):  # clean copies of one text, in two spellings
        rows.append((i, quote if i % 2 else quote.upper() + "!"))
        labels.append((i, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grammar = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic")
    alone = fit(docs.where("doc_id < 1001"), spark.createDataFrame(labels[:901], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert grammar.weights["idiot"] > 1
    assert grammar.weights == alone.weights and grammar.curve == pytest.approx(alone.curve)


def test_ids_with_both_labels_are_not_learned_from(spark):
    """A word whose only toxic rows also carry the other label stays unknown."""
    texts = [(i, f"the foulwort number {i} stood near gate {i % 7} today") for i in range(60)] + [(100 + i, f"a calm day {i} by the sea {i % 5}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    clear = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)]
    schema = "doc_id long, toxic int"
    known = fit(docs, spark.createDataFrame(clear, schema), "doc_id", "text", "toxic")
    mixed = fit(docs, spark.createDataFrame(clear + [(i, 0) for i in range(60)], schema), "doc_id", "text", "toxic")
    assert any(w.startswith("foulw") for w in known.weights) and not any(w.startswith("foulw") for w in mixed.weights)


def plain_features(grammar, text):
    """Clauses, words and the four machines one by one, without the composed machine and its shortcuts."""
    import math
    import re

    best = total = 0.0
    matched = clauses = 0
    for part in re.split(r"[.!?;:\n]+", text.lower()):
        words = grammar.rewritten(re.findall(r"[^\W_]+(?:[@$][^\W_]+)*", part))
        if not words:
            continue
        clauses += 1
        machines = [insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine()]
        states, weight = [m.start for m in machines], 0.0
        for word in words:
            label = grammar.labels.get(word, 0)
            pay, factor = (grammar.weights[word] if label == 1 else 0.0), 1.0
            for k, m in enumerate(machines):
                states[k], extra, times = m.arcs[states[k]].get(label, m.arcs[states[k]][0])
                pay, factor = pay + extra, factor * times
            weight += pay * factor
        matched += weight > 0
        best, total = max(best, weight), total + weight
    return best, math.log1p(total), matched / clauses if clauses else 0.0


def test_features_equal_machines_run_one_by_one():
    draw = random.Random(9)
    words = "you idiot not never wrote said kill we they schurken schurkerei 1d10t nice day the of KILL Idiot".split()
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", ", ", ". ", "\n", "! "]) for _ in range(draw.randint(0, 40)))
        assert np.allclose(GRAMMAR.features(text), plain_features(GRAMMAR, text)), text
