import math
import random
import zlib

import numpy as np

from stratavox.llm.language import ORDER, Trees, fit, grams, identify, keep_identified, padded

WORDS = {"xx": "sol mar luz rio flor casa".split(), "yy": "stein wald haus berg licht feld".split(), "zz": "дом река лес".split()}


def corpus(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(2, 40))), lang))
    return rows


def test_every_context_sums_to_one():
    draw = np.random.default_rng(3)
    keys = draw.integers(97, 100, (400, ORDER + 1)).astype(np.int64)
    packed = sum(keys[:, k] << (8 * (ORDER - k)) for k in range(ORDER + 1))
    distinct, at = np.unique(packed, return_inverse=True)
    trees = Trees(["a", "b"], np.arange(len(distinct)) % 2, distinct, np.bincount(at).astype(float))
    for context in (int(distinct[0]) >> 8, int(distinct[5]) >> 8, 0x61626364, 0x7A7A7A7A, 0x7A7A6161):
        p = np.exp(trees.log_p((context << 8) | np.arange(256)))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def test_code_length_does_not_depend_on_the_batch():
    trees = Trees(["a"], np.zeros(3, int), np.array([0x0000000061, 0x0000006162, 0x0000616263], np.int64), np.array([3.0, 2, 1]))
    together = trees.code([b"abc", b"", b"abcabc", b"z"])
    assert np.allclose(together, [trees.code([t])[0] for t in (b"abc", b"", b"abcabc", b"z")])


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(1, 400) + [(900, None, "xx"), (901, "", None), (902, "12 34 !?", "yy"), (None, "stein wald", None), (905, "sol mar", "xx"), (905, "sol mar", "xx")]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {(i, "und", 0.0) for i in (900, 901, 902)}
    assert all(0 <= r.score <= 1 for r in got)


def test_stage_drops_only_what_has_no_letter(spark):
    rows = [(*r, "u") for r in corpus(2, 40)] + [(100, "...", "xx", "u"), (101, None, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _language string")
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify(docs).collect()] == [("und", 0.0)]
    assert identify(docs.limit(0)).collect() == []


def test_no_language_loses_its_grams_to_the_others(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(1200)]
    rows = [(i, w, f"l{i:04d}") for i, w in enumerate(words)]
    trees = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = trees.classify(words)[0]
    assert sum(x == lang for x, (_, _, lang) in zip(found, rows)) == len(rows)


class PlainContexts:
    """One language's context tree as nested dictionaries: escape by the number of kinds, exclusion of what was seen above."""

    def __init__(self, texts):
        self.counts = [{} for _ in range(ORDER + 1)]
        for text in texts:
            raw = b"\0" * ORDER + text.encode()
            for j in range(ORDER, len(raw)):
                for k in range(ORDER + 1):
                    seen = self.counts[k].setdefault(raw[j - k : j], {})
                    seen[raw[j]] = seen.get(raw[j], 0) + 1

    def p(self, context, byte, k):
        if k < 0:
            return 1 / 256
        seen = self.counts[k].get(context[len(context) - k :])
        if seen is None:
            return self.p(context, byte, k - 1)
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        left = 1 - sum(self.p(context, b, k - 1) for b in seen)
        return kinds / (total + kinds) * self.p(context, byte, k - 1) / left

    def code_length(self, text):
        raw = b"\0" * ORDER + text.encode()
        return -sum(math.log(self.p(raw[j - ORDER : j], raw[j], ORDER)) for j in range(ORDER, len(raw)))


def test_code_lengths_equal_a_plain_context_tree():
    texts = {"a": ["the cat and the hat", "a cat", "the", ""], "b": ["der hut und die katze", "über", "die hüte"]}
    which, keys, counts = [], [], []
    for i, lang in enumerate(sorted(texts)):
        found = {}
        for text in texts[lang]:
            stream, _ = padded([text.encode()])
            for key in grams(stream).tolist():
                found[key] = found.get(key, 0) + 1
        which += [i] * len(found)
        keys += list(found)
        counts += list(found.values())
    trees = Trees(sorted(texts), np.array(which), np.array(keys, np.int64), np.array(counts, float))
    asked = ["the hat", "die katze über", "q", "x" * 40, "cat und", "中 the", "a"]
    got = trees.code([t.encode() for t in asked])
    for j, lang in enumerate(sorted(texts)):
        plain = PlainContexts(texts[lang])
        assert np.allclose(-got[:, j], [plain.code_length(t) for t in asked], rtol=1e-4)
