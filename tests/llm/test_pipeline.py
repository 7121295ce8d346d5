"""The stages on a small fixture against brute force."""

import random

import pytest
from test_content_sort import brute as copies
from test_decontaminate import brute as leaks
from test_ngram_join import brute as classes

import corpus_pipeline


def corpus(seed: int):
    draw = random.Random(seed)
    words = [f"{a}{b}en" for a in "abcdefghklmnoprst" for b in "aeiou"]
    bench = [(i, " ".join(draw.choices(words, k=14))) for i in range(4)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(draw.choices(words, k=60))))
    rows += [(100 + i, rows[i][1].replace(" ", "  ")) for i in range(6)]  # copies
    for i in range(8):  # near copies
        own = rows[i + 10][1].split()
        own[draw.randrange(60)] = "changed"
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, f"{rows[20 + i][1]} {bench[i][1]} tail") for i in range(4)]
    rows += [(400, None), (401, ""), (402, "123 ...")]
    return rows, bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, bench = corpus(7)
    folder = tmp_path_factory.mktemp("tables")
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench, str(folder)


def test_stages(spark, tables):
    rows, bench, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(left)
        if name == "exact_dedup":
            left = [(r[0], before[r[0]]) for r in copies(left) if r[3]]
        elif name == "near_dedup":
            stay = {c for _, c in classes(left, 5, 80).values()}
            left = [r for r in left if r[0] in stay]
        elif name == "decontaminate":
            left = [(r[0], before[r[0]]) for r in leaks(left, bench) if not r[5]]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(left), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left}
    assert 0 < len(left) < len(rows) - 10


def test_stages_accept_empty_tables(spark, tables):
    _, _, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
