import hashlib
import random
import re

from stratavox.llm.content_sort import dedup_exact, keep_distinct


def rows_with_copies(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    texts = ["", " \n", "a b", "ab", "a  b ", "b a", "x" * 5000, "x " * 5000, "é à", "éà", None]
    rows = [(i, draw.choice(texts)) for i in range(300)]
    rows += [(1000 + i, "hot text") for i in range(400)]  # one group of half of all rows
    return [*rows, (7, "ab"), (7, "ab"), (None, "ab"), (None, "only null"), (2000, "hot  text")]


def brute(rows):
    groups = {}
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i is None, i if i is not None else 0, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return out


def order(row):
    return [(x is None, x) if x is not None else (True, 0) for x in row]


def test_groups_equal_brute_force(spark):
    rows = rows_with_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in dedup_exact(docs).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_stage_keeps_whole_rows(spark):
    rows = [(i, t, f"l{i}", i) for i, t in rows_with_copies(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _norm string, row long")
    kept = keep_distinct(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[4]) for r in brute([r[:2] for r in rows]) if r[3]}
    got = kept.collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == {i for i, _ in want}
    assert set(map(tuple, got)) <= set(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_exact(docs).collect() == [] and keep_distinct(docs).collect() == []


def test_names_with_dots_and_blanks(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "ab", 6, "y"), (3, None, 7, None)], "doc_id long, text string, `a.b` int, `c d` string")
    kept = keep_distinct(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b", 5, "x"), (3, None, 7, None)]
