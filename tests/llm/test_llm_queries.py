"""Registered queries against their SQL, at the smallest scale; and the subpackage stands apart."""

from pathlib import Path

import pytest
from check import connect, differences

from stratavox.llm.registry import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) == ""


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("stratavox/**/*.py"), *ROOT.glob("tests/*.py"), *ROOT.glob("tools/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "stratavox.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
