"""Every registered query against its SQL on the smallest given tables."""

import pytest

from compare import DATA, connect, difference
from wardlake.plans.oracle import ORACLE
from wardlake.plans.queries import QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], SF) is None


def test_comparison_sees_differences(spark, con):
    wrong = ORACLE["a5_risk_distribution"].replace("count(*) AS log_count", "count(*) + 1 AS log_count")
    assert difference(spark, con, QUERIES["a5_risk_distribution"], wrong, SF)
    assert difference(spark, con, QUERIES["a1_total_logs"], "SELECT 1 AS other", SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "wardlake.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without_a_part_of_the_corpus_library(missing):
    """The other queries are there when a library of the corpus part, or the part itself, is not."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    )
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and int(out[1]) >= len(ORACLE) and out[2] == "False"
