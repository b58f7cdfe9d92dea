import __spark_entry__ as entry
from sondera import plans


def test_every_statement_has_its_query_and_names_are_unique():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(plans.queries()) <= set(q)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["string", "occurrences", "n_windows", "coherence", "stability", "entropy", "rupture", "patternability"] and df.count() > 0
