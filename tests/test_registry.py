import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(smallest):
    return connect(smallest)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, smallest, duck, name):
    got = rows(entry.queries()[name](spark, smallest).toArrow())
    assert got == rows(duck.sql(ORACLE[name]).to_arrow_table())


def test_entry(spark, smallest):
    assert entry.entry(spark).columns == ["log_offset", "outcome"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_no_float_leaves_the_core(spark, smallest):
    from tallymill.plans import adapter, data_problems, event_log, log_consumer

    for m in (adapter, data_problems, event_log, log_consumer):
        for name, f in m.QUERIES.items():
            assert not [t for _, t in f(spark, smallest).dtypes if t in ("float", "double")], name


def test_known_outcomes_of_the_events_table(spark, smallest):
    """Counts and sums published with the rules of the derived log, for the smallest tables."""
    got = {r["outcome"]: (r["deliveries"], r["quantity"]) for r in entry.queries()["adapter_outcomes"](spark, smallest).collect()}
    assert got == {"inserted": (892, "44467.74"), "duplicate": (128, "6111.61"), "conflict": (81, "4353.63"), "event_too_old": (119, "6318.30"), "invalid_field": (14, "810.86")}
