import pytest

from catalog import adapters as A


@pytest.mark.parametrize("name", ["raw_sales", "raw_rolls", "stability_rolls", "raw_county_roll"])
def test_derived_tables_are_not_dealt_in_turn(spark, tiny, monkeypatch, name):
    """Dealing rows in turn sorts each task's whole input first, which spills wide rows."""
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(A, "materialize", written)
    monkeypatch.setattr(A, "_tables", {})
    getattr(A, name)(spark, tiny)
    assert plans and not any("RoundRobinPartitioning" in p for p in plans)
    assert all("Exchange hashpartitioning" in p for p in plans)


@pytest.mark.parametrize("name", ["history", "snapshots"])
def test_rows_read_once_are_not_written_first(spark, tiny, monkeypatch, name):
    """The history and the snapshots are the only pass over the raw rows, so only they are written, and
    rows stay with their parcel from the join to the dedup."""
    written = []

    def kept(df):
        written.append(df)
        return df

    monkeypatch.setattr(A, "materialize", kept)
    monkeypatch.setattr(A, "_tables", {})
    made = getattr(A, name)(spark, tiny)
    assert len(written) == 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    window = plan.find("WindowGroupLimit")
    assert window < 0 or "Exchange" not in plan[window : plan.index("Join", window)]


def test_history_is_the_same_from_stored_rows(spark, tiny, monkeypatch):
    monkeypatch.setattr(A, "_tables", {})
    once = A.history(spark, tiny)
    monkeypatch.setattr(A, "_tables", {})
    A.raw_sales(spark, tiny)
    stored = A.history(spark, tiny)
    assert once.count() == stored.count() > 0
    assert once.exceptAll(stored).isEmpty()
