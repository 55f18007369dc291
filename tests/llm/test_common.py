"""Slices of Arrow batches."""

import pyarrow as pa

from plotscope.llm import common


def test_slices_keep_rows_and_order():
    texts = ["a" * 10, None, "", "b" * (3 << 20), "é" * 7] * 3 + ["c" * (1 << 20)] * 5
    batch = pa.record_batch({"k": list(range(len(texts))), "t": pa.array(texts)}).slice(1)
    parts = list(common.small_slices(iter([batch.slice(0, 0), batch])))
    assert len(parts) > 3
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1, len(texts)))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts[1:]


def test_a_worker_holds_what_its_last_operator_asked_for():
    made = []
    first = common.held("a", lambda: made.append(1) or "first")
    assert common.held("a", lambda: made.append(1) or "again") is first and made == [1]
    assert list(common.small_slices(iter([]), "a")) == [] and list(common._held) == ["a"]
    common.held("b", lambda: "other")
    assert list(common._held) == ["b"]
    assert list(common.small_slices(iter([]))) == [] and not common._held
