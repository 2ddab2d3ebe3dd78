import random
import re
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions.keys import has_key
from tallymill.operators import dedup_index as module
from tallymill.operators.dedup_index import RUN, IdentifierIndex, _merged, _novel, batches_by_arrival, candidates, contains, exactly_once, first_deliveries, index_of, prefix_bits, redeliveries
from tallymill.session import scratch
from tests.helpers import NOON, ids, usage, values


def brute(rows):
    kept = {}
    for k, r in enumerate(rows):
        key = r.get("idempotency_key", f"key-{k}")
        if key:
            order = (r.get("received_at", NOON) is None, r.get("received_at", NOON) or NOON, k)
            at = (r.get("tenant_id", "acme"), key)
            kept[at] = min(kept.get(at, (order, k)), (order, k))
    keyed = {k for k, r in enumerate(rows) if r.get("idempotency_key", f"key-{k}")}
    return sorted(keyed - {k for _, k in kept.values()})


def log(n, seed):
    r = random.Random(seed)
    # a third of all rows is one message; nulls, empty keys, look-alikes and equal times occur
    return [
        {
            "tenant_id": r.choice(["acme", "acme ", "Acme", None, ""]) if r.random() > 0.33 else "hot",
            "idempotency_key": r.choice([None, "", *[f"k{i}" for i in range(n // 3)]]) if r.random() > 0.33 else "hot",
            "received_at": None if r.random() < 0.02 else NOON - timedelta(seconds=r.randrange(50)),
        }
        for _ in range(n)
    ]


def test_equals_brute_force(spark):
    rows = log(600, 1)
    for r in rows:
        if r["tenant_id"] == "hot":
            r["idempotency_key"] = "hot"
    for batches in (1, 3, 5):
        assert ids(redeliveries(usage(spark, rows), batches)) == sorted(brute(rows))


def test_one_copy_of_each(spark):
    rows = log(200, 2)
    df = usage(spark, rows).withColumn("hi", F.lit(1)).withColumn("prefix", F.lit("clash"))
    once = exactly_once(df)
    assert once.columns == df.columns
    kept = values(once.select("log_offset"))
    assert kept == values(first_deliveries(df))
    assert len(kept) + len(brute(rows)) == df.where(has_key()).count()


def test_empty_and_keyless(spark):
    assert values(redeliveries(usage(spark, []))) == []
    assert values(redeliveries(usage(spark, [{"idempotency_key": None}, {"idempotency_key": ""}] * 2))) == []


def test_equal_times_and_repeated_rows(spark):
    rows = [{"idempotency_key": "a"}] * 5
    assert ids(redeliveries(usage(spark, rows), 3)) == [1, 2, 3, 4]


def test_runs_merge_and_a_retry_changes_nothing(spark):
    rows = [{"idempotency_key": f"k{i % 40}", "received_at": NOON + timedelta(seconds=i)} for i in range(120)]
    index = IdentifierIndex(spark, scratch(spark, "index"), 4, fan_in=2)
    seen = []
    for batch in batches_by_arrival(usage(spark, rows), 4):
        index.ingest(candidates(batch))
        seen.append(index.runs())
    assert seen == [[(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3)]]  # by levels: what is merged once is merged again only with its like
    assert index.read().count() == index.read().select("prefix").distinct().count()  # one array a prefix
    before = ids(index.kept())
    index.ingest(candidates(usage(spark, rows)))
    assert ids(index.kept()) == before == list(range(40))


def test_a_superseded_or_unfinished_run_is_not_read(spark):
    index = index_of(usage(spark, [{"idempotency_key": f"k{i}"} for i in range(10)]), 1)
    index.read().write.parquet(f"{index.path}/{index._name((1, 1))}")
    assert index.runs() == [(0, 0), (1, 1)]
    index._files.delete(f"{index._name((1, 1))}/_SUCCESS")
    assert index.runs() == [(0, 0)]


def test_binary_search_goes_on_among_equal_first_halves():
    hi, lo = np.array([1, 5, 5, 5, 9]), np.array([7, 1, 2, 3, 7])
    assert contains(hi, lo, np.array([5, 5, 5, 0, 10, 9, 1]), np.array([3, 4, 1, 0, 0, 7, 7])).tolist() == [True, False, True, False, False, True, True]


def test_prefix_follows_the_number_of_identifiers():
    assert prefix_bits(0) == 6 and prefix_bits(10**9) == 16 and prefix_bits(10**12) == 26


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_index_is_searched_where_it_lies(spark):
    rows = [{"idempotency_key": f"k{i}"} for i in range(400)]
    index = index_of(usage(spark, rows), 1)
    index.ingest(candidates(usage(spark, [{"idempotency_key": f"n{i}", "log_offset": 1000 + i} for i in range(50)])))
    assert len(index.runs()) == 2
    batch = index._prefixed(candidates(usage(spark, rows[:1])))
    known = index.touched(candidates(usage(spark, rows[:1])))
    text = plan(batch.groupBy("prefix").cogroup(known.groupBy("prefix")).applyInArrow(_novel, RUN))
    assert text.count("Exchange hashpartitioning(prefix") == 1 and len(re.findall("SelectedBucketsCount: [12] out of 8", text)) == 2  # only the batch is shuffled by prefix
    merged = index.read().groupBy("prefix").applyInArrow(_merged, RUN)
    assert "Exchange" not in plan(merged)
    assert merged.count() == index.read().select("prefix").distinct().count() and merged.agg(F.sum("n")).first()[0] == 450
    assert known.select("prefix").distinct().count() == 1


def test_another_layout_is_refused_or_migrated(spark):
    rows = usage(spark, [{"idempotency_key": f"k{i}"} for i in range(300)])
    index = index_of(rows, 1)
    assert IdentifierIndex(spark, index.path).bits == index.bits == 6
    with pytest.raises(ValueError, match="6 bits, not 7"):
        IdentifierIndex(spark, index.path, 7)
    before = ids(index.kept())
    index.resplit(8)
    again = IdentifierIndex(spark, index.path, 8)
    assert ids(again.kept()) == before and again.runs() == [(0, 0)]
    assert again.read().where(F.size("hi") > 0).agg(F.max("prefix")).first()[0] > 63
    again.ingest(candidates(rows))
    assert ids(again.kept()) == before


def test_an_index_that_grows_gets_more_bits(spark, monkeypatch):
    monkeypatch.setattr(module, "PER_PREFIX", 1)
    index = IdentifierIndex(spark, scratch(spark, "index"), 2, fan_in=2)
    for k in range(2):
        index.ingest(candidates(usage(spark, [{"idempotency_key": f"k{k}-{i}", "log_offset": 100 * k + i} for i in range(40)])))
    assert index.bits == 7 and len(ids(index.kept())) == 80
    index.ingest(candidates(usage(spark, [{"idempotency_key": "k1-3", "log_offset": 500}, {"idempotency_key": "new", "log_offset": 501}])))
    assert [k for k in ids(index.kept()) if k > 200] == [501]
