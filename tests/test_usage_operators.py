import datetime
import random
from collections import Counter, defaultdict
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymill.operators.counted import counted, verdict
from tallymill.operators.late_windows import corrections, late_windows, latest
from tallymill.operators.rolling import rolling
from tallymill.operators.skew import heavy_keys, keys_with_share, skew_aggregate, skew_join
from tests.helpers import NOON, usage, values


def test_cut_offs_are_inclusive(spark):
    edge = [timedelta(days=35), timedelta(days=35, microseconds=1), -timedelta(minutes=5), -timedelta(minutes=5, microseconds=1)]
    rows = usage(spark, [{"occurred_at": NOON - d} for d in edge])
    assert [r[0] for r in rows.orderBy("log_offset").select(verdict()).collect()] == [None, "too_late", None, "too_early"]


def test_reasons(spark):
    bad = [{"idempotency_key": ""}, {"idempotency_key": None}, {"meter": None}, {"occurred_at": None}, {"received_at": None}]
    bad += [{"quantity": q} for q in (None, "", "+1", "-1", ".5", "1.", "1e5", "1.0000000000", "9" * 30, "٣", " 1", "1\n", "1,5")]
    got = [r[0] for r in usage(spark, bad).orderBy("log_offset").select(verdict()).collect()]
    assert got == ["no_key"] * 2 + ["no_meter"] + ["no_time"] * 2 + ["bad_quantity"] * 13
    good = usage(spark, [{"quantity": q} for q in ("0", "0001.5", "9" * 29 + "." + "9" * 9, "0" * 40 + "7")])
    assert [r[0] for r in counted(good).orderBy("log_offset").select("quantity").collect()] == [Decimal(0), Decimal("1.5"), Decimal("9" * 29 + "." + "9" * 9), Decimal(7)]


def test_a_bad_first_delivery_still_is_the_kept_one(spark):
    rows = [{"idempotency_key": "a", "quantity": "bad"}, {"idempotency_key": "a"}]
    assert counted(usage(spark, rows)).count() == 0


def test_late_rows_correct_their_day(spark):
    day = datetime.datetime(2026, 7, 1, 10, tzinfo=datetime.timezone.utc)
    at = lambda d, q: {"occurred_at": day, "received_at": day + timedelta(days=d), "quantity": q}
    events = usage(spark, [at(3, "4"), at(0, "1"), at(1, "2"), at(1, "0.5"), at(36, "9"), {**at(2, "7"), "idempotency_key": "key-1"}]).withColumn("version", F.lit(9))
    got = late_windows(events)
    assert [(r["version"], str(r["arrival_day"]), r["quantity"], r["events"], r["corrections"]) for r in got.upserts.orderBy("version").collect()] == [
        (1, "2026-07-01", Decimal(1), 1, 0),
        (2, "2026-07-02", Decimal("3.5"), 3, 2),
        (3, "2026-07-04", Decimal("7.5"), 4, 3),
    ]
    assert latest(got.upserts).first()["quantity"] == Decimal("7.5")
    assert values(got.diverted.select("log_offset", "reason")) == [(4, "too_late")]
    assert values(corrections(events)) == [(0,), (2,), (3,)]


def test_late_windows_of_nothing(spark):
    got = late_windows(usage(spark, []))
    assert got.upserts.count() == got.diverted.count() == latest(got.upserts).count() == 0


def _skewed(n, seed):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", None, "null", "=hot", f"t{r.randrange(30)}"]), k % 7) for k in range(n)]


def test_skew_aggregate_equals_plain(spark):
    rows = _skewed(500, 1)
    df = spark.createDataFrame(rows, "k string, v int")
    got = skew_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v"), "m": F.max("v")}, {"n": F.sum("n"), "s": F.sum("s"), "m": F.max("m")}, share=0.1)
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert values(got) == sorted(((k, len(v), sum(v), max(v)) for k, v in want.items()), key=repr)


def test_skew_join_equals_plain(spark):
    rows = _skewed(300, 2)
    df = spark.createDataFrame(rows, "k string, v int")
    dim = spark.createDataFrame([("hot", 1), (None, 2), ("t3", 3), ("unused", 4)], "k string, d int")
    pick = {"hot": 1, None: 2, "t3": 3}
    assert values(skew_join(df, dim, "k", 0.1)) == sorted(((k, v, pick.get(k)) for k, v in rows), key=repr)


def test_heavy_keys_are_all_found(spark):
    rows = _skewed(1000, 3)
    df = spark.createDataFrame(rows, "k string, v int")
    n = Counter(k for k, _ in rows)
    assert {r[0] for r in keys_with_share(df, "k", 0.02).collect()} == {k for k, c in n.items() if c * 50 >= 1000}
    heavy, total = heavy_keys(df, "k", 0.1)
    assert total == 1000 and {"=hot", "null"} <= set(heavy) and len(heavy) <= 20


def test_share_is_inclusive_and_empty_is_fine(spark):
    df = spark.createDataFrame([(str(k),) for k in range(50)], "k string")
    assert keys_with_share(df, "k", 1 / 50).count() == 50
    empty = df.limit(0)
    assert keys_with_share(empty, "k", 1 / 50).count() == 0
    assert skew_aggregate(empty, "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).count() == 0


def test_rolling_equals_brute_force(spark):
    r = random.Random(4)
    first, last = datetime.date(2026, 5, 1), datetime.date(2026, 7, 20)
    rows = [(r.choice(["a", None, "b"]), first + timedelta(days=r.randrange(70)), Decimal(r.randrange(10**12)) / 10**9) for _ in range(60)]
    rows += [("a", None, Decimal(1)), ("b", first, None), ("late", last + timedelta(days=1), Decimal(1)), ("a", last, Decimal("0.000000001"))]
    df = spark.createDataFrame(rows, "e string, d date, q decimal(38,9)").withColumn("day", F.lit("clash")).withColumn("total", F.lit(1))
    got = {(x["e"], x["usage_day"]): x for x in rolling(df, ["e"], F.col("d"), F.col("q"), last).collect()}
    totals = defaultdict(lambda: defaultdict(Decimal))
    for e, d, q in rows:
        if d and q is not None and d <= last:
            totals[e][d] += q
    want = 0
    for e, days in totals.items():
        d = min(days)
        while d <= last:
            x = got[e, d]
            for w in (7, 30):
                t = sum((q for at, q in days.items() if 0 <= (d - at).days < w), Decimal(0))
                assert x[f"total_{w}"] == t and abs(x[f"average_{w}"] - t / w) <= Decimal("0.0000000005")
            assert x["quantity"] == days.get(d, 0)
            want, d = want + 1, d + timedelta(days=1)
    assert len(got) == want


def test_rolling_of_the_largest_quantity(spark):
    day = datetime.date(2026, 7, 1)
    df = spark.createDataFrame([("a", day, Decimal("9" * 29 + "." + "9" * 9))], "e string, d date, q decimal(38,9)")
    got = rolling(df, ["e"], F.col("d"), F.col("q"), day + timedelta(days=8)).orderBy("usage_day").collect()
    assert got[0]["total_7"] == Decimal("9" * 29 + "." + "9" * 9) and got[8]["total_7"] == 0


def test_rolling_of_nothing(spark):
    assert rolling(spark.createDataFrame([], "e string, d date, q decimal(38,9)"), ["e"], F.col("d"), F.col("q"), datetime.date(2026, 1, 1)).count() == 0


def test_several_keys_are_one(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", None, "", "1"]), r.choice(["", "1", "a", None]) if r.random() > 0.4 else "hot", k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, m string, v int")
    want = sorted(((*key, n) for key, n in Counter((k, m) for k, m, _ in rows).items()), key=repr)
    assert values(skew_aggregate(df, ["k", "m"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, share=0.1)) == want
    some = spark.createDataFrame(want[::2], "k string, m string, n int").drop("n")
    kept = {x[:2] for x in want[::2]}
    assert values(skew_join(df, some, ["k", "m"], 0.1, how="left_semi")) == sorted((x for x in rows if x[:2] in kept), key=repr)


def test_a_repeated_key_on_the_joined_side_is_an_error(spark):
    facts = spark.createDataFrame([("a", 1)] * 9, "k string, v int")
    with pytest.raises(Exception, match="more than one row per key"):
        skew_join(facts, spark.createDataFrame([("a", 1), ("a", 2)], "k string, d int"), "k", 0.1).collect()


def test_the_share_is_taken_over_both_branches(spark):
    text = keys_with_share(spark.createDataFrame([(f"k{i % 7}",) for i in range(70)], "k string"), "k", 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in text
