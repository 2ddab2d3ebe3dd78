import random

from tallymill.llm.seen_before import KeyHistory, answer, audit, error_rates, first_requests, history_of, identifiers, seen_before, seen_in_batches
from tallymill.session import scratch

SCHEMA = "tenant_id string, idempotency_key string"


def tables(spark, n, seed):
    r = random.Random(seed)
    key = lambda: (r.choice(["a", "A", "a ", None, ""]), r.choice([None, "", *[f"k{r.randrange(n)}"] * 4]))
    hot = ("a", "hot")
    old = [key() for _ in range(n)] + [("b", "only stored")]
    new = [(k, *(hot if r.random() < 0.34 else key())) for k in range(n)] + [(None, "a", "k1"), (n, "b", "only stored"), (n + 1, "b", "new"), (n + 2, "b", "new")]
    r.shuffle(new)
    return spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, f"request_id bigint, {SCHEMA}"), old, new


def test_equals_brute_force(spark):
    stored, requests, old, new = tables(spark, 400, 1)
    seen, want = {x for x in old if x[1]}, []
    for k, t, key in sorted((x for x in new if x[0] is not None and x[2]), key=lambda x: x[0]):
        if (t, key) in seen:
            want.append(k)
        seen.add((t, key))
    for rice in (1, 10):  # with one bit nearly every answer of the sets is wrong; the result isn't
        got = seen_before(requests, [stored.limit(0), stored], rice)
        assert sorted(r[0] for r in got.collect()) == want
    for batches in (1, 3):
        assert sorted(r[0] for r in seen_in_batches(requests.where("request_id is not null"), [stored], batches).collect()) == want


def test_empty_tables(spark):
    stored, requests, _, _ = tables(spark, 20, 2)
    assert seen_before(requests.limit(0), [stored]).count() == 0
    fresh = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", None)], f"request_id bigint, {SCHEMA}")
    assert [r[0] for r in seen_before(fresh, [stored.limit(0)]).collect()] == [2]
    rates = error_rates(fresh, [stored.limit(0)]).first()
    assert rates["keys"] == 0 and rates["probes"] == rates["absent"] == 1 and rates["false_positives"] == 0


def test_rates(spark):
    stored = spark.range(3000).selectExpr("'t' as tenant_id", "cast(id as string) as idempotency_key")
    requests = spark.range(6000).selectExpr("id as request_id", "'t' as tenant_id", "cast(id as string) as idempotency_key", "1 as hi", "2 as shard")
    r = error_rates(requests, [stored], 4).first()
    assert (r["probes"], r["absent"], r["false_negatives"]) == (6000, 3000, 0)
    assert abs(r["audited_rate"] / r["theoretical_rate"] - 1) < 0.35
    assert seen_before(requests, [stored], 4).count() == 3000


def test_the_sets_alone_answer_at_their_rate(spark):
    stored = spark.range(4000).selectExpr("'t' as tenant_id", "cast(id as string) as idempotency_key")
    requests = spark.range(8000).selectExpr("id as request_id", "'t' as tenant_id", "cast(id as string) as idempotency_key")
    history = history_of([stored], 3)
    said = {r[0] for r in answer(requests, history, exact=False).collect()}
    assert set(range(4000)) <= said and 4000 * 0.05 < len(said) - 4000 < 4000 * 0.13  # one in twelve
    assert {r[0] for r in answer(requests, history).collect()} == set(range(4000))
    assert audit(requests, [stored]).collect() == [(8000, 4000, 0)]


def test_a_history_stays_and_grows(spark):
    key = lambda low, high: spark.range(low, high).selectExpr("'t' as tenant_id", "cast(id as string) as idempotency_key", "id as request_id")
    path = scratch(spark, "history")
    KeyHistory(spark, path, 1000).add(identifiers(key(0, 300)))
    again = KeyHistory(spark, path)
    for k in range(1, 4):
        again.add(identifiers(key(k * 300 - 50, k * 300 + 300)))
    assert sorted(r[0] for r in answer(key(1100, 1300), KeyHistory(spark, path)).collect()) == list(range(1100, 1200))
    assert again.sets().agg({"n": "sum"}).first()[0] == 1200  # what is held already isn't coded again
    text = again.ask(first_requests(key(0, 10)))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(prefix") == 1 and text.count("Bucketed: true") == len(again.exact.runs())  # only the probes are shuffled
