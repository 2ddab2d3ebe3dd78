import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import packing
from tallymill.llm.packing import best_fit, best_fit_counts, pack, token_counter, utilisation, violations


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 80))
def test_best_fit_against_a_plain_search(sizes, capacity):
    place = best_fit(sizes, capacity)
    rooms = []
    bins = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - sizes[i])
    for i, b in enumerate(place):
        bins[b] = bins.get(b, 0) + sizes[i]
    assert all(v <= capacity for v in bins.values())
    assert sorted(capacity - v for v in bins.values()) == sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60), st.integers(1, 40)), max_size=40), st.integers(60, 90))
def test_best_fit_on_counts_is_best_fit(items, capacity):
    merged = Counter()
    for child, weight, n in items:
        merged[child, weight] += n
    items = [(c, w, n) for (c, w), n in merged.items()]
    placed, bins = best_fit_counts(items, capacity)
    load, seen = Counter(), Counter()
    for p in placed:
        assert p.low == seen[p.child, p.weight]  # numbers without gaps
        seen[p.child, p.weight] = p.high
        for k in range(p.low, p.high):
            load[p.bin + (k - p.low) // p.per] += p.weight
    assert seen == merged
    sizes = sorted((w for _, w, n in items for _ in range(n)), reverse=True)
    plain = Counter()
    for size, b in zip(sizes, best_fit(sizes, capacity), strict=True):
        plain[b] += size
    assert sorted(load.values()) == sorted(plain.values())
    at = 0
    for first, n, weight in bins:
        assert first == at and all(load[b] == weight for b in range(first, first + n))
        at += n
    assert at == len(load)


def test_a_billion_equal_containers_are_one_number():
    placed, bins = best_fit_counts([(0, 300, 10**9), (1, 100, 7)], 512)
    assert bins == [(0, 3, 500), (3, 1, 400), (4, 10**9 - 4, 300)] and len(placed) == 2


@pytest.mark.parametrize("sizes", ["rest", "hot"])
def test_rounds_equal_best_fit_over_all_open_containers(spark, monkeypatch, sizes):
    """However many containers are open, all take part: with all groups in one round the bins are those of best fit over the whole."""
    r = random.Random(3)
    texts = ["a " * (60 if sizes == "hot" and k % 3 else r.randrange(5, 70)) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    monkeypatch.setattr(packing, "token_counter", lambda path: lambda text: len(text) // 2)
    out = pack(docs, spark.createDataFrame([(1, 100)], "target_id int, capacity_tokens int")).collect()
    load = Counter()
    for x in out:
        load[x["container_id"]] += x["tokens"]
    parts = docs.rdd.glom().map(lambda rows: [(x["doc_id"], len(x["text"]) // 2) for x in rows]).collect()
    final, open_ = [], []
    for g, part in enumerate(parts):
        p = packing._Partition(1, 100, g)
        final += Counter(x[2] for x in p.pack(part))
        open_ += [w for w, _ in p.open]
    whole = Counter()
    for w, b in zip(sorted(open_, reverse=True), best_fit(sorted(open_, reverse=True), 100), strict=True):
        whole[b] += w
    assert len(load) == len(set(final)) + len(whole) and sum(load.values()) == sum(len(t) // 2 for t in texts)
    assert len(out) == 600 and max(load.values()) <= 100


def check(rows, docs, targets):
    load, pieces = defaultdict(int), defaultdict(list)
    for t, c, name, doc, piece, start, tokens in rows:
        load[t, name] += max(tokens, 1)
        assert load[t, name] <= c
        pieces[t, doc].append((piece, start, tokens))
    want = {(t, d) for t, c in targets if c and c > 0 for d in docs}
    assert set(pieces) == want
    for (t, d), own in pieces.items():
        own.sort()
        c = dict(targets)[t]
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert sum(n for _, _, n in own) == docs[d]
        assert len(own) == 1 or docs[d] > c
        at = 0
        for _, start, n in own:
            assert start == at
            at += n


def test_every_document_in_every_capacity(spark):
    count = token_counter(packing.TOKENIZER)
    texts = [None, "", "one", "word " * 37, "Ein Satz. " * 200, "長い文章です。" * 90, *["mail about seat hours " * (k % 40) for k in range(400)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9, "doc_id")
    targets = [(1, 64), (2, 500), (3, 0), (4, None)]
    out = pack(docs, spark.createDataFrame(targets, "target_id int, capacity_tokens int"))
    rows = [tuple(r) for r in out.collect()]
    check(rows, {k: count(t or "") for k, t in enumerate(texts)}, targets)
    for r in utilisation(out).collect():
        assert r["fullest"] <= r["capacity_tokens"] and r["containers"] <= 1.1 * r["lower_bound"] + 1


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.createDataFrame([(k, "token " * (60 if k % 2 else 9)) for k in range(200)], "doc_id bigint, text string").repartition(8)
    out = pack(docs, spark.createDataFrame([(1, 100)], "target_id int, capacity_tokens int"))
    assert out.count() == 200 and out.select("container_id").distinct().count() == 100
    v = violations(out).first()
    assert (v["documents"], v["over_capacity"], v["needless_splits"], v["broken_texts"]) == (200, 0, 0, 0)


def test_violations_are_seen(spark):
    shape = "target_id int, capacity_tokens int, container_id string, doc_id bigint, piece int, token_start bigint, tokens int"
    rows = [(1, 10, "a", 1, 0, 0, 6), (1, 10, "a", 2, 0, 0, 5), (1, 10, "b", 3, 0, 0, 4), (1, 10, "c", 3, 1, 4, 4), (1, 10, "d", 4, 1, 10, 3)]
    v = violations(spark.createDataFrame(rows, shape)).first()
    assert (v["documents"], v["over_capacity"], v["needless_splits"], v["broken_texts"]) == (4, 1, 1, 1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    targets = spark.createDataFrame([(1, 10)], "target_id int, capacity_tokens int")
    assert pack(docs.limit(0), targets).count() == 0
    assert pack(docs, targets.limit(0)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5)] * 3, "doc_id bigint, text string, container string, tokens int")
    out = pack(docs, spark.createDataFrame([(1, 10)] * 2, "target_id int, capacity_tokens int"))
    assert out.count() == 3 and out.select("container_id").distinct().count() == 1


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "ab1. " * 60_000])
def test_very_long_texts_can_be_measured(text):
    assert token_counter(packing.TOKENIZER)(text) > 0
