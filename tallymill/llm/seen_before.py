"""Has this key been seen before? Golomb-coded sets over billions of keys, with audited error rates.

A ``KeyHistory`` holds what was seen, in the shared folder and for as long as that lasts. Keys are 128-bit identifiers,
sharded by hash prefix. Each addition becomes a run: one Golomb-coded set a shard, of about 13 bits a key, in blocks that
decode on their own. The sets answer: probes are shuffled to the shards, whose sets are bucketed and read where they lie; only
probed blocks are decoded. A set never misses a key it holds, and takes another for one of its keys at the stated rate.

The exact identifiers are kept apart, as the identifier index of repeated messages keeps them. They aren't needed for
answers: they tell an addition which keys are new, and where wrong answers aren't wanted they check the positives, and only
these, again where they lie. The same check audits the rate.

Requests are reduced to one probe per key, its first, which also answers "an earlier request": a later request of the same
key isn't that first one. No step groups by key or tenant without thinning first: a key that makes up a third of the rows is
one probe, and rows are matched to answers by their unique request_id. Rows with null or empty key have no answer and don't
appear; a null tenant is a tenant of its own; rows with null request_id don't appear. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.keys import has_key, id_hi, id_lo
from tallymill.llm.golomb import GolombSet, contains, encode, range_per_key
from tallymill.operators import dedup_index
from tallymill.operators.dedup_index import IdentifierIndex, prefix_bits
from tallymill.session import SharedFiles, bucketed, scratch, written

RICE = 10
SETS = "prefix int, rice int, n bigint, size bigint, bits bigint, first array<bigint>, at array<bigint>, code binary"
_SETS_ARROW = pa.schema([("prefix", pa.int32()), ("rice", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("bits", pa.int64()), ("first", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("code", pa.binary())])
PROBED = "hi bigint, lo bigint, request_id bigint, seen boolean"


def identifiers(df: DataFrame) -> DataFrame:
    """(hi, lo) of each row with a key."""
    return df.where(has_key()).select(id_hi("tenant_id", "idempotency_key").alias("hi"), id_lo("tenant_id", "idempotency_key").alias("lo"))


def first_requests(requests: DataFrame) -> DataFrame:
    """(hi, lo, request_id): of each key the first request."""
    rows = requests.where(F.col("request_id").isNotNull() & has_key())
    return rows.select(id_hi("tenant_id", "idempotency_key").alias("hi"), id_lo("tenant_id", "idempotency_key").alias("lo"), "request_id").groupBy("hi", "lo").agg(F.min("request_id").alias("request_id"))


def _coder(rice: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, lo in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = encode(lo.values.to_numpy(zero_copy_only=False), rice)
                rows.append({"prefix": prefix, "rice": rice, "n": s.n, "size": s.size, "bits": s.bits, "first": s.first.view(np.int64), "at": s.at, "code": s.code.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SETS_ARROW)

    return code


def _answered(probes: pa.Table, seen: np.ndarray) -> pa.Table:
    return pa.table({"hi": probes.column("hi"), "lo": probes.column("lo"), "request_id": probes.column("request_id"), "seen": pa.array(seen)})


def _by_sets(probes: pa.Table, sets: pa.Table) -> pa.Table:
    hit = np.zeros(probes.num_rows, bool)
    for r in range(sets.num_rows if probes.num_rows else 0):
        x = {c: sets.column(c)[r] for c in ("rice", "n", "size", "first", "at", "code")}
        first, at = (x[c].values.to_numpy(zero_copy_only=False) for c in ("first", "at"))
        s = GolombSet(x["n"].as_py(), x["size"].as_py(), x["rice"].as_py(), first.view(np.uint64), at, np.frombuffer(x["code"].as_py(), np.uint8))
        hit |= contains(s, probes.column("lo").to_numpy())
    return _answered(probes, hit)


def _by_keys(probes: pa.Table, runs: pa.Table) -> pa.Table:
    hit = np.zeros(probes.num_rows, bool)
    for hi, lo in zip(*(dedup_index._arrays(runs.column(c)) for c in ("hi", "lo")), strict=True) if probes.num_rows else ():
        hit |= dedup_index.contains(hi, lo, probes.column("hi").to_numpy(), probes.column("lo").to_numpy())
    return _answered(probes, hit)


class KeyHistory:
    """All keys seen so far below one path of the shared folder: the coded sets that answer, and apart from them the exact identifiers."""

    def __init__(self, spark: SparkSession, path: str, keys: int | None = None, rice: int = RICE, fan_in: int = 3):
        """``keys`` is about how many a new history will hold; one that exists has its layout."""
        self.spark, self.path, self.rice = spark, path, rice
        exists = SharedFiles(spark, f"{path}/keys").names()
        self.exact = IdentifierIndex(spark, f"{path}/keys", None if exists else prefix_bits(keys or 0), fan_in)

    def _set_table(self, name: str) -> str:
        return bucketed(self.spark, f"{self.path}/sets/{name}", SETS, "prefix", self.exact._buckets)

    def _names(self) -> list[str]:
        """The names of the live runs: those of the exact identifiers, which are coded one by one."""
        return [re.sub(r"\W", "-", self.exact._name(span)) for span in self.exact.runs()]

    def add(self, keys: DataFrame) -> None:
        """Add identifiers (hi, lo); those already held change nothing. Sets are coded where the new identifiers lie; those of merged runs are coded anew."""
        self.exact.ingest(keys.distinct().withColumn("row_id", F.lit(0).cast("bigint")), keys)
        self._code()

    def _code(self) -> None:
        """Code the sets of every run that has none yet, and drop those of runs that are no more."""
        files = SharedFiles(self.spark, f"{self.path}/sets")
        for span, name in zip(self.exact.runs(), self._names(), strict=True):
            if not files.exists(f"{name}/_SUCCESS"):
                self.exact._table(span).select("prefix", "lo").mapInArrow(_coder(self.rice), SETS).write.insertInto(self._set_table(name), overwrite=True)
        live = set(self._names())
        for name in files.names():
            if name not in live:
                files.delete(name)

    def sets(self) -> DataFrame | None:
        """The coded sets of the live runs, None before anything was added."""
        out = None
        for name in self._names():
            run = self.spark.table(self._set_table(name)).where("n >= 0")  # see IdentifierIndex.read
            out = run if out is None else out.unionAll(run)
        return out

    def ask(self, probes: DataFrame) -> DataFrame:
        """(hi, lo, request_id, seen): what the sets say; never false for a key that was added."""
        sets = self.sets()
        if sets is None:
            return probes.select("hi", "lo", "request_id", F.lit(False).alias("seen"))
        theirs = sets.select("prefix", "rice", "n", "size", "first", "at", "code").groupBy("prefix")
        return probes.select(self.exact._prefix(), "hi", "lo", "request_id").groupBy("prefix").cogroup(theirs).applyInArrow(_by_sets, PROBED)

    def check(self, probes: DataFrame) -> DataFrame:
        """(hi, lo, request_id, seen): the truth, by binary search in the exact identifiers."""
        known = self.exact.read()
        if known is None:
            return probes.select("hi", "lo", "request_id", F.lit(False).alias("seen"))
        return probes.select(self.exact._prefix(), "hi", "lo", "request_id").groupBy("prefix").cogroup(known.select("prefix", "hi", "lo").groupBy("prefix")).applyInArrow(_by_keys, PROBED)


def history_of(earlier: list[DataFrame], rice: int = RICE) -> KeyHistory:
    """A new history of the keys of all tables in ``earlier``."""
    spark = earlier[0].sparkSession
    keys = identifiers(earlier[0])
    for df in earlier[1:]:
        keys = keys.unionAll(identifiers(df))
    history = KeyHistory(spark, scratch(spark, "seen"), sum(df.count() for df in earlier), rice)  # the files' footers bound the keys
    history.add(keys)
    return history


def answer(requests: DataFrame, history: KeyHistory, exact: bool = True) -> DataFrame:
    """(request_id) of each keyed request whose key is in ``history`` or in a request with a smaller id.

    The sets answer. With ``exact``, what they say yes to is checked, so that no answer is wrong; without, yes is wrong at the stated rate.
    """
    asked = written(history.ask(first_requests(requests)), "seen-asked")
    fresh = asked.where("not seen").select("request_id")
    if exact:
        fresh = fresh.unionAll(history.check(asked.where("seen")).where("not seen").select("request_id"))
    return requests.where(F.col("request_id").isNotNull() & has_key()).select("request_id").join(fresh, "request_id", "left_anti")


def seen_before(requests: DataFrame, earlier: list[DataFrame], rice: int = RICE) -> DataFrame:
    """(request_id) of each keyed request whose key occurred in ``earlier`` or in a request with a smaller id."""
    return answer(requests, history_of(earlier, rice))


def seen_in_batches(requests: DataFrame, earlier: list[DataFrame], batches: int = 2) -> DataFrame:
    """The same, as requests come in: each batch, in order of request_id, is answered from the history so far and then added to it."""
    history = history_of(earlier)
    ends = requests.agg(F.min("request_id").alias("a"), F.max("request_id").alias("z")).first()
    if ends["a"] is None:
        return requests.select("request_id").where(F.lit(False))
    cuts = [ends["a"] + (ends["z"] + 1 - ends["a"]) * k // batches for k in range(batches + 1)]
    out = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        batch = requests.where((F.col("request_id") >= low) & (F.col("request_id") < high))
        found = written(answer(batch, history), "seen-batch")
        out = found if out is None else out.unionAll(found)
        if high < cuts[-1]:
            history.add(identifiers(batch))
    return out


def _audited(requests: DataFrame, history: KeyHistory) -> DataFrame:
    """(probes, absent, false_positives, false_negatives) over every probe, positives and negatives."""
    probes = first_requests(requests)
    said, true = history.ask(probes).select("request_id", "seen"), history.check(probes).select("request_id", F.col("seen").alias("held"))
    return said.join(true, "request_id").agg(
        F.count(F.lit(1)).alias("probes"),
        F.count(F.when(~F.col("held"), 1)).alias("absent"),
        F.count(F.when(~F.col("held") & F.col("seen"), 1)).alias("false_positives"),
        F.count(F.when(F.col("held") & ~F.col("seen"), 1)).alias("false_negatives"),
    )


def audit(requests: DataFrame, earlier: list[DataFrame], rice: int = RICE) -> DataFrame:
    """One row: probes, keys among them that were never seen, and keys the sets have missed, which must be none."""
    return _audited(requests, history_of(earlier, rice)).select("probes", "absent", "false_negatives")


def error_rates(requests: DataFrame, earlier: list[DataFrame], rice: int = RICE) -> DataFrame:
    """One row: keys and bits a key of the sets, the rate of wrong answers in theory and as audited over all probes."""
    history = history_of(earlier, rice)
    stored = history.sets().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.coalesce(F.sum("bits") / F.sum("n"), F.lit(0.0)).alias("bits_per_key")).first()
    rates = _audited(requests, history).withColumns({"keys": F.lit(stored["keys"]), "bits_per_key": F.round(F.lit(stored["bits_per_key"]), 3), "theoretical_rate": F.lit(1.0 / range_per_key(rice))})
    return rates.select("keys", "bits_per_key", "probes", "absent", "false_positives", "false_negatives", "theoretical_rate", (F.col("false_positives") / F.nullif(F.col("absent"), F.lit(0))).alias("audited_rate"))
