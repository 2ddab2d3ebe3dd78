"""Exactly one copy of every message that was delivered at least once.

An identifier index in the shared folder holds all identifiers seen so far as immutable *runs*. A run has one row per
hash prefix: the prefix's 128-bit identifiers as sorted arrays, beside the row id of the copy that was kept. Runs are
bucketed by prefix, so they are searched where they lie: each incoming batch is reduced to one candidate per identifier and
shuffled by prefix to the runs' buckets, of which only those it touches are read; what no run holds is novel and becomes the
next run. When ``fan_in`` runs of one level stand last they are merged into one of the next, so an identifier is written
once a level and a batch searches at most ``fan_in - 1`` arrays a level.

How identifiers are laid out (bits of the prefix, buckets) is stored with them: an index that is opened again keeps its
layout, and other bits are refused. An index whose prefixes have grown past four times ``PER_PREFIX`` is laid out anew with
more bits; readers see the old runs or the new ones, never both.

Batches must come in order of arrival (``batches_by_arrival`` cuts a table so); then the copy that is kept is that with
the earliest ``received_at``, and among equals the smallest row id, over all batches.

Nulls: rows whose key is null or empty have no identifier and take no part. A null tenant is a tenant of its own. A null
``received_at`` comes after all others. A row without row id can't be named and takes no part. An empty table gives an
empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.keys import delivery_order, has_key, id_hi, id_lo, offset_in
from tallymill.session import SharedFiles, bucketed, scratch

#: Identifiers that one prefix should hold at most, on average: 16 Ki of them are 384 KB of arrays.
PER_PREFIX = 16_384
#: Prefixes that share a bucket; buckets that an index has at least and at most.
PER_BUCKET, FEWEST, MOST = 8, 8, 8192
#: Prefixes up to which a batch names those it touches, so that no other bucket is read.
NAMED = 4096
RUN = "prefix int, n int, hi array<bigint>, lo array<bigint>, row_id array<bigint>"
_RUN_ARROW = pa.schema([("prefix", pa.int32()), ("n", pa.int32()), ("hi", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("row_id", pa.list_(pa.int64()))])

#: A run of an index that keeps a value beside each identifier.
VALUED = f"{RUN}, value array<binary>"
_VALUED_ARROW = _RUN_ARROW.append(pa.field("value", pa.list_(pa.binary())))


def prefix_bits(identifiers: int) -> int:
    """Bits of the hash prefix at which at most ``PER_PREFIX`` of so many identifiers share a prefix on average; 6 at least."""
    return min(31, max(6, math.ceil(math.log2(max(1, identifiers) / PER_PREFIX))))


def contains(run_hi: np.ndarray, run_lo: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Binary search of the identifiers (hi, lo) in one run sorted by (hi, lo)."""
    found = np.zeros(len(hi), bool)
    at = np.searchsorted(run_hi, hi)
    open_ = np.flatnonzero(at < len(run_hi))
    while len(open_):
        open_ = open_[run_hi[at[open_]] == hi[open_]]
        hit = run_lo[at[open_]] == lo[open_]
        found[open_[hit]] = True
        open_ = open_[~hit]  # equal first halves: go on to the next entry
        at[open_] += 1
        open_ = open_[at[open_] < len(run_hi)]
    return found


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A list column as numpy arrays, one per row."""
    return [x.values.to_numpy(zero_copy_only=False) for chunk in column.chunks for x in chunk]


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _run_row(prefix: int, hi: np.ndarray, lo: np.ndarray, rest: list[pa.Array]) -> pa.Table:
    """A run's row: the identifiers and the columns beside them as lists."""
    schema = _VALUED_ARROW if len(rest) > 1 else _RUN_ARROW
    if not len(hi):
        return schema.empty_table()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(hi)], pa.int32()), x) for x in (pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *rest)]
    return pa.Table.from_arrays([pa.array([prefix], pa.int32()), pa.array([len(hi)], pa.int32()), *lists], schema=schema)


def _beside(table: pa.Table) -> list[pa.ChunkedArray]:
    return [table.column(c) for c in ("row_id", "value") if c in table.column_names]


def _first_run(batch: pa.Table, runs: pa.Table | None = None) -> pa.Table:
    """The run of the batch's identifiers that none of the runs holds."""
    if not batch.num_rows:
        return (_VALUED_ARROW if "value" in batch.column_names else _RUN_ARROW).empty_table()
    hi, lo = _flat(batch, "hi"), _flat(batch, "lo")
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    seen = np.zeros(len(hi), bool)
    if runs is not None:
        for run_hi, run_lo in zip(_arrays(runs.column("hi")), _arrays(runs.column("lo")), strict=True):
            seen |= contains(run_hi, run_lo, hi, lo)
    rest = [c.take(pa.array(order[~seen])).combine_chunks() for c in _beside(batch)]
    return _run_row(batch.column("prefix")[0].as_py(), hi[~seen], lo[~seen], rest)


def _novel(batch: pa.Table, runs: pa.Table) -> pa.Table:
    return _first_run(batch, runs)


def _whole(batch: pa.Table) -> pa.Table:
    return _first_run(batch)


def _joined(lists: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([chunk.flatten() for chunk in lists.chunks])


def _merged(runs: pa.Table) -> pa.Table:
    hi, lo, *rest = [_joined(runs.column(c)) for c in ("hi", "lo", "row_id", *(["value"] if "value" in runs.column_names else []))]
    hi, lo = hi.to_numpy(zero_copy_only=False), lo.to_numpy(zero_copy_only=False)
    order = np.lexsort((lo, hi))
    return _run_row(runs.column("prefix")[0].as_py(), hi[order], lo[order], [c.take(pa.array(order)) for c in rest])


def _found(keys: pa.Table, runs: pa.Table) -> pa.Table:
    """The keys that a run holds, with what stands beside them there."""
    out = []
    for r in range(runs.num_rows if keys.num_rows else 0):
        hi, lo, row, value = (runs.column(c)[r].values for c in ("hi", "lo", "row_id", "value"))
        run = _run_ids(hi, lo)
        at = np.minimum(np.searchsorted(run, ids := _run_ids(keys.column("hi"), keys.column("lo"))), len(run) - 1)
        hit = np.flatnonzero(run[at] == ids)
        place = pa.array(at[hit])
        out.append(pa.table({"hi": keys.column("hi").take(pa.array(hit)), "lo": keys.column("lo").take(pa.array(hit)), "row_id": row.take(place), "value": value.take(place)}))
    return pa.concat_tables(out) if out else pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("row_id", pa.int64()), ("value", pa.binary())]).empty_table()


def _run_ids(hi, lo) -> np.ndarray:
    """Identifiers as pairs that sort by (hi, lo)."""
    pairs = np.empty(len(hi), [("hi", np.int64), ("lo", np.int64)])
    pairs["hi"], pairs["lo"] = hi.to_numpy(), lo.to_numpy()
    return pairs


class IdentifierIndex:
    """Immutable runs below one path of the shared folder, named by the span of batches they hold.

    ``bits`` is for a new index; one that exists has its own, and another number is an error. With ``valued``, batches have a binary column ``value``
    that is kept beside each identifier. ``live`` are the runs that count where the caller commits them; else those that were written whole.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int | None = None, fan_in: int = 3, valued: bool = False, live: list[tuple[int, int]] | None = None):
        self.spark, self.path, self.fan_in, self.valued, self.live = spark, path, fan_in, valued, live
        self._files = SharedFiles(spark, path)
        if (layout := self._layout()) is None:
            self._files.publish("layout-000000.json", json.dumps({"bits": prefix_bits(0) if bits is None else bits}))
            layout = self._layout()
        if bits not in (None, layout["bits"]):
            raise ValueError(f"the index has {layout['bits']} bits, not {bits}")

    def _layout(self) -> dict | None:
        """The latest layout: its number and bits."""
        names = [n for n in self._files.names() if re.fullmatch(r"layout-\d+\.json", n)]
        return {"number": int(names[-1][7:13]), **json.loads(self._files.read(names[-1]))} if names else None

    @property
    def bits(self) -> int:
        return self._layout()["bits"]

    @property
    def _buckets(self) -> int:
        return min(MOST, max(FEWEST, (1 << self.bits) // PER_BUCKET))

    def runs(self) -> list[tuple[int, int]]:
        """Spans of the live runs. Only committed runs count, and a merged run stands for those within its span."""
        if self.live is not None:
            return self.live
        folder = f"runs-{self._layout()['number']:06d}"
        names = SharedFiles(self.spark, f"{self.path}/{folder}").names()
        spans = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"(\d+)-(\d+)", n)) and self._files.exists(f"{folder}/{n}/_SUCCESS")]
        return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))

    def _name(self, span: tuple[int, int], number: int | None = None) -> str:
        return f"runs-{self._layout()['number'] if number is None else number:06d}/{span[0]:06d}-{span[1]:06d}" + "".join(f"-{tag}" for tag in span[2:])

    def _span(self, low: int, high: int) -> tuple:
        """A new run's name. Where the caller commits runs, each attempt writes one of its own, so that no other attempt can change it."""
        return (low, high) if self.live is None else (low, high, uuid.uuid4().hex[:12])

    @property
    def _schema(self) -> str:
        return VALUED if self.valued else RUN

    def _table(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.table(bucketed(self.spark, f"{self.path}/{self._name(span)}", self._schema, "prefix", self._buckets))

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        rows.write.insertInto(bucketed(self.spark, f"{self.path}/{self._name(span)}", self._schema, "prefix", self._buckets), overwrite=True)
        if self.live is not None:
            self.live = sorted([s for s in self.live if not (span[0] <= s[0] and s[1] <= span[1])] + [span])

    def read(self, spans: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """The live runs, or None before the first batch.

        The filter, which lets every row pass, keeps the union from being executed column-wise, where Spark 4.1 plans it as bucketed but doesn't align the
        buckets. It isn't on ``prefix``, as a column that a filter shows not to be null no longer counts as the one the scan is bucketed by.
        """
        out = None
        for span in self.runs() if spans is None else spans:
            run = self._table(span).where("n >= 0")
            out = run if out is None else out.unionAll(run)
        return out

    def _prefixed(self, batch: DataFrame) -> DataFrame:
        return batch.select(self._prefix(), "hi", "lo", "row_id", *(["value"] if self.valued else []))

    def _prefix(self) -> Column:
        return F.shiftrightunsigned("hi", 64 - self.bits).cast("int").alias("prefix")

    def touched(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the live runs under the prefixes of ``keys`` (hi); other buckets aren't read if the prefixes are few enough to be named."""
        runs = self.read()
        if runs is None:
            return None
        named = [r[0] for r in keys.select(self._prefix()).distinct().limit(NAMED + 1).collect()]
        return runs.where(F.col("prefix").isin([*named, -1])) if len(named) <= NAMED else runs  # two values at least: equality would show the prefix not to be null, see read

    def ingest(self, batch: DataFrame, keys: DataFrame | None = None) -> None:
        """Add a batch of (hi, lo, row_id), at most one row per identifier, if it isn't there from an earlier try. ``keys`` (hi) may tell more cheaply which prefixes it touches."""
        self.add(batch, keys)
        self.tidy()

    def add(self, batch: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """Like ``ingest``, without merging runs afterwards; the run of what was new."""
        runs, known = self.runs(), self.touched(batch if keys is None else keys)
        by_prefix = self._prefixed(batch).groupBy("prefix")
        novel = by_prefix.applyInArrow(_whole, self._schema) if known is None else by_prefix.cogroup(known.select("prefix", "hi", "lo").groupBy("prefix")).applyInArrow(_novel, self._schema)
        number = runs[-1][1] + 1 if runs else 0
        span = self._span(number, number)
        self._write(novel, span)
        return self._table(span)

    def append(self, batch: DataFrame) -> None:
        """Add a batch of identifiers of which the caller knows that no run holds them."""
        runs = self.runs()
        number = runs[-1][1] + 1 if runs else 0
        self._write(self._prefixed(batch).groupBy("prefix").applyInArrow(_whole, self._schema), self._span(number, number))
        self.tidy()

    def _level(self, span: tuple[int, int]) -> int:
        level, size = 0, span[1] - span[0] + 1
        while size >= self.fan_in:
            level, size = level + 1, size // self.fan_in
        return level

    def tidy(self) -> None:
        """Merge while ``fan_in`` runs of one level stand last; lay out anew what has outgrown its prefixes."""
        while len(last := self.runs()[-self.fan_in :]) == self.fan_in and len({self._level(s) for s in last}) == 1:
            self.merge(last)
            if self.live is None and self.outgrown(held := self.held()):
                self.resplit(prefix_bits(held))

    def held(self) -> int:
        """How many identifiers the live runs hold."""
        runs = self.read()
        return 0 if runs is None else runs.agg(F.sum("n")).first()[0] or 0

    def outgrown(self, held: int) -> bool:
        return held > 4 * PER_PREFIX << self.bits

    def rows(self) -> DataFrame | None:
        """(hi, lo, row_id and value, if kept) of the live runs."""
        runs = self.read()
        columns = ["hi", "lo", "row_id", *(["value"] if self.valued else [])]
        return runs if runs is None else runs.select(F.explode(F.arrays_zip(*columns)).alias("x")).select("x.*")

    def merge(self, runs: list[tuple[int, int]] | None = None) -> None:
        """Merge neighbouring runs, all if none are named, into one, bucket by bucket. The old ones go only when the new one is committed."""
        runs = self.runs() if runs is None else runs
        if len(runs) < 2:
            return
        self._write(self.read(runs).groupBy("prefix").applyInArrow(_merged, self._schema), self._span(runs[0][0], runs[-1][1]))
        if self.live is None:
            self.drop(runs)

    def drop(self, spans: list[tuple[int, int]]) -> None:
        """Delete runs that no longer count."""
        for span in spans:
            self._files.delete(self._name(span))

    def resplit(self, bits: int) -> None:
        """Lay all runs out under prefixes of ``bits`` bits. The new layout counts once its run is whole; then the old one goes."""
        runs, old, number = self.runs(), self.rows(), self._layout()["number"]
        new = IdentifierIndex.__new__(IdentifierIndex)
        new.spark, new.path, new.fan_in, new.valued, new.live, new._files = self.spark, self.path, self.fan_in, self.valued, None, self._files
        new._layout = lambda: {"number": number + 1, "bits": bits}
        if old is not None:
            new._write(new._prefixed(old).groupBy("prefix").applyInArrow(_whole, self._schema), (runs[0][0], runs[-1][1]))
        self._files.publish(f"layout-{number + 1:06d}.json", json.dumps({"bits": bits}))
        self._files.delete(f"runs-{number:06d}")

    def lookup(self, keys: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(hi, lo, row_id, value) of those of ``keys`` (hi, lo), unique, that a valued index holds. ``rows`` (hi) may tell more cheaply which prefixes they touch."""
        known, shape = self.touched(keys if rows is None else rows), "hi bigint, lo bigint, row_id bigint, value binary"
        if known is None:
            return self.spark.createDataFrame([], shape)
        return keys.select(self._prefix(), "hi", "lo").groupBy("prefix").cogroup(known.select("prefix", "hi", "lo", "row_id", "value").groupBy("prefix")).applyInArrow(_found, shape)

    def kept(self) -> DataFrame:
        """(row_id) of every copy that was kept."""
        runs = self.read()
        return self.spark.createDataFrame([], "row_id bigint") if runs is None else runs.select(F.explode("row_id").alias("row_id"))


def candidates(events: DataFrame, row_id: str = "log_offset", received: str = "received_at") -> DataFrame:
    """(hi, lo, row_id): of each identifier the earliest copy. Partial aggregation thins hot keys before the shuffle."""
    return (
        events.where(has_key() & F.col(row_id).isNotNull())
        .select(id_hi("tenant_id", "idempotency_key").alias("hi"), id_lo("tenant_id", "idempotency_key").alias("lo"), delivery_order(received, row_id).alias("o"))
        .groupBy("hi", "lo")
        .agg(F.min("o").alias("o"))
        .select("hi", "lo", offset_in("o").alias("row_id"))
    )


def batches_by_arrival(events: DataFrame, batches: int, received: str = "received_at") -> Iterator[DataFrame]:
    """Cut ``events`` at quantiles of arrival into about equal batches; equal times stay together, nulls come last."""
    micros = F.unix_micros(F.col(received))
    cuts = sorted(set(events.agg(F.percentile_approx(micros, [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    clock = F.col(received)
    at = [F.timestamp_micros(F.lit(c)) for c in cuts]
    for i in range(len(cuts) + 1):
        low = clock > at[i - 1] if i else F.lit(True)
        high = (clock <= at[i]) if i < len(cuts) else F.lit(True)
        part = low & high
        yield events.where(part | clock.isNull() if i == len(cuts) else part)


def index_of(events: DataFrame, batches: int = 3, path: str | None = None) -> IdentifierIndex:
    """Ingest all of ``events``, batch by batch in order of arrival, into a new index."""
    spark = events.sparkSession
    index = IdentifierIndex(spark, path or scratch(spark, "identifiers"), prefix_bits(events.count()))
    for batch in batches_by_arrival(events, batches):
        index.ingest(candidates(batch), batch.where(has_key()).select(id_hi("tenant_id", "idempotency_key").alias("hi")))
    return index


def redeliveries(events: DataFrame, batches: int = 3, row_id: str = "log_offset") -> DataFrame:
    """(row_id) of every row that has a key and isn't the kept copy of its message.

    Row ids are unique, so this anti-join has no hot key even if one message makes up a third of all rows.
    """
    kept = index_of(events, batches).kept().withColumnRenamed("row_id", row_id)
    return events.where(has_key() & F.col(row_id).isNotNull()).select(row_id).join(kept, row_id, "left_anti")


def exactly_once(events: DataFrame, batches: int = 3, row_id: str = "log_offset") -> DataFrame:
    """The kept copy of each message, with all its columns."""
    kept = index_of(events, batches).kept().withColumnRenamed("row_id", row_id)
    return events.where(has_key()).join(kept, row_id, "left_semi")


def first_deliveries(events: DataFrame, row_id: str = "log_offset", received: str = "received_at") -> DataFrame:
    """(row_id) of the kept copy of each message of one closed table, where no index has to outlive the query."""
    return candidates(events, row_id, received).select(F.col("row_id").alias(row_id))
