"""Draining the log into a table, exactly once, without a transactional store.

Rows and progress become visible in one rename: a micro-batch writes its rows to a file folder that nobody reads yet, then
publishes a manifest ``<from>.json`` that names the folder, the next offset and the batch's statistics. Readers find
rows only through manifests. Manifests, not the stream's checkpoint, say how far a consumer is: a batch is cut at the last
published offset, so replay after a lost checkpoint only counts duplicates and conflicts, and a batch that failed or was
interrupted leaves nothing that anyone sees. One consumer writes one table; others have tables of their own.

Which keys are committed is kept in an identifier index with the fingerprint beside each key. A batch looks up its own keys
in the buckets it touches and adds what it inserts as a run; the manifest names the runs that count, so the index moves with
the rows. A batch therefore costs what it holds, not what the table holds, and needs one manifest, the last. Every
``SNAPSHOT`` manifests the folders so far are listed in one file, so a reader opens few.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallymill.functions.keys import has_key, id_hi, id_lo
from tallymill.operators.classify import classify
from tallymill.operators.dedup_index import IdentifierIndex, prefix_bits
from tallymill.session import SharedFiles, scratch
from tallymill.sources.log_segments import log_end, register
from tallymill.sources.requests import decode_event

ROW = "id bigint, tenant_id string, meter string, quantity decimal(38,9), occurred_at timestamp, received_at timestamp, idempotency_key string, payload_fingerprint binary"
#: Manifests after which the folders so far are listed in one file.
SNAPSHOT = 64
#: Decoded records.
DECODED = "log_offset bigint, tenant_id string, meter string, quantity string, occurred_at timestamp, received_at timestamp, idempotency_key string, fingerprint binary, __undecodable boolean"
LETTER = "log_offset bigint, reason string, tenant_id string, idempotency_key string"


@dataclass
class Stats:
    read: int = 0
    inserted: int = 0
    duplicates: int = 0
    conflicts: int = 0

    def add(self, other: Stats) -> None:
        for name in vars(self):
            setattr(self, name, getattr(self, name) + getattr(other, name))


class Consumer:
    """A named consumer of an event log into the table below ``root/<name>``.

    ``on_poison``: what happens to a row whose quantity is no decimal: ``fail`` fails the batch, which leaves the offset
    where it was; ``quarantine`` sends the row to the dead letters and goes on.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, on_poison: str = "fail"):
        if on_poison not in ("fail", "quarantine"):
            raise ValueError(on_poison)
        self.spark, self.home, self.on_poison = spark, f"{root}/{name}", on_poison
        self._commits = SharedFiles(spark, f"{self.home}/commits")

    def _manifest_names(self) -> list[str]:
        return [n for n in self._commits.names() if n.endswith(".json") and n[0].isdigit()]

    def _last(self) -> dict:
        """The last published manifest; before any, one that says so."""
        names = self._manifest_names()
        return json.loads(self._commits.read(names[-1])) if names else {"next_offset": 0, "index": {"path": "index-0", "runs": [], "held": 0}}

    def manifests(self) -> list[dict]:
        """Published batches in order of their offsets."""
        snapshots, names = [n for n in self._commits.names() if n.startswith("snapshot-")], self._manifest_names()
        known = json.loads(self._commits.read(snapshots[-1])) if snapshots else []
        return known + [json.loads(self._commits.read(n)) for n in names[len(known) :]]

    def next_offset(self) -> int:
        """The offset to be read next; 0 before anything was read. It never moves backwards."""
        return self._last()["next_offset"]

    def _index(self, state: dict) -> IdentifierIndex:
        named = state["index"]
        return IdentifierIndex(self.spark, f"{self.home}/{named['path']}", fan_in=4, valued=True, live=[tuple(r) for r in named["runs"]])

    def rows(self) -> DataFrame:
        """All published rows."""
        return self._read("rows", ROW)

    def dead_letters(self) -> DataFrame:
        """Conflicts, quarantined and undecodable rows with their reasons."""
        conflicts = self._read("conflicting", ROW).select(F.col("id").alias("log_offset"), F.lit("key_reuse").alias("reason"), "tenant_id", "idempotency_key")
        return conflicts.unionByName(self._read("refused", LETTER))

    @staticmethod
    def _decoded(batch: DataFrame) -> DataFrame:
        event = decode_event(F.col("payload").cast("string"))
        return batch.select("log_offset", event.alias("e")).select("log_offset", "e.*", F.col("e").isNull().alias("__undecodable"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [m[kind] for m in self.manifests() if m[kind]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame) -> Stats:
        """Classify one batch of log rows against what is published, and publish the part that is new.

        Rows have the columns of an event, or ``log_offset`` and ``payload`` with the encoded event. What can't be decoded will never be: it is
        counted as read and as conflict, goes to the dead letters and is stepped over.
        """
        if "payload" not in batch.columns:
            return self._apply(batch.withColumn("__undecodable", F.lit(False)))
        # a batch is read several times: records are checked and decoded once
        decoded = scratch(self.spark, "decoded-batch")
        self._decoded(batch).write.parquet(decoded)
        try:
            return self._apply(self.spark.read.schema(DECODED).parquet(decoded))
        finally:
            root, _, name = decoded.rpartition("/")
            SharedFiles(self.spark, root).delete(name)

    def _apply(self, batch: DataFrame) -> Stats:
        state = self._last()
        start, index = state["next_offset"], self._index(state)
        decimal = F.when(F.col("quantity").rlike(r"\A\p{ASCII}*\z"), F.col("quantity").try_cast(T.DecimalType(38, 9)))  # digits of other scripts are none here
        usable = has_key() & decimal.isNotNull()
        poison = has_key() & F.col("quantity").isNotNull() & decimal.isNull()
        new = F.col("log_offset") >= start
        first = lambda c: F.min(F.when(c, F.col("log_offset")))
        count = lambda c: F.count(F.when(c, 1))
        seen = batch.agg(F.count(F.lit(1)).alias("rows"), F.min("log_offset").alias("low"), F.max("log_offset").alias("high"), first(new & poison).alias("poison"), count(new & usable).alias("usable"), count(new & ~usable).alias("unusable")).first()
        if seen["high"] is None:
            return Stats()
        if seen["low"] < 0:
            raise ValueError(f"offset {seen['low']} is negative")
        ids = {"hi": id_hi("tenant_id", "idempotency_key"), "lo": id_lo("tenant_id", "idempotency_key")}
        keys = batch.where(usable).select(*[e.alias(n) for n, e in ids.items()])
        committed = index.lookup(keys.distinct(), keys).select("hi", "lo", F.col("value").alias("payload_fingerprint"))
        replayed = Stats()
        if seen["low"] < start:
            replayed = self._count(classify(batch.where(~new & usable), committed))
            if replayed.inserted:
                raise RuntimeError(f"offsets below {start} that were never applied: the log's files came out of order")
        if seen["high"] < start:
            return replayed
        if self.on_poison == "fail" and seen["poison"] is not None:
            raise ValueError(f"quantity at offset {seen['poison']} is no decimal")
        folder = f"{self.home}/data/{start}-{uuid.uuid4().hex[:12]}"
        judged = classify(batch.where(new & usable), committed).where("outcome <> 'duplicate'")
        judged.select(F.col("log_offset").alias("id"), "tenant_id", "meter", decimal.alias("quantity"), "occurred_at", "received_at", "idempotency_key", F.col("fingerprint").alias("payload_fingerprint"), "outcome").write.partitionBy("outcome").parquet(folder)
        n = {r["outcome"]: r["count"] for r in self.spark.read.schema(f"{ROW}, outcome string").parquet(folder).groupBy("outcome").count().collect()}
        stats = Stats(seen["usable"], n.get("inserted", 0), seen["usable"] - sum(n.values()), n.get("conflict", 0))
        if seen["unusable"]:
            reason = F.when(F.col("__undecodable"), "undecodable").when(~has_key(), "no_key").otherwise("bad_quantity")
            batch.where(new & ~usable).select("log_offset", reason.alias("reason"), "tenant_id", "idempotency_key").write.parquet(f"{folder}-refused")
            stats.add(Stats(seen["unusable"], 0, 0, seen["unusable"]))
        paths = {"rows": f"{folder}/outcome=inserted" if stats.inserted else None, "conflicting": f"{folder}/outcome=conflict" if n.get("conflict") else None, "refused": f"{folder}-refused" if seen["unusable"] else None}
        if stats.inserted:
            inserted = self.spark.read.schema(ROW).parquet(paths["rows"])
            index.append(inserted.select(*[e.alias(n) for n, e in ids.items()], F.col("id").alias("row_id"), F.col("payload_fingerprint").alias("value")))
        named = self._grown(index, state["index"]["path"], state["index"]["held"] + stats.inserted)
        manifest = {"from": start, "next_offset": seen["high"] + 1, **paths, **vars(stats), "index": named}
        if not self._commits.publish(f"{start:020d}.json", json.dumps(manifest)):
            raise RuntimeError("another writer published this batch")
        if named["path"] == state["index"]["path"]:
            index.drop([tuple(r) for r in state["index"]["runs"] if r not in named["runs"]])
        if len(self._manifest_names()) % SNAPSHOT == 0:
            done = [{k: m[k] for k in ("from", "next_offset", "rows", "conflicting", "refused", "read", "inserted", "duplicates", "conflicts")} for m in self.manifests()]
            self._commits.publish(f"snapshot-{start:020d}.json", json.dumps(done))
        stats.add(replayed)
        return stats

    def _grown(self, index: IdentifierIndex, path: str, held: int) -> dict:
        """What the manifest says of the index: its place and runs; an index that has outgrown its prefixes is laid out anew at another place."""
        if not index.outgrown(held):
            return {"path": path, "runs": [list(r) for r in index.runs()], "held": held}
        path = f"index-{uuid.uuid4().hex[:12]}"
        larger = IdentifierIndex(self.spark, f"{self.home}/{path}", prefix_bits(held), fan_in=4, valued=True, live=[])
        larger.append(index.rows())
        return {"path": path, "runs": [list(r) for r in larger.runs()], "held": held}

    def drain_table(self, log: DataFrame, cuts: list[int]) -> list[Stats]:
        """Read the log in batches [cuts[k], cuts[k + 1]) of its offsets, which the scan turns into ranges of row groups; the statistics of each."""
        return [self.apply(log.where((F.col("log_offset") >= low) & (F.col("log_offset") < high))) for low, high in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _count(classified: DataFrame) -> Stats:
        n = {r["outcome"]: r["count"] for r in classified.groupBy("outcome").count().collect()}
        return Stats(sum(n.values()), n.get("inserted", 0), n.get("duplicate", 0), n.get("conflict", 0))

    def drain(self, log_path: str, schema: T.StructType, files_per_batch: int = 64, checkpoint: str | None = None) -> Stats:
        """Read all files of the log that this consumer's checkpoint hasn't seen, batch by batch, and stop when caught up.

        Files must arrive in order of their offsets, as a log's segments do. Without the checkpoint all files are read again, and the manifests
        turn what was applied into duplicates. Statistics cover committed batches only.
        """
        return self._run(self._files(log_path, schema, files_per_batch), checkpoint)

    def drain_segments(self, folder: str, records_per_batch: int = 5_000_000) -> Stats:
        """Read a segmented binary log from this consumer's offset to its end, so many records at a time. Statistics cover committed batches only."""
        register(self.spark)
        total, end = Stats(), log_end(folder)
        while (start := self.next_offset()) < end:
            bounds = (F.col("log_offset") >= start) & (F.col("log_offset") < min(end, start + records_per_batch))
            total.add(self.apply(self.spark.read.format("segmented_log").load(folder).where(bounds)))
            if self.next_offset() == start:
                raise RuntimeError(f"the log announced offsets up to {end} and has none from {start}")
        return total

    def tail(self, log_path: str, schema: T.StructType, every: str = "10 seconds", files_per_batch: int = 64, checkpoint: str | None = None) -> StreamingQuery:
        """Like ``drain``, but go on until the query is stopped and look for new files each ``every``; the manifests have the statistics."""
        return self._start(self._files(log_path, schema, files_per_batch), checkpoint, Stats(), processingTime=every)

    def tail_segments(self, folder: str, every: str = "10 seconds", checkpoint: str | None = None) -> StreamingQuery:
        """Drain what is there, then go on until the query is stopped and look for new records each ``every``."""
        self.drain_segments(folder)
        return self._start(self._segments(folder), checkpoint, Stats(), processingTime=every)

    def _files(self, log_path: str, schema: T.StructType, files_per_batch: int) -> DataFrame:
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)

    def _segments(self, folder: str) -> DataFrame:
        register(self.spark)
        return self.spark.readStream.format("segmented_log").option("startingOffset", self.next_offset()).load(folder)

    def _start(self, stream: DataFrame, checkpoint: str | None, total: Stats, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda batch, _: total.add(self.apply(batch))).option("checkpointLocation", checkpoint or f"{self.home}/checkpoint").trigger(**trigger).start()

    def _run(self, stream: DataFrame, checkpoint: str | None) -> Stats:
        total = Stats()
        self._start(stream, checkpoint, total, availableNow=True).awaitTermination()
        return total
