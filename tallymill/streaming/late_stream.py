"""Daily usage by event time as a stream: watermark, allowed lateness, keyed state, upserts, and diverted rows.

The stream form of ``late_windows``, in two stages. ``Intake`` takes batches of deliveries in order of arrival, keeps the
first delivery of each message by the identifier index, diverts rows past the cut-off or otherwise unusable to a report by
their own clocks, so that none is lost silently, and hands the rest on as files. ``usage_stream`` reads these with a
watermark on event time that trails by the allowed lateness: rows come in order of arrival, so no row it is given is behind
the watermark, and state is dropped for days that no row can reach any more. Each micro-batch emits the keys it changed
with their new totals; the sink keeps every version, and the latest is the corrected total.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallymill.functions.quantity import as_decimal
from tallymill.operators.counted import EARLINESS_SECONDS, LATENESS_SECONDS, verdict
from tallymill.operators.dedup_index import IdentifierIndex, batches_by_arrival, candidates, prefix_bits
from tallymill.session import SharedFiles, scratch

VERSIONS = "tenant_id string, meter string, usage_day date, quantity decimal(38,9), events bigint, version bigint"
DIVERTED = "log_offset bigint, reason string"


class Intake:
    """The first stage, with its files below ``home``: ``kept``, ``diverted``, and the index of messages seen.

    A batch counts once its manifest is published, which names the runs of the index that count; then its kept rows are moved, by one rename, to
    where the second stage finds them. What a killed attempt has written counts for nothing. ``messages`` is about how many the index will hold.
    """

    def __init__(self, spark: SparkSession, home: str, lateness: int = LATENESS_SECONDS, messages: int = 0):
        self.spark, self.home, self.lateness = spark, home, lateness
        self._files, self._done = SharedFiles(spark, home), SharedFiles(spark, f"{home}/done")
        fresh = not self._files.exists("index")
        self.index = IdentifierIndex(spark, f"{home}/index", prefix_bits(messages) if fresh else None, live=[])
        for name in self._done.names()[-1:]:
            self._settle(name)

    def _settle(self, name: str) -> None:
        """Take over the state after a published batch, and finish its move if that was interrupted."""
        state = json.loads(self._done.read(name))
        self.index.live = [tuple(r) for r in state["runs"]]
        for kind in ("kept", "diverted"):
            if not self._files.exists(f"{kind}/{name}"):
                self._files.move(state[kind], f"{kind}/{name}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a batch, whose rows have all arrived no earlier than those of the batches before; one that was taken in before changes nothing."""
        name = f"{number:09d}"
        if self._done.exists(name):
            return
        new = self.index.add(candidates(batch)).select(F.explode("row_id").alias("log_offset"))
        judged, attempt = batch.withColumn("reason", verdict(self.lateness)), f"pending/{name}-{uuid.uuid4().hex[:12]}"
        judged.where("reason is not null").select("log_offset", "reason").write.parquet(f"{self.home}/{attempt}/diverted")
        judged.where("reason is null").drop("reason").join(new, "log_offset", "left_semi").write.parquet(f"{self.home}/{attempt}/kept")
        self.index.tidy()
        state = {"runs": [list(r) for r in self.index.runs()], "kept": f"{attempt}/kept", "diverted": f"{attempt}/diverted"}
        if not self._done.publish(name, json.dumps(state)):
            raise RuntimeError("another writer published this batch")
        self._settle(name)

    def kept(self, schema: StructType) -> DataFrame:
        """The kept rows as a stream."""
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1024).parquet(f"{self.home}/kept/*")

    def diverted(self) -> DataFrame:
        return self.spark.read.schema(DIVERTED).option("recursiveFileLookup", "true").parquet(f"{self.home}/diverted")


def usage_stream(kept: DataFrame, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """The streaming aggregation over kept rows: totals per (tenant, meter, day)."""
    day = F.window("occurred_at", "1 day")
    marked = kept.withWatermark("occurred_at", f"{lateness + EARLINESS_SECONDS} seconds")
    return marked.groupBy(day.alias("w"), "tenant_id", "meter").agg(F.sum(as_decimal()).alias("quantity"), F.count(F.lit(1)).alias("events")).select("tenant_id", "meter", F.to_date("w.start").alias("usage_day"), "quantity", "events")


def start_usage_stream(kept: DataFrame, out: str, lateness: int = LATENESS_SECONDS) -> StreamingQuery:
    """Start the aggregation over what is available now; upserts go below ``out/versions``."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/versions/batch={number}")

    return usage_stream(kept, lateness).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def stream_totals(events: DataFrame, batches: int = 3, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """The corrected totals of ``events`` after they have come in, batch by batch in order of arrival, through both stages."""
    spark = events.sparkSession
    home = scratch(spark, "usage-stream")
    intake = Intake(spark, home, lateness, events.count())
    for number, batch in enumerate(batches_by_arrival(events, batches)):
        intake.apply(batch, number)
        start_usage_stream(intake.kept(events.schema), home, lateness).awaitTermination()
    return current_totals(spark, home)


def current_totals(spark: SparkSession, out: str) -> DataFrame:
    """The latest version of every key."""
    versions = spark.read.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(f"{out}/versions")
    last = F.max(F.struct("version", "quantity", "events")).alias("last")
    return versions.groupBy("tenant_id", "meter", "usage_day").agg(last).select("tenant_id", "meter", "usage_day", "last.quantity", "last.events")
