"""Faults while records are appended and drained, and what must hold afterwards."""

import pytest
from pyspark.sql import functions as F

from tallymill.sources import log_segments
from tallymill.sources.log_segments import log_end, write_log
from tallymill.sources.requests import encode_event
from tallymill.streaming.drain import Consumer, Stats
from tests.helpers import usage, values


def test_a_disk_that_fills_up_while_segments_roll(spark, tmp_path, monkeypatch):
    folder, payloads = str(tmp_path / "log"), [bytes([k]) * 100 for k in range(40)]
    write, written = log_segments._write, []

    def full(path, data):
        written.append(path)
        if len(written) > 5:
            raise OSError("no space left on device")
        write(path, data)

    monkeypatch.setattr(log_segments, "_write", full)
    with pytest.raises(OSError, match="no space"):
        write_log(folder, payloads, 1000)
    monkeypatch.undo()
    end = log_end(folder)
    assert 0 < end < 40  # what was rolled before is whole, and the rest can be written again
    write_log(folder, payloads[end:], 1000)
    log_segments.register(spark)
    rows = spark.read.format("segmented_log").load(folder).orderBy("log_offset").collect()
    assert [(r[0], bytes(r[1])) for r in rows] == list(enumerate(payloads))


def test_a_job_that_dies_within_a_batch(spark, tmp_path):
    rows = usage(spark, [{} for _ in range(20)])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    consumer.apply(rows.where("log_offset < 5"))
    dies = rows.withColumn("fingerprint", F.when(F.col("log_offset") == 11, F.raise_error(F.lit("connection lost")).cast("binary")).otherwise(F.col("fingerprint")))
    with pytest.raises(Exception, match="connection lost"):
        consumer.apply(dies.where("log_offset >= 5"))
    assert consumer.next_offset() == consumer.rows().count() == 5
    assert consumer.apply(rows.where("log_offset >= 5")) == Stats(15, 15, 0, 0)


def test_batches_in_another_order(spark, tmp_path):
    rows = usage(spark, [{"idempotency_key": f"k{k % 7}"} for k in range(30)])
    mixed, plain = (Consumer(spark, str(tmp_path / "out"), name) for name in ("mixed", "plain"))
    plain.apply(rows)
    mixed.apply(rows.orderBy(F.desc("log_offset")).repartition(5))  # rows of a batch may come in any order
    assert values(mixed.rows()) == values(plain.rows())
    with pytest.raises(ValueError, match="negative"):
        mixed.apply(rows.withColumn("log_offset", F.col("log_offset") - 100))


def test_the_log_and_its_consumer_die_together(spark, tmp_path):
    rows = usage(spark, [{"idempotency_key": f"k{k % 15}"} for k in range(20)])
    payloads = [r[0].encode() for r in rows.orderBy("log_offset").select(encode_event()).collect()]
    folder = str(tmp_path / "log")
    (name,) = write_log(folder, payloads)
    with open(f"{folder}/{name}", "r+b") as f:
        f.truncate(f.seek(0, 2) - 4)
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    assert consumer.drain_segments(folder, 7) == Stats(19, 15, 4, 0)
    write_log(folder, payloads[19:])
    assert Consumer(spark, str(tmp_path / "out"), "a").drain_segments(folder, 7) == Stats(1, 0, 1, 0)
