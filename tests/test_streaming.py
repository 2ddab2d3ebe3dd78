import shutil
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymill.operators import dedup_index
from tallymill.operators.dedup_index import batches_by_arrival
from tallymill.operators.classify import classify
from tallymill.operators.late_windows import late_windows, latest
from tallymill.session import SharedFiles
from tallymill.sources.log_segments import write_log
from tallymill.sources.requests import encode_event, read_bodies
from tallymill.sources.tables import USAGE_EVENTS, table
from tallymill.streaming import drain
from tallymill.streaming.drain import Consumer, Stats
from tallymill.streaming.late_stream import Intake, current_totals, start_usage_stream, stream_totals
from tests.helpers import usage, values


def log_files(spark, path, rows, per_file=10):
    for k in range(0, len(rows), per_file):
        part = usage(spark, [{"log_offset": k + i, "idempotency_key": f"key-{k + i}", **r} for i, r in enumerate(rows[k : k + per_file])])
        part.coalesce(1).write.parquet(f"{path}/f{k:04d}")
    return f"{path}/*"


def test_apply_then_caught_up_then_replay(spark, tmp_path):
    log = log_files(spark, tmp_path / "log", [{} for _ in range(25)])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    assert consumer.next_offset() == 0 and consumer.rows().count() == 0
    assert consumer.drain(log, USAGE_EVENTS, files_per_batch=1) == Stats(25, 25, 0, 0)
    assert consumer.next_offset() == 25
    assert consumer.drain(log, USAGE_EVENTS) == Stats()
    before = values(consumer.rows())
    shutil.rmtree(tmp_path / "out/a/checkpoint")
    assert consumer.drain(log, USAGE_EVENTS, files_per_batch=2) == Stats(25, 0, 25, 0)
    assert values(consumer.rows()) == before


def test_conflict_is_kept_out_and_lettered(spark, tmp_path):
    same = [{"idempotency_key": "k", "fingerprint": b"1"}, {"idempotency_key": "k", "fingerprint": b"2", "quantity": "999"}, {"idempotency_key": None}]
    log = log_files(spark, tmp_path / "log", same, 1)
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    assert consumer.drain(log, USAGE_EVENTS) == Stats(3, 1, 0, 2)
    assert [str(r["quantity"]) for r in consumer.rows().collect()] == ["1.000000000"]
    assert values(consumer.dead_letters().select("log_offset", "reason")) == [(1, "key_reuse"), (2, "no_key")]


def test_poison_fails_the_batch_and_moves_nothing(spark, tmp_path):
    log = log_files(spark, tmp_path / "log", [{} for _ in range(10)] + [{"quantity": "not-a-number"}], 50)
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    with pytest.raises(Exception, match="offset 10"):
        consumer.drain(log, USAGE_EVENTS)
    assert consumer.next_offset() == 0 and consumer.rows().count() == 0
    other = Consumer(spark, str(tmp_path / "out"), "b", on_poison="quarantine")
    assert other.drain(log, USAGE_EVENTS) == Stats(11, 10, 0, 1)
    assert values(other.dead_letters().select("log_offset", "reason")) == [(10, "bad_quantity")]
    assert consumer.next_offset() == 0  # consumers don't share their progress


def test_interrupted_batch_is_invisible(spark, tmp_path, monkeypatch):
    rows = usage(spark, [{} for _ in range(20)])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    consumer.apply(rows.where("log_offset < 5"))
    monkeypatch.setattr(SharedFiles, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        consumer.apply(rows.where("log_offset >= 5 and log_offset < 12"))
    monkeypatch.undo()
    assert consumer.rows().count() == consumer.next_offset() == 5
    # after a crash batches may be cut otherwise: the part already applied only counts as duplicates
    assert consumer.apply(rows.where("log_offset >= 3")) == Stats(17, 15, 2, 0)
    assert consumer.rows().count() == consumer.next_offset() == 20


def test_a_second_writer_loses(spark, tmp_path, monkeypatch):
    rows = usage(spark, [{} for _ in range(20)])
    one, two = (Consumer(spark, str(tmp_path / "out"), "a") for _ in range(2))
    monkeypatch.setattr(two, "_last", lambda state=two._last(): state)  # it has looked before the other published
    one.apply(rows.where("log_offset < 5"))
    with pytest.raises(RuntimeError, match="another writer"):
        two.apply(rows.where("log_offset < 9"))
    assert one.rows().count() == one.next_offset() == 5
    # what the loser wrote changes nothing of the index: keys it alone had are still new, those of the winner are known
    assert one.apply(rows.where("log_offset >= 5")) == Stats(15, 15, 0, 0)
    again = usage(spark, [{"log_offset": 20 + k, "idempotency_key": f"key-{k}"} for k in range(20)])
    assert one.apply(again) == Stats(20, 0, 20, 0)


def test_many_batches_with_a_growing_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup_index, "PER_PREFIX", 1)
    monkeypatch.setattr(drain, "SNAPSHOT", 3)
    rows = usage(spark, [{"idempotency_key": f"k{k // 2 if k % 3 else k}", "fingerprint": bytes([k % 2])} for k in range(400)])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    total = Stats()
    for stats in consumer.drain_table(rows, list(range(0, 401, 50))):
        total.add(stats)
    want = values(classify(rows).groupBy("outcome").count())
    assert [("conflict", total.conflicts), ("duplicate", total.duplicates), ("inserted", total.inserted)] == want
    assert values(consumer.rows().select("id")) == values(classify(rows).where("outcome = 'inserted'").select("log_offset"))
    state = consumer._last()
    assert state["index"]["path"] != "index-0" and state["index"]["held"] == total.inserted and len(state["index"]["runs"]) < 8
    assert [n for n in consumer._commits.names() if n.startswith("snapshot")] and len(consumer.manifests()) == 8
    assert sum(m["inserted"] for m in consumer.manifests()) == total.inserted


def test_lost_offsets_are_noticed(spark, tmp_path):
    rows = usage(spark, [{} for _ in range(20)])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    consumer.apply(rows.where("log_offset >= 10"))
    with pytest.raises(RuntimeError, match="out of order"):
        consumer.apply(rows.where("log_offset < 10"))


def test_segmented_log_from_end_to_end(spark, tmp_path):
    rows = usage(spark, [{"idempotency_key": f"k{k % 30}", "fingerprint": b"1"} for k in range(40)])
    payloads = [r[0].encode() for r in rows.orderBy("log_offset").select(encode_event()).collect()]
    payloads.insert(10, b"{oops")
    write_log(str(tmp_path / "log"), payloads[:25], 900)
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    assert consumer.drain_segments(str(tmp_path / "log")) == Stats(25, 24, 0, 1)
    write_log(str(tmp_path / "log"), payloads[25:], 900, base=25)
    assert consumer.drain_segments(str(tmp_path / "log")) == Stats(16, 6, 10, 0)
    assert consumer.drain_segments(str(tmp_path / "log")) == Stats()
    assert values(consumer.dead_letters().select("log_offset", "reason")) == [(10, "undecodable")]
    assert consumer.next_offset() == 41
    # replay into an empty table, cut otherwise, gives the same rows
    other = Consumer(spark, str(tmp_path / "out"), "b")
    assert other.drain_segments(str(tmp_path / "log")) == Stats(41, 30, 10, 1)
    assert values(other.rows()) == values(consumer.rows())


def test_tailing_goes_on_with_what_arrives(spark, tmp_path):
    rows = usage(spark, [{} for _ in range(30)])
    payloads = [r[0].encode() for r in rows.orderBy("log_offset").select(encode_event()).collect()]
    log = str(tmp_path / "log")
    (last,) = write_log(log, payloads[:20])
    consumer = Consumer(spark, str(tmp_path / "out"), "a")
    query = consumer.tail_segments(log, every="200 milliseconds")
    try:
        query.processAllAvailable()
        assert consumer.next_offset() == 20
        with open(f"{log}/{last}", "ab") as f:
            f.write(b"torn")
        write_log(log, payloads[20:])
        query.processAllAvailable()
        assert consumer.next_offset() == consumer.rows().count() == 30
        assert query.isActive
    finally:
        query.stop()
    assert consumer.drain_segments(log) == Stats()
    files = Consumer(spark, str(tmp_path / "out"), "b")
    rows.where("log_offset < 20").coalesce(1).write.parquet(f"{tmp_path}/files/f0")
    query = files.tail(f"{tmp_path}/files/*", USAGE_EVENTS, every="200 milliseconds")
    try:
        query.processAllAvailable()
        rows.where("log_offset >= 20").coalesce(1).write.parquet(f"{tmp_path}/files/f1")
        query.processAllAvailable()
        assert files.next_offset() == files.rows().count() == 30
    finally:
        query.stop()


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"tenant_id":"a"}\n{oops\n')
    assert [r[0] for r in read_bodies(spark, str(tmp_path)).collect()] == ['{"tenant_id":"a"}', "{oops"]
    assert read_bodies(spark, str(tmp_path), streaming=True).isStreaming


def test_stream_totals_equal_batch_totals(spark, tmp_path, smallest):
    events = table(spark, smallest, "usage_events")
    want = late_windows(events)
    columns = ["tenant_id", "meter", "usage_day", "quantity", "events"]
    assert values(stream_totals(events, 4)) == values(latest(want.upserts).select(*columns))
    intake = Intake(spark, f"{tmp_path}/home")
    for number, batch in enumerate(batches_by_arrival(events, 3)):
        for _ in range(2):  # a batch that comes again changes nothing
            intake.apply(batch, number)
    assert values(intake.diverted()) == values(want.diverted.select("log_offset", "reason"))
    assert intake.index.held() == events.where("idempotency_key <> ''").select("tenant_id", "idempotency_key").distinct().count()


def test_intake_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    rows = usage(spark, [{"idempotency_key": "a"}, {"idempotency_key": "a"}, {"idempotency_key": "b"}])
    intake = Intake(spark, f"{tmp_path}/home")
    monkeypatch.setattr(SharedFiles, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        intake.apply(rows, 0)
    monkeypatch.undo()
    assert not SharedFiles(spark, f"{tmp_path}/home").exists("kept")  # nothing of the killed attempt is seen
    intake = Intake(spark, f"{tmp_path}/home")
    monkeypatch.setattr(Intake, "_settle", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        intake.apply(rows, 0)
    monkeypatch.undo()
    again = Intake(spark, f"{tmp_path}/home")  # published, but not moved: that is finished now
    again.apply(rows, 0)
    again.apply(usage(spark, [{"log_offset": 9, "idempotency_key": "a"}]), 1)
    start_usage_stream(again.kept(USAGE_EVENTS), f"{tmp_path}/home").awaitTermination()
    assert [r["events"] for r in current_totals(spark, f"{tmp_path}/home").collect()] == [2]
