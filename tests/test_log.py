import os
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators.classify import classify
from tallymill.operators.offsets import as_of, consumer_lag, high_water_mark, latest_cursors, segments
from tallymill.sources import log_segments
from tallymill.sources.log_segments import ENTRY, HEADER, LogError, SegmentPart, crc32c, encode_records, index_entries, list_segments, log_end, read_at, read_segment, recover, register, write_log, write_table
from tests.helpers import NOON, usage, values


def test_crc_of_short_and_long_strings():
    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    r = random.Random(1)
    data = [b"123456789", b"", b"\0", r.randbytes(4096), r.randbytes(4097), r.randbytes(12_345)]
    got = crc32c(data).tolist()
    assert got[0] == 0xE3069283
    assert got == [plain(d) for d in data]


@pytest.fixture
def payloads():
    return [b'{"a":1}', b"", b"x", bytes(range(256)), *[f"record {i}".encode() * 5 for i in range(56)]]


def load(spark, folder):
    register(spark)
    return spark.read.format("segmented_log").load(str(folder))


def test_round_trip_over_segments(spark, tmp_path, payloads):
    names = write_log(str(tmp_path), payloads, 600)
    assert len(names) > 3 and names == sorted(names)
    (tmp_path / "notes.txt").write_text("ignored")
    rows = load(spark, tmp_path).orderBy("log_offset").collect()
    assert [(r[0], bytes(r[1])) for r in rows] == list(enumerate(payloads))


def test_bounds_leave_out_segments(spark, tmp_path, payloads):
    write_log(str(tmp_path), payloads, 600)
    df = load(spark, tmp_path)
    assert [r[0] for r in df.where("log_offset >= 20 and log_offset < 25 and length(payload) > 0").orderBy("log_offset").collect()] == list(range(20, 25))
    assert [bytes(r[1]) for r in df.where("log_offset = 7").collect()] == [payloads[7]]
    assert df.where("log_offset > 58").count() == 1 and df.where("log_offset = 99").count() == 0


def test_largest_record(tmp_path):
    big = random.Random(2).randbytes(8 * 1024 * 1024)
    write_log(str(tmp_path), [big, b"end"])
    (base, path), = list_segments(str(tmp_path))
    assert [p for _, p in read_segment(SegmentPart(path, base, 0, None, True))] == [big, b"end"]
    with pytest.raises(LogError):
        encode_records([big + b"x"])


def cut(path, n):
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - n)


def flip(path, at):
    with open(path, "r+b") as f:
        f.seek(at)
        b = f.read(1)
        f.seek(at)
        f.write(bytes([b[0] ^ 1]))


def test_only_the_last_segment_may_end_torn(spark, tmp_path, payloads):
    names = write_log(str(tmp_path), payloads, 600)
    cut(tmp_path / names[-1], 3)
    assert load(spark, tmp_path).count() == len(payloads) - 1
    cut(tmp_path / names[0], 3)
    with pytest.raises(Exception, match="torn payload"):
        load(spark, tmp_path).count()


def test_damage_in_the_last_segment_ends_the_log(tmp_path):
    write_log(str(tmp_path), [b"0123456789"] * 10)
    (base, path), = list_segments(str(tmp_path))
    flip(path, HEADER.size + 4 * 18 + 12)
    assert [o for o, _ in read_segment(SegmentPart(path, base, 0, None, True))] == [0, 1, 2, 3]
    with pytest.raises(LogError, match="damaged record at offset 4"):
        list(read_segment(SegmentPart(path, base, 0, None, False)))


def test_foreign_files(tmp_path):
    (tmp_path / "00000000000000000000.log").write_text("this is a text, not a log segment")
    (base, path), = list_segments(str(tmp_path))
    with pytest.raises(LogError, match="not a segment file"):
        list(read_segment(SegmentPart(path, base, 0, None, True)))
    (tmp_path / "other.log").write_text("")
    with pytest.raises(LogError, match="not a segment name"):
        list_segments(str(tmp_path))


def test_unfinished_creation_is_an_empty_tail(tmp_path):
    write_log(str(tmp_path), [b"a"])
    (tmp_path / "00000000000000000001.log").write_bytes(b"\x4c\x47")
    parts = list_segments(str(tmp_path))
    assert list(read_segment(SegmentPart(parts[1][1], 1, 0, None, True))) == []


def test_writing_goes_on_after_a_crash(spark, tmp_path, payloads):
    last = write_log(str(tmp_path), payloads, 600)[-1]
    whole = [(k, p) for k, p in enumerate(payloads)]
    for damage in (lambda: cut(tmp_path / last, 3), lambda: flip(tmp_path / last, os.path.getsize(tmp_path / last) - 1)):
        damage()
        with pytest.raises(LogError, match="ends at offset 59"):
            write_log(str(tmp_path), payloads[59:], 600, base=60)
        assert recover(str(tmp_path)) == recover(str(tmp_path)) == 59
        (tmp_path / "00000000000000000059.log").write_bytes(b"\x4c\x47")
        last = write_log(str(tmp_path), payloads[59:], 600)[-1]
        assert last == "00000000000000000059.log"
        assert [(r[0], bytes(r[1])) for r in load(spark, tmp_path).orderBy("log_offset").collect()] == whole
    assert write_log(str(tmp_path), [b"more"]) == ["00000000000000000060.log"]
    (tmp_path / "empty").mkdir()
    assert recover(str(tmp_path / "empty")) is None
    (tmp_path / "00000000000000000061.log").write_text("this is a text, not a log segment")
    with pytest.raises(LogError, match="not a segment file"):
        write_log(str(tmp_path), [b"x"])
    assert (tmp_path / "00000000000000000061.log").read_text().startswith("this is a text")


def test_empty_log(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0


def test_the_index_is_a_hint(spark, tmp_path):
    payloads = [f"{i:064}".encode() for i in range(4000)]
    (name,) = write_log(str(tmp_path), payloads)
    path, index = str(tmp_path / name), tmp_path / name.replace(".log", ".index")
    size = os.path.getsize(path)
    entries = index_entries(path, size)
    assert len(entries) == 71 and entries[0] == (0, HEADER.size)
    whole = index.read_bytes()
    at = lambda o: [(k, bytes(p)) for k, p in read_segment(SegmentPart(path, 0, o, o + 1, True))]
    wrong = ENTRY.pack(100, 20) + ENTRY.pack(300, 5000)
    for content in (whole, None, whole[:-5], whole + ENTRY.pack(5000, size + 7), wrong, b"", b"abc"):
        if content is None:
            index.unlink()
        else:
            index.write_bytes(content)
        assert [at(o) for o in (0, 1, 99, 350, 3999, 4000)] == [[(o, payloads[o])] if o < 4000 else [] for o in (0, 1, 99, 350, 3999, 4000)]
        assert log_end(str(tmp_path)) == 4000
    assert recover(str(tmp_path)) == 4000 and index.read_bytes() == whole


def test_a_point_read_touches_little(tmp_path, monkeypatch):
    payloads = [bytes(1000)] * 20_000
    (name,) = write_log(str(tmp_path), payloads)
    read = []
    opened = log_segments._opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def seek(self, *a):
            return self.f.seek(*a)

        def tell(self):
            return self.f.tell()

    monkeypatch.setattr(log_segments, "_opened", lambda p: Counted(opened(p)))
    assert [o for o, _ in read_segment(SegmentPart(str(tmp_path / name), 0, 15_003, 15_004, True))] == [15_003]
    assert sum(read) < 2000  # headers up to the record, and its own payload


def test_what_a_stream_was_promised_must_be_there(tmp_path):
    (name,) = write_log(str(tmp_path), [b"0123456789"] * 10)
    path = str(tmp_path / name)
    assert len(list(read_segment(SegmentPart(path, 0, 2, 10, True, announced=True)))) == 8
    with pytest.raises(LogError, match="missing record at offset 10"):
        list(read_segment(SegmentPart(path, 0, 2, 11, True, announced=True)))
    flip(path, HEADER.size + 4 * 18 + 12)
    with pytest.raises(LogError, match="damaged record at offset 4"):
        list(read_segment(SegmentPart(path, 0, 2, 10, True, announced=True)))


def test_a_table_is_written_as_segments_by_many_tasks(spark, tmp_path):
    rows = [(k, bytes([k % 256]) * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "log_offset bigint, payload binary").repartition(5)
    for folder in (f"file://{tmp_path}/a", str(tmp_path / "b")):
        assert write_table(df, folder, 4, 8000) == 3000
        assert len(list_segments(folder)) >= 12
        assert sorted((r[0], bytes(r[1])) for r in load(spark, folder).collect()) == rows
        assert sorted((r[0], bytes(r[1])) for r in read_at(spark.createDataFrame([(5,), (2999,), (3000,), (None,), (5,)], "log_offset bigint"), folder).collect()) == [rows[5], rows[5], rows[2999]]
        with pytest.raises(LogError, match="isn't empty"):
            write_table(df, folder, 4)
    for k, bad in enumerate((df.where("log_offset <> 700"), df.unionAll(df.where("log_offset = 9")), df.where("log_offset > 0"))):
        with pytest.raises(Exception, match="should"):
            write_table(bad, str(tmp_path / f"bad{k}"), 3)
    assert write_table(df.limit(0), str(tmp_path / "none"), 3) == 0


def test_classification(spark):
    rows = [
        {"idempotency_key": "a", "fingerprint": b"1"},  # inserted
        {"idempotency_key": "a", "fingerprint": b"1"},  # duplicate
        {"idempotency_key": "a", "fingerprint": b"2"},  # conflict
        {"idempotency_key": "a", "fingerprint": b"1"},  # compared with the first, not with the delivery before
        {"idempotency_key": "a", "fingerprint": None},  # conflict
        {"idempotency_key": "n", "fingerprint": None},  # inserted
        {"idempotency_key": "n", "fingerprint": b"9"},  # duplicate: the first has no fingerprint
        {"idempotency_key": "a", "tenant_id": None, "fingerprint": b"2"},  # another tenant
        {"idempotency_key": "s", "fingerprint": b"1"},  # stored with the same content
        {"idempotency_key": "s", "fingerprint": b"2"},  # stored with other content
        {"idempotency_key": "old", "fingerprint": b"2"},  # stored before there were fingerprints
        {"idempotency_key": "", "fingerprint": b"2"},  # no key
    ]
    stored = spark.createDataFrame([("acme", "s", b"1"), ("acme", "old", None)], "tenant_id string, idempotency_key string, payload_fingerprint binary")
    got = classify(usage(spark, rows).withColumns({"first_offset": F.lit(5), "outcome": F.lit("x"), "first_fingerprint": F.lit("y"), "rank": F.lit(1)}), stored)
    want = ["inserted", "duplicate", "conflict", "duplicate", "conflict", "inserted", "duplicate", "inserted", "duplicate", "conflict", "duplicate"]
    assert [r["outcome"] for r in got.orderBy("log_offset").collect()] == want
    assert classify(usage(spark, [])).count() == 0


def test_offsets(spark):
    log = usage(spark, [{} for _ in range(25)])
    assert high_water_mark(log).first()[0] == 25 and high_water_mark(log.limit(0)).first()[0] == 0
    cursors = spark.createDataFrame([("a", 5, NOON), ("b", 99, NOON)], "consumer string, next_offset bigint, updated_at timestamp")
    moved = cursors.unionAll(cursors.selectExpr("consumer", "next_offset - 3", "updated_at + interval 1 day").where("consumer = 'a'"))
    assert values(latest_cursors(moved).select("consumer", "next_offset")) == [("a", 2), ("b", 99)]
    assert values(consumer_lag(cursors, log)) == [("a", 5, 25, 20), ("b", 99, 25, 0)]
    assert [(r["segment"], r["records"]) for r in segments(log, 10).orderBy("base_offset").collect()] == [("00000000000000000000.log", 10), ("00000000000000000010.log", 10), ("00000000000000000020.log", 5)]


def test_as_of(spark):
    entries = spark.createDataFrame([("p", 10, 1), ("p", 20, 2), (None, 5, 3)], "g string, o int, v int")
    probes = spark.createDataFrame([("p", 9), ("p", 10), ("p", 15), ("p", 25), ("q", 5), (None, 6)], "g string, o int")
    assert values(as_of(probes, entries, "g", "o", "v")) == sorted([("p", 9, None), ("p", 10, 1), ("p", 15, 1), ("p", 25, 2), ("q", 5, None), (None, 6, 3)], key=repr)
