"""The segmented binary log as a Spark data source, and writers for files of its format.

A segment ``<base offset, 20 digits>.log`` is a 16-byte header (magic, version, base offset; big end first) and records: length, CRC-32C over
length and payload, payload. Offsets are dense from the base. Beside it, ``<base>.index`` has an entry (offset from the base, position) for a record
about every 4 KiB. Each segment is read by one task; filters on ``log_offset`` leave out segments, and within one the reader goes to the last
index entry before the first offset it needs and steps over the records up to that without reading them. The index is a hint: one that is
lost is done without, what is cut or points past the end is ignored, and where it leads to no sound record the segment is read from its start.

The last segment may end in a torn or damaged record, where its readable log ends, or be shorter than a header, which is an interrupted creation;
anything of that kind in an earlier segment, a foreign file or an unknown version fails the query, as it would be loss of data. So the writer
cuts such a tail off before it goes on. A range of a stream that was announced and can't be read fails too.

Folders are URIs of any file system that Arrow opens (file, hdfs, s3, gs) or local paths; executors and driver must see the same.
Checksums are computed for all records of a chunk at once, byte column by byte column.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format.
MAGIC = 0x4C474C4E
VERSION = 1
HEADER = struct.Struct(">IIQ")
RECORD = struct.Struct(">II")
ENTRY = struct.Struct(">II")
INDEX_BYTES = 4096
LARGEST_RECORD = 8 * 1024 * 1024
POLYNOMIAL = 0x82F63B78

#: Payload bytes whose checksums are computed together.
CHUNK_BYTES = 16 * 1024 * 1024
SCHEMA = "log_offset bigint, payload binary"


class LogError(Exception):
    """The log can't be read without losing records."""


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_CRC = _table()


_ROW = 4096


def _columns(crc: np.ndarray, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Run the register ``crc`` of each string over its bytes; strings are ordered by falling length."""
    live = len(crc)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        while live and lengths[live - 1] <= k:
            live -= 1
        crc[:live] = _CRC[(crc[:live] ^ flat[begin[:live] + k]) & 0xFF] ^ (crc[:live] >> np.uint32(8))
    return crc


@lru_cache(maxsize=1)
def _after_row() -> list[list[int]]:
    """What a row of zero bytes does to a register, by each of its four bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_ROW):
        bits = _CRC[bits & 0xFF] ^ (bits >> np.uint32(8))
    tables = []
    for byte in range(4):
        own = bits[8 * byte : 8 * byte + 8]
        tables.append([int(np.bitwise_xor.reduce(own[[bool(v >> i & 1) for i in range(8)]], initial=0)) for v in range(256)])
    return tables


def _long(record: bytes) -> int:
    """CRC-32C of one long string: its rows are run side by side and their registers joined."""
    head = np.frombuffer(record, np.uint8).copy()
    head[:4] ^= 0xFF  # the same as a register that starts with ones
    rows = -(-len(head) // _ROW)
    flat = np.concatenate([np.zeros(rows * _ROW - len(head), np.uint8), head])
    each = _columns(np.zeros(rows, np.uint32), flat, np.arange(rows) * _ROW, np.full(rows, _ROW))
    crc, (t0, t1, t2, t3) = 0, _after_row()
    for x in each.tolist():
        crc = t0[crc & 0xFF] ^ t1[crc >> 8 & 0xFF] ^ t2[crc >> 16 & 0xFF] ^ t3[crc >> 24] ^ x
    return crc ^ 0xFFFFFFFF


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string."""
    out = np.empty(len(records), np.uint32)
    lengths = np.array([len(r) for r in records], np.int64)
    for k in np.flatnonzero(lengths > _ROW):
        out[k] = _long(records[k])
    short = np.flatnonzero(lengths <= _ROW)
    order = short[np.argsort(-lengths[short], kind="stable")]
    size = lengths[order]
    flat = np.frombuffer(b"".join(records[k] for k in order), np.uint8)
    out[order] = ~_columns(np.full(len(order), 0xFFFFFFFF, np.uint32), flat, np.cumsum(size) - size, size)
    return out


def segment_name(base: int) -> str:
    return f"{base:020d}.log"


def encode_records(payloads: list[bytes]) -> list[bytes]:
    """The payloads framed as records; a payload over the limit is refused before anything is written."""
    if any(len(p) > LARGEST_RECORD for p in payloads):
        raise LogError("record too large")
    lengths = [struct.pack(">I", len(p)) for p in payloads]
    sums = crc32c([n + p for n, p in zip(lengths, payloads, strict=True)])
    return [n + struct.pack(">I", int(c)) + p for n, c, p in zip(lengths, sums, payloads, strict=True)]


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def _read(path: str) -> bytes | None:
    system, at = _at(path)
    if system.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with system.open_input_file(at) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    """Replace the file in one step."""
    system, at = _at(path)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as f:
        f.write(data)
    system.move(temporary, at)


def list_segments(folder: str) -> list[tuple[int, str]]:
    """(base offset, path) of each segment in order; other files are ignored, a ``.log`` with another name is an error."""
    system, at = _at(folder)
    found = []
    for info in system.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        name = info.base_name
        if name.endswith(".log") and info.type == pafs.FileType.File:
            if not re.fullmatch(r"[0-9]+\.log", name):
                raise LogError(f"not a segment name: {name}")
            found.append((int(name[:-4]), f"{folder.rstrip('/')}/{name}"))
    return sorted(found)


def _size(path: str) -> int:
    system, at = _at(path)
    return system.get_file_info(at).size


def index_path(segment: str) -> str:
    return f"{segment[: -len('.log')]}.index"


def index_entries(segment: str, size: int) -> list[tuple[int, int]]:
    """(offset from the base, position) of the segment's index as far as it can be right; none if it is lost."""
    data = _read(index_path(segment)) or b""
    found: list[tuple[int, int]] = []
    for rel, position in ENTRY.iter_unpack(data[: len(data) // ENTRY.size * ENTRY.size]):
        if not (HEADER.size <= position < size) or found and not (rel > found[-1][0] and position > found[-1][1]):
            break
        found.append((rel, position))
    return found


def _index_of(lengths: list[int]) -> bytes:
    """The index of a segment whose records, frames included, have these lengths."""
    out, position, indexed = [], HEADER.size, -INDEX_BYTES
    for rel, n in enumerate(lengths):
        if position - indexed >= INDEX_BYTES:
            out.append(ENTRY.pack(rel, position))
            indexed = position
        position += n
    return b"".join(out)


@dataclass
class SegmentPart(InputPartition):
    path: str
    base: int
    low: int
    high: int | None
    last: bool
    announced: bool = False
    """Whether records up to ``high`` are known to be there, so that it is an error if they aren't."""

    def __init__(self, path: str, base: int, low: int, high: int | None, last: bool, announced: bool = False):
        self.path, self.base, self.low, self.high, self.last, self.announced = path, base, low, high, last, announced


def read_segment(part: SegmentPart) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the part's records, checked."""
    size = _size(part.path)
    with _opened(part.path) as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            if part.last and not part.announced:
                return
            raise LogError(f"{part.path}: header cut off")
        magic, version, base = HEADER.unpack(head)
        if magic != MAGIC:
            raise LogError(f"{part.path}: not a segment file")
        if version != VERSION:
            raise LogError(f"{part.path}: version {version}, not {VERSION}")
        if base != part.base:
            raise LogError(f"{part.path}: header says base offset {base}")
        entries = index_entries(part.path, size) if part.low > base else []
        k = bisect_right(entries, (part.low - base, size)) - 1
        if k >= 0:
            f.seek(entries[k][1])
            given = False
            for record in _records(f, part, size, base + entries[k][0], hint=True):
                if record is None:
                    break
                given = True
                yield record
            else:
                return
            if given:
                raise LogError(f"{part.path}: changed while it was read")
            f.seek(HEADER.size)
        yield from _records(f, part, size, base)  # type: ignore[misc]


def _opened(path: str) -> io.BufferedReader:
    system, at = _at(path)
    return io.BufferedReader(system.open_input_file(at), 1 << 20)


def _records(f: io.BufferedReader, part: SegmentPart, size: int, offset: int, hint: bool = False) -> Iterator[tuple[int, bytes] | None]:
    """Records from the file's place on, where that with ``offset`` begins; with ``hint``, None if there is no sound record before any was given."""
    given, ended, position = False, False, f.tell()

    def damaged(what: str, at: int) -> bool:
        """Whether the log simply ends here; else an error, but for a hint that has led astray."""
        if hint and not given:
            return False
        if not part.last or part.announced and (part.high is None or at < part.high):
            raise LogError(f"{part.path}: {what} at offset {at}")
        return True

    while not ended and (part.high is None or offset < part.high):
        held: list[tuple[int, int, bytes, bytes]] = []
        chunk, damage = 0, ""
        while chunk < CHUNK_BYTES and (part.high is None or offset < part.high):
            frame = f.read(RECORD.size)
            if not frame:
                ended = True
                break
            if len(frame) < RECORD.size:
                damage = "torn header"
                break
            length, crc = RECORD.unpack(frame)
            if length > LARGEST_RECORD:
                damage = "absurd length"
                break
            position += RECORD.size + length
            if position > size:
                damage = "torn payload"
                break
            if offset < part.low:
                f.seek(length, 1)
            else:
                held.append((offset, crc, frame[:4], f.read(length)))
                chunk += length
            offset += 1
        sums = crc32c([n + p for _, _, n, p in held])
        for (at, crc, _, payload), right in zip(held, sums.tolist(), strict=True):
            if crc != right:
                if not damaged("damaged record", at):
                    yield None
                return
            given = True
            yield at, payload
        if damage:
            if not damaged(damage, offset):
                yield None
            return
    if ended and part.announced and part.high is not None and offset < part.high and part.last and not damaged("missing record", offset):
        yield None


def _batches(records: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    while rows := list(islice(records, 8192)):
        offsets, payloads = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(payloads, pa.binary())], names=["log_offset", "payload"])


def log_end(folder: str) -> int:
    """The next offset the log would give: what can be read of its last segment from the last index entry on, not from its start."""
    found = list_segments(folder)
    while found:
        base, path = found.pop()
        size = _size(path)
        if size >= HEADER.size or not found:
            entries = index_entries(path, size) if size >= HEADER.size else []
            low = base + (entries[-1][0] if entries else 0)
            return max((o + 1 for o, _ in read_segment(SegmentPart(path, base, low, None, True))), default=low)
    return 0


def recover(folder: str) -> int | None:
    """Make the log's end fit to be written on: the last segment's torn or damaged tail is cut off, its index made anew, the file of an interrupted creation goes.

    The next offset; None if there is no segment. A foreign file or an unknown version is an error and stays as it is.
    """
    found = list_segments(folder)
    while found:
        base, path = found.pop()
        size = _size(path)
        if size < HEADER.size and found:
            _delete(path)
            continue
        lengths = [RECORD.size + len(p) for _, p in read_segment(SegmentPart(path, base, 0, None, True))] if size >= HEADER.size else []
        end = HEADER.size + sum(lengths)
        if size != end:
            _write(path, _read(path)[:end] if size >= HEADER.size else HEADER.pack(MAGIC, VERSION, base))  # type: ignore[index]
        if _read(index_path(path)) != _index_of(lengths):
            _write(index_path(path), _index_of(lengths))
        return base + len(lengths)
    return None


def write_log(folder: str, payloads: list[bytes], segment_bytes: int = 64 * 1024 * 1024, base: int | None = None) -> list[str]:
    """Write the payloads as segments behind what the log holds; a new one begins before a record that would make a non-empty one too large.

    The log is recovered first. ``base`` is where an empty log begins; another offset than a log's end is an error, as records would be lost.
    """
    system, at = _at(folder)
    system.create_dir(at, recursive=True)
    records, end = encode_records(payloads), recover(folder)
    if end is not None and base not in (None, end):
        raise LogError(f"the log ends at offset {end}, not {base}")
    return _write_segments(folder, records, end if end is not None else base or 0, segment_bytes)


def _write_segments(folder: str, records: list[bytes], base: int, segment_bytes: int) -> list[str]:
    names: list[str] = []
    first, size = 0, HEADER.size
    for k, record in enumerate([*records, None]):
        if k > first and (record is None or size + len(record) > segment_bytes):
            path = f"{folder.rstrip('/')}/{segment_name(base + first)}"
            _write(index_path(path), _index_of([len(r) for r in records[first:k]]))
            _write(path, HEADER.pack(MAGIC, VERSION, base + first) + b"".join(records[first:k]))
            names.append(segment_name(base + first))
            first, size = k, HEADER.size
        size += len(record or b"")
    return names


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Write the segments of one partition's records, (log_offset, payload) in order; the span of its offsets, if it has any."""
    held: list[bytes] = []
    low = first = None
    size = HEADER.size
    for batch in batches:
        for offset, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if first is None:
                low = first = offset
            if offset != first + len(held):
                raise LogError(f"offset {offset} comes where {first + len(held)} should")
            if held and size + RECORD.size + len(payload) > segment_bytes:
                _write_segments(folder, encode_records(held), first, segment_bytes)
                first, held, size = offset, [], HEADER.size
            held.append(payload)
            size += RECORD.size + len(payload)
    if held:
        _write_segments(folder, encode_records(held), first, segment_bytes)
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([first + len(held)], pa.int64())], names=["low", "high"])


def write_table(log: DataFrame, folder: str, partitions: int, segment_bytes: int = 64 * 1024 * 1024) -> int:
    """Write the rows (log_offset, payload) of an empty log, offsets dense from 0, each partition its own segments; the number of records.

    Segments appear whole, one rename each, and a task that is tried again writes the same files. Gaps and repeated offsets are an error.
    """
    if list_segments(folder):
        raise LogError("the log isn't empty")
    system, at = _at(folder)
    system.create_dir(at, recursive=True)

    ordered = log.select("log_offset", "payload").repartitionByRange(partitions, "log_offset").sortWithinPartitions("log_offset")
    end = 0
    for low, high in sorted((r["low"], r["high"]) for r in ordered.mapInArrow(lambda batches: _write_part(batches, folder, segment_bytes), "low bigint, high bigint").collect()):  # one row a partition
        if low != end:
            raise LogError(f"offset {low} comes where {end} should")
        end = high
    return end


def _exists(path: str) -> bool:
    system, at = _at(path)
    return system.get_file_info(at).type != pafs.FileType.NotFound


def _delete(path: str) -> None:
    system, at = _at(path)
    system.delete_file(at)


def read_at(offsets: DataFrame, folder: str) -> DataFrame:
    """(log_offset, payload) of the records with these offsets, each by its segment's index; offsets the log doesn't have give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list_segments(folder)
        bases = [b for b, _ in found]

        def records() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for offset in batch.column(0).to_pylist():
                    k = bisect_right(bases, offset) - 1 if offset is not None else -1
                    if k >= 0:
                        yield from read_segment(SegmentPart(found[k][1], bases[k], offset, offset + 1, k + 1 == len(found)))

        yield from _batches(records())

    return offsets.select("log_offset").mapInArrow(read, SCHEMA)


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.low, self.high = folder, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on log_offset are taken over; every other filter goes back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("log_offset",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, LessThan):
                self.high = f.value if self.high is None else min(self.high, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.high = f.value + 1 if self.high is None else min(self.high, f.value + 1)
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), f.value + 1 if self.high is None else min(self.high, f.value + 1)
            else:
                yield f

    def partitions(self, announced: bool = False) -> list[InputPartition]:
        found = list_segments(self.folder)
        parts = []
        for k, (base, path) in enumerate(found):
            last = k + 1 == len(found)
            if (self.high is None or base < self.high) and (last or found[k + 1][0] > self.low):
                parts.append(SegmentPart(path, base, self.low, self.high, last, announced))
        return parts

    def read(self, partition: SegmentPart | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: no segment at all
            yield from _batches(read_segment(partition))


class LogStreamReader(DataSourceStreamReader):
    """Offsets of the stream are offsets of the log."""

    def __init__(self, folder: str, first: int = 0):
        self.folder, self.first = folder, first

    def initialOffset(self) -> dict:
        return {"offset": self.first}

    def latestOffset(self) -> dict:
        return {"offset": max(self.first, log_end(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        reader = LogReader(self.folder)
        reader.low, reader.high = start["offset"], end["offset"]
        return reader.partitions(announced=True)

    def read(self, partition: SegmentPart) -> Iterator[pa.RecordBatch]:
        yield from _batches(read_segment(partition))

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.read`` or ``spark.readStream``, ``.format("segmented_log").load(folder)``; every executor must see the folder. A stream begins at ``startingOffset``, 0 if not given."""

    @classmethod
    def name(cls) -> str:
        return "segmented_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options["path"], int(self.options.get("startingOffset", 0)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
