"""Filling containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Hierarchical residual packing. Each task tokenises its own partition and packs it best-fit, largest first; nothing is
shuffled for that, and only ids and counts remain of the texts. Containers filled to ``FULL`` of the capacity are final.
The others become items themselves, as heavy as their content, and meet in a tree: each round brings ``FAN_IN`` groups
together and packs all their underfull containers best-fit once more, until one group is left.

The rounds work on counts. Containers of a group that are equally heavy are alike, so a group is told by how many it has of
each weight, at most as many numbers as the capacity has tokens; best fit is run on these counts and says which of them,
by their number within a weight, go together (``best_fit_counts``). So every underfull container takes part in every round,
however many there are, and no task holds more than ``FAN_IN`` times the capacity in numbers. Documents aren't moved: at the
end their rows look up, round by round, where their container went.

A text longer than the capacity fills containers of its own, and its remainder is an item; no other text is split. A text
without tokens takes one token's room, so that a container's list of documents stays bounded. Null texts count as empty.
Rows with null doc_id keep it. Repeated rows are items of their own. Targets with null or non-positive capacity get no
containers. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import written

#: A public vocabulary file; any ``.tiktoken`` file of base64 token and rank will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Share of the capacity from which a container is final.
FULL = 0.98
FAN_IN = 8
#: Documents that are packed at a time within a partition.
CHUNK = 8192

PLACED = "target_id int, capacity int, container string, done boolean, grp int, weight int, nth bigint, doc_id bigint, piece int, token_start bigint, tokens int"
#: Where a round puts containers: those of ``grp`` with this weight numbered [low, high) go, ``per`` at a time, into bins from ``bin`` on, which then weigh ``bin_weight`` and are numbered from ``bin_nth`` on.
MOVES = "target_id int, capacity int, grp int, weight int, low bigint, high bigint, per bigint, parent int, bin bigint, bin_weight int, bin_nth bigint, done boolean"
_ARROW = pa.schema([("target_id", pa.int32()), ("capacity", pa.int32()), ("container", pa.string()), ("done", pa.bool_()), ("grp", pa.int32()), ("weight", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("tokens", pa.int32())])


@lru_cache(maxsize=2)
def token_counter(path: str) -> Callable[[str], int]:
    import tiktoken

    if not os.path.exists(path):  # the package that holds the public vocabularies knows their place
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item when items go, largest first, into the fullest bin that still takes them."""
    place = [0] * len(sizes)
    waiting: dict[int, list[int]] = {}  # bins by room left
    rooms: list[int] = []  # the rooms that occur, ascending
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, room = bins, capacity
            bins += 1
        else:
            room = rooms[k]
            b = waiting[room].pop()
            if not waiting[room]:
                del waiting[room], rooms[k]
        place[i] = b
        left = room - size
        if left > 0:
            if left in waiting:
                waiting[left].append(b)
            else:
                waiting[left] = [b]
                insort(rooms, left)
    return place


@dataclass
class Placed:
    """Items of one child and weight, numbered [low, high), that go ``per`` at a time into the bins from ``bin`` on."""

    child: int
    weight: int
    low: int
    high: int
    bin: int
    per: int


def best_fit_counts(items: list[tuple[int, int, int]], capacity: int) -> tuple[list[Placed], list[tuple[int, int, int]]]:
    """What ``best_fit`` does, run on counts: ``items`` are (child, weight, number of such).

    Returns where they go and the bins as (first bin, number of bins, weight), in order and without gaps.
    """
    placed: list[Placed] = []
    waiting: dict[int, list[tuple[int, int]]] = {}  # runs of equal bins by room left
    rooms: list[int] = []
    bins = 0

    def keep(first: int, n: int, room: int) -> None:
        if n:
            if room not in waiting:
                waiting[room] = []
                insort(rooms, room)
            waiting[room].append((first, n))

    for child, weight, n in sorted(items, key=lambda x: (-x[1], x[0])):
        low = 0
        while low < n:
            k = bisect_left(rooms, weight)
            if k == len(rooms):
                room, per = capacity, capacity // weight
                first, there = bins, -(-(n - low) // per)
                bins += there
            else:
                room = rooms[k]
                per = room // weight
                first, there = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room], rooms[k]
            used = min(there, -(-(n - low) // per))
            taken = min(n - low, used * per)
            placed.append(Placed(child, weight, low, low + taken, first, per))
            keep(first + used, there - used, room)
            whole, part = divmod(taken, per)
            keep(first, whole, room - per * weight)
            keep(first + whole, 1 if part else 0, room - part * weight)
            low += taken
    return placed, sorted((first, n, capacity - room) for room, runs in waiting.items() for first, n in runs)


class _Partition:
    """What one task holds for one capacity: items of the containers that are still open, and rows to emit."""

    def __init__(self, target: int, capacity: int, group: int):
        self.target, self.capacity, self.group = target, capacity, group
        self.serial = 0
        self.open: list[tuple[int, list[tuple[int | None, int, int, int]]]] = []  # (load, rows of (doc, piece, start, tokens))

    def pack(self, docs: list[tuple[int | None, int]]) -> Iterator[tuple]:
        """Pack (doc_id, tokens) together with what is open; yield the rows of containers that are final."""
        items = self.open
        for doc, n in docs:
            whole = n // self.capacity if n > self.capacity else 0
            for p in range(whole):
                yield from self._rows(True, [(doc, p, p * self.capacity, self.capacity)])
            rest = n - whole * self.capacity
            if rest or not whole:
                items.append((max(rest, 1), [(doc, whole, whole * self.capacity, rest)]))
        place = best_fit([load for load, _ in items], self.capacity)
        loads: dict[int, int] = {}
        rows: dict[int, list] = {}
        for b, (load, members) in zip(place, items, strict=True):
            loads[b] = loads.get(b, 0) + load
            rows.setdefault(b, []).extend(members)
        self.open = []
        for b, load in loads.items():
            if load >= FULL * self.capacity:
                yield from self._rows(True, rows[b])
            else:
                self.open.append((load, rows[b]))

    def rest(self) -> Iterator[tuple]:
        """The rows of containers still open, numbered within their weight."""
        numbered: dict[int, int] = {}
        for load, members in self.open:
            numbered[load] = nth = numbered.get(load, -1) + 1
            yield from self._rows(False, members, load, nth)

    def _rows(self, done: bool, members: list, load: int | None = None, nth: int | None = None) -> Iterator[tuple]:
        name = f"{self.target}-0-{self.group}-{self.serial}"
        self.serial += 1
        for doc, piece, start, tokens in members:
            yield self.target, self.capacity, name, done, self.group, load, nth, doc, piece, start, tokens


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _packer(targets: list[tuple[int, int]], count: Callable[[], Callable[[str], int]]):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        parts = [_Partition(t, c, group) for t, c in targets]
        measure, docs = count(), []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for p in parts:
                rows.extend(p.pack(docs))
                if last:
                    rows.extend(p.rest())
            if rows:
                yield _table(rows)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append((doc, measure(text.as_py() or "")))
                if len(docs) >= CHUNK:
                    yield from flush(False)
                    docs = []
        yield from flush(True)

    return local


_MOVES_ARROW = pa.schema([("target_id", pa.int32()), ("capacity", pa.int32()), ("grp", pa.int32()), ("weight", pa.int32()), *((c, pa.int64()) for c in ("low", "high", "per")), ("parent", pa.int32()), ("bin", pa.int64()), ("bin_weight", pa.int32()), ("bin_nth", pa.int64()), ("done", pa.bool_())])


def _round(counts: pa.Table) -> pa.Table:
    """One round for the groups of one parent."""
    target, capacity, parent = (counts.column(c)[0].as_py() for c in ("target_id", "capacity", "parent"))
    placed, bins = best_fit_counts(list(zip(*(counts.column(c).to_pylist() for c in ("grp", "weight", "n")), strict=True)), capacity)
    firsts, numbered, nth = [b[0] for b in bins], {}, []
    for _, n, weight in bins:
        nth.append(numbered.get(weight, 0))
        numbered[weight] = nth[-1] + n
    rows = []
    for p in placed:
        end = p.bin - (p.low - p.high) // p.per  # after its last bin
        k = bisect_right(firsts, p.bin) - 1
        while k < len(bins) and bins[k][0] < end:
            first, n, weight = bins[k]
            a, b = max(first, p.bin), min(first + n, end)
            low, high = p.low + (a - p.bin) * p.per, min(p.high, p.low + (b - p.bin) * p.per)
            rows.append((target, capacity, p.child, p.weight, low, high, p.per, parent, a, weight, nth[k] + a - first, weight >= FULL * capacity))
            k += 1
    columns = list(zip(*rows, strict=True)) or [[] for _ in _MOVES_ARROW]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _MOVES_ARROW.types, strict=True)], schema=_MOVES_ARROW)


def _moved(rows: DataFrame, moves: DataFrame, level: int) -> DataFrame:
    """The document rows after a round: their container's new name, group, weight and number; what is final stays as it is."""
    theirs = moves.select(*[F.col(c).alias(f"m_{c}") for c in moves.columns if c != "capacity"])
    here = (F.col("target_id") == F.col("m_target_id")) & (F.col("grp") == F.col("m_grp")) & (F.col("weight") == F.col("m_weight"))
    joined = rows.where("not done").join(theirs, here & (F.col("nth") >= F.col("m_low")) & (F.col("nth") < F.col("m_high")))
    step = F.floor((F.col("nth") - F.col("m_low")) / F.col("m_per")).cast("bigint")
    new = {
        "container": F.concat_ws("-", "target_id", F.lit(level), "m_parent", F.col("m_bin") + step),
        "nth": F.col("m_bin_nth") + step,
        "grp": F.col("m_parent"),
        "weight": F.col("m_bin_weight"),
        "done": F.col("m_done"),
    }
    return joined.withColumns(new).select(*rows.columns)


def pack(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(target_id, capacity_tokens, container_id, doc_id, piece, token_start, tokens): every document in every capacity.

    ``targets`` are collected: a list of container sizes that the caller names, at most a thousand.
    """
    sizes = [(r[0], r[1]) for r in targets.where("target_id is not null and capacity_tokens > 0").select("target_id", "capacity_tokens").distinct().orderBy("target_id", "capacity_tokens").limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("more than 1000 container sizes")
    if len({t for t, _ in sizes}) < len(sizes):
        raise ValueError("a target with two capacities")
    local = documents.select("doc_id", "text").mapInArrow(_packer(sizes, lambda: token_counter(tokenizer)), PLACED)
    placed = written(local, "packed")
    counts = placed.where("not done").groupBy("target_id", "capacity", "grp", "weight").agg((F.max("nth") + 1).alias("n"))
    level, rows, out = 0, placed, placed.where("done")
    while True:
        level += 1
        parents = counts.withColumn("parent", F.floor(F.col("grp") / FAN_IN).cast("int")).groupBy("target_id", "capacity", "parent")
        moves = written(parents.applyInArrow(_round, MOVES), f"packed-moves-{level}")
        rows = _moved(rows, moves, level)
        if not moves.agg(F.max("parent")).first()[0]:  # one group is left, or nothing was open
            break
        out = out.unionByName(rows.where("done"))
        counts = moves.where("not done").groupBy("target_id", "capacity", F.col("parent").alias("grp"), F.col("bin_weight").alias("weight")).agg(F.max(F.col("bin_nth") + F.ceil((F.col("high") - F.col("low")) / F.col("per"))).alias("n"))
    out = out.unionByName(rows)
    return out.select("target_id", F.col("capacity").alias("capacity_tokens"), F.col("container").alias("container_id"), "doc_id", "piece", "token_start", "tokens")


def violations(packed: DataFrame) -> DataFrame:
    """Per target: documents placed, and what must not be: containers over capacity, texts split that fit, texts with missing or doubled pieces."""
    by = ["target_id", "capacity_tokens"]
    bins = packed.groupBy(*by, "container_id").agg(F.sum("tokens").alias("t")).groupBy(*by).agg(F.count(F.when(F.col("t") > F.col("capacity_tokens"), 1)).alias("over_capacity"))
    texts = packed.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max(F.col("token_start") + F.col("tokens")).alias("end"), F.max("piece").alias("last"))
    split = F.count(F.when((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens")), 1))
    broken = F.count(F.when((F.col("t") != F.col("end")) | (F.col("n") != F.col("last") + 1), 1))
    return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), split.alias("needless_splits"), broken.alias("broken_texts")).join(bins, by)


def utilisation(packed: DataFrame) -> DataFrame:
    """Per target: containers, tokens, the fewest containers that could hold them, and the share of room in use."""
    bins = packed.groupBy("target_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("t"))
    per = bins.groupBy("target_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    room = F.col("containers") * F.col("capacity_tokens")
    return per.withColumns({"lower_bound": F.ceil(F.col("tokens") / F.col("capacity_tokens")), "used": F.round(F.col("tokens") / room, 6)})
