"""Evaluation text leaking into training text, by suffix arrays over the training documents.

Each task turns the text parts of its documents into numbered units: words, and for Chinese and Japanese items single
letters and digits. A unit that no test item uses ends every match, so only stretches made of test units and at least as
long as the shortest match can hold one; a shard's suffix array sorts all suffixes of those stretches, which loses no
match. Every suffix of every test text is then binary-searched in the array, which gives all places where at least
``WORDS`` (``LETTERS``) units agree, and the longest verbatim run at each. Suffixes are sorted to their full length. Hashes
number the words, so each run found is read again and compared word by word; where that fails, its longest true part counts.

A shard's array is built of the units that the test set has, so it serves that test set: all its suffixes are searched in
one pass over the corpus, and nothing of the corpus is stored.

Documents stay where they are: nothing is shuffled. The test set goes to the tasks in blocks of at most ``BLOCK_CHARS``
characters, each block with a pass over the corpus. Null and empty texts match nothing, so do items with null id or text;
repeated rows are reported as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.mail import text_parts

WORDS = 12
LETTERS = 24
#: Languages whose items are compared letter by letter.
LETTER_LANGUAGES = ("zh", "ja")
#: Characters of test text that go to the tasks at a time.
BLOCK_CHARS = 16_000_000
#: Characters of training text in one suffix array at most, one document aside.
SHARD_CHARS = 4_000_000

#: Common runs that a shard lists at a time, which bounds its memory; results don't depend on it.
LISTED = 2_000_000

MATCHES = "doc_id bigint, item_id bigint, part int, doc_unit bigint, field string, item_unit int, units int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("part", pa.int32()), ("doc_unit", pa.int64()), ("field", pa.string()), ("item_unit", pa.int32()), ("units", pa.int32())])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER, _MARK, _DIGIT, _BREAK = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, combining mark, decimal digit; 0 for all else."""
    kinds = {"L": _LETTER, "M": _MARK}
    table = np.array([kinds.get((c := unicodedata.category(chr(i)))[0], _DIGIT if c == "Nd" else 0) for i in range(0x110000)], np.uint8)
    table[0] = _BREAK
    return table


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def normal(text: str) -> str:
    """Letter case and the choice among canonically equal forms taken away."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, with a 0 after each."""
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def _word_hashes(codes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each longest run of letters, marks and digits."""
    inside = np.concatenate([[False], (cls > 0) & (cls < _BREAK), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    n = 1 << max(16, int(len(codes)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), start


@dataclass
class Units:
    """Numbered units of several texts: id (-1 for one that no test item has), text number, place within the text."""

    ids: np.ndarray
    owner: np.ndarray
    place: np.ndarray


@dataclass
class ItemTexts:
    """One kind of unit: its vocabulary, and the test texts as ids, one after another, each ended by -1."""

    letters: bool
    least: int
    vocabulary: np.ndarray
    ids: np.ndarray
    text_of: np.ndarray
    place: np.ndarray
    items: np.ndarray
    fields: list[str]
    texts: list[str]

    def suffixes(self) -> np.ndarray:
        """Places in ``ids`` from which at least ``least`` units follow."""
        return _long_enough(self.ids, self.least)


def words(text: str) -> list[str]:
    """The words of a normalised text."""
    cls = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.concatenate([[False], (cls > 0) & (cls < _BREAK), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return [text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def longest_equal(a: list[str], b: list[str]) -> tuple[int, int]:
    """(start, length) of the longest stretch at which both lists, of one length, agree."""
    same = np.concatenate([[False], [x == y for x, y in zip(a, b, strict=True)], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    k = int(np.argmax(lengths)) if len(lengths) else 0
    return (int(starts[k]), int(lengths[k])) if len(lengths) else (0, 0)


def _places(owner: np.ndarray) -> np.ndarray:
    """Place of each unit within its text; ``owner`` ascends."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))


def _raw(texts: list[str], letters: bool, codes: np.ndarray | None = None, cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit keys, text number) of the normalised texts."""
    if codes is None or cls is None:
        codes = _codes(texts)
        cls = _classes()[codes]
    text = np.cumsum(cls == _BREAK, dtype=np.int32)
    if letters:
        at = np.flatnonzero((cls == _LETTER) | (cls == _DIGIT))
        return codes[at].astype(np.uint64), text[at]
    keys, at = _word_hashes(codes, cls)
    return keys, text[at]


def _number(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted vocabulary, -1 where it has none; a bitmap turns most others away first."""
    ids = np.full(len(keys), -1, np.int32)
    if not len(vocabulary):
        return ids
    low = np.zeros(1 << 20, bool)
    low[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(keys & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, keys[maybe]), len(vocabulary) - 1)
    same = vocabulary[at] == keys[maybe]
    ids[maybe[same]] = at[same]
    return ids


def _room(ids: np.ndarray) -> np.ndarray:
    """How many ids other than -1 follow from each place on."""
    here = np.arange(len(ids))
    gap = np.where(ids < 0, here, len(ids))
    return np.minimum.accumulate(gap[::-1])[::-1] - here


def _long_enough(ids: np.ndarray, least: int) -> np.ndarray:
    """Places from which at least ``least`` ids other than -1 follow."""
    return np.flatnonzero(_room(ids) >= least)


def item_texts(rows: list[tuple[int, str, str]], letters: bool) -> ItemTexts:
    """``rows`` are (item_id, field, text)."""
    texts = [normal(t) for _, _, t in rows]
    keys, owner = _raw(texts, letters) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    vocabulary = np.unique(keys)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ids = np.insert(_number(keys, vocabulary), np.flatnonzero(last) + 1, -1)
    ended = lambda x: np.insert(x, np.flatnonzero(last) + 1, -1)
    return ItemTexts(letters, LETTERS if letters else WORDS, vocabulary, ids, ended(owner), ended(_places(owner)), np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], texts)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the suffixes that begin there, told apart as far as ``depth`` units, by prefix doubling."""
    n = len(ids)
    rank = ids.astype(np.int64) + 1
    width = 1
    while width < depth:
        after = np.zeros(n, np.int64)
        after[:-width or None] = rank[width:]
        both = rank * (int(rank.max()) + 1) + after if n else rank
        distinct, rank = np.unique(both, return_inverse=True)
        width *= 2
        if len(distinct) == n:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _bounds(ids: np.ndarray, array: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the span of the suffix array whose suffixes begin with each probe (a row of ids)."""
    steps = np.arange(probes.shape[1])

    def search(after_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(probes), np.int64), np.full(len(probes), len(array))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            diff = ids[array[mid][:, None] + steps] - probes[open_]
            first = np.argmax(diff != 0, axis=1)
            sign = diff[np.arange(len(open_)), first]
            below = sign <= 0 if after_equal else sign < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    return search(False), search(True)


def _agreeing(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """How many units agree from x[a] and y[b] on, of which ``known`` are known to; a -1 ends them, and both arrays."""
    length, open_, width = np.full(len(a), known), np.arange(len(a)), 16
    while open_.size:
        step = np.arange(max(1, min(width, (1 << 22) // open_.size)))
        done = length[open_]
        mine = x[np.minimum((a[open_] + done)[:, None] + step, len(x) - 1)]
        same = (mine == y[np.minimum((b[open_] + done)[:, None] + step, len(y) - 1)]) & (mine >= 0)
        more = np.where(same.all(axis=1), len(step), np.argmin(same, axis=1))
        length[open_] += more
        open_, width = open_[more == len(step)], width * 2
    return length


def _first_longest(a: np.ndarray, b: np.ndarray, length: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of each pair of texts, in their order, the longest run; of equally long ones the first along the diagonals."""
    order = np.lexsort((a, a - b, -length, pair))
    return order[np.append(True, np.diff(pair[order]) != 0)]


def _longest(short: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, pair: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(a, b, length, pair) of the longest run of each pair of texts among those that begin at short[a] and ids[b]; ``room`` bounds their lengths."""
    lead = _first_longest(a, b, room, pair)
    reached = _agreeing(short, ids, a[lead], b[lead], least)
    each = np.searchsorted(pair[lead], pair)
    rest = (room >= reached[each]) & (reached < room[lead])[each]  # a run that fills the most room there is can't be beaten
    rest[lead] = False
    rest = np.flatnonzero(rest)
    a, b, pair = (np.append(x[lead], x[rest]) for x in (a, b, pair))
    length = np.append(reached, _agreeing(short, ids, a[len(lead) :], b[len(lead) :], least))
    best = _first_longest(a, b, length, pair)
    return a[best], b[best], length[best], pair[best]


def longest_matches(units: Units, test: ItemTexts) -> list[tuple[np.ndarray, ...]]:
    """(text number, unit in it, test text, unit in that, length) of the longest common run, of at least ``least`` units, of each text and test text."""
    least, own = test.least, test.suffixes()
    if not len(own) or not len(units.ids):
        return []
    edge = np.flatnonzero(units.owner[1:] != units.owner[:-1]) + 1
    ids = np.insert(units.ids, edge, -1)  # no run goes on from one text into the next
    source = np.insert(np.arange(len(units.ids)), edge, -1)
    starts = _long_enough(ids, least)
    if not len(starts):
        return []
    keep = np.zeros(len(ids) + 1, np.int32)
    keep[starts] += 1
    keep[starts + least] -= 1
    inside = np.cumsum(keep[:-1]) > 0  # the stretches; one unit more keeps them apart
    kept = np.flatnonzero(inside | np.append(False, inside[:-1]))
    short, source = np.append(np.where(inside[kept], ids[kept], -1), -1), np.append(source[kept], -1)
    array = suffix_array(short, _long_enough(short, least), int(_room(short).max()))
    probes = test.ids[own[:, None] + np.arange(least)]
    low, high = _bounds(short, array, probes)
    own, low, high = (x[high > low] for x in (own, low, high))
    if not len(own):
        return []
    # A run begins where the units before differ. Within a span of equal suffixes, places after the same unit are put side by side; of a test suffix's
    # span all but those after its own unit before are beginnings. So a text that repeats itself lists its runs, not all the places within them.
    spans, one, at = np.unique(low, return_index=True, return_inverse=True)
    sizes = high[one] - spans
    span, offset = np.repeat(spans, sizes), np.cumsum(sizes) - sizes
    places = array[span + np.arange(len(span)) - np.repeat(offset, sizes)]
    before, theirs = np.append(-1, short).astype(np.int64), np.append(-1, test.ids).astype(np.int64)[own]
    places = places[np.lexsort((before[places], span))]
    width = len(test.vocabulary) + 1
    key, same = span * width + before[places] + 1, low * width + theirs + 1
    skip = np.searchsorted(key, same)
    skipped = np.where(theirs < 0, 0, np.searchsorted(key, same, side="right") - skip)
    count = sizes[at] - skipped
    ends = np.cumsum(count)
    first = offset[at] - (ends - count)
    room_in, room_of = _room(short), _room(test.ids)
    best: tuple[np.ndarray, ...] | None = None
    for begin in range(0, int(ends[-1]), LISTED):
        k = np.arange(begin, min(begin + LISTED, int(ends[-1])))
        probe = np.searchsorted(ends, k, side="right")
        k += first[probe]
        k += np.where(k >= skip[probe], skipped[probe], 0)
        a, b = places[k], own[probe]
        pair = units.owner[source[a]].astype(np.int64) * len(test.items) + test.text_of[b]
        found = _longest(short, test.ids, a, b, np.minimum(room_in[a], room_of[b]), pair, least)
        if best is not None:
            found = tuple(np.append(x, y) for x, y in zip(best, found, strict=True))
            of_both = _first_longest(*found)
            found = tuple(x[of_both] for x in found)
        best = found
    a, b, length, _ = best
    order = np.lexsort((a, a - b))
    unit, theirs, length = source[a[order]], b[order], length[order]
    return [(units.owner[unit], units.place[unit], test.text_of[theirs], test.place[theirs], length)]


def _shard(docs: list[tuple[int, int, str, int]], tests: list[ItemTexts]) -> pa.RecordBatch:
    """Matches within (doc_id, part, text, row) of one shard; of each document and item the longest."""
    texts = [normal(t) for _, _, t, _ in docs]
    codes = _codes(texts)
    cls = _classes()[codes]
    best: dict[tuple[int, int], tuple] = {}
    for test in tests:
        keys, owner = _raw(texts, test.letters, codes, cls)
        units = Units(_number(keys, test.vocabulary), owner, _places(owner))
        own, other = lru_cache(maxsize=8)(lambda k: words(texts[k])), lru_cache(maxsize=1024)(lambda k, t=test: words(t.texts[k]))
        for found in longest_matches(units, test):
            for text, unit, theirs, place, length in zip(*(x.tolist() for x in found), strict=True):
                if not test.letters:  # the hashes agree; do the words?
                    skip, length = longest_equal(own(text)[unit : unit + length], other(theirs)[place : place + length])
                    unit, place = unit + skip, place + skip
                    if length < test.least:
                        continue
                key = (docs[text][0], int(test.items[theirs]), docs[text][3])
                row = (key[0], key[1], docs[text][1], unit, test.fields[theirs], place, length)
                if key not in best or best[key][6] < length:
                    best[key] = row
    columns = list(zip(*best.values(), strict=True)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def _finder(tests: list[ItemTexts]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = serial = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                serial += 1
                for k, t in enumerate(text_parts(text.as_py())):
                    held.append((doc, k, t, serial))
                    size += len(t) + 1
                if size >= SHARD_CHARS:
                    yield _shard(held, tests)
                    held, size = [], 0
        if held:
            yield _shard(held, tests)

    return find


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[ItemTexts]]:
    """The test set in blocks; each block's size is checked before it goes to the tasks."""
    words: list[tuple] = []
    letters: list[tuple] = []
    size = 0
    for row in items.where("item_id is not null").select("item_id", "lang", "passage", "question").toLocalIterator():
        to = letters if (row["lang"] or "").lower().split("-")[0] in LETTER_LANGUAGES else words
        for field in ("passage", "question"):
            if row[field]:
                to.append((row["item_id"], field, row[field]))
                size += len(row[field])
        if size >= block_chars:
            yield [item_texts(words, False), item_texts(letters, True)]
            words, letters, size = [], [], 0
    yield [item_texts(words, False), item_texts(letters, True)]


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item that leaks into it: the longest run, where it stands and how many units it has."""
    out, texts = None, documents.select("doc_id", "text")
    for tests in _blocks(items, block_chars):
        found = texts.mapInArrow(_finder(tests), MATCHES)
        out = found if out is None else out.unionAll(found)
    return out


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents into which no item leaks."""
    return documents.join(leaks(documents, items).select(F.col("doc_id").alias("__leaked")).distinct(), F.col("doc_id") == F.col("__leaked"), "left_anti")
