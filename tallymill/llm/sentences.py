"""Sentences of each message's own prose, across languages and scripts.

Document-centred disambiguation. A point may end a sentence or belong to an abbreviation, a number or an initial, and no
list of words decides which. Three sources do, in this order:

1. *The document.* Each document is read once for what it says beyond doubt: a word that stands there without a point is an
   ordinary word, one whose points go on in lower case is an abbreviation; a capitalised word that the document also has in
   lower case begins a sentence, one it capitalises within sentences is a name.
2. *The corpus.* What the document leaves open is answered by counts over all documents, taken where position leaves no
   doubt: at the ends of paragraphs. A word before a point that ends sentences must end its share of paragraphs; ``Dr.`` ends
   none, ``etc.`` some, ``rows.`` as many as expected. The same holds for a number by the word before it (``am 7. August``),
   for spaced letters (``z. B.``) and for what stands before a space in Thai, which has no mark.
3. *Form.* Where both are silent: a single letter is an initial, all else ends its sentence unless a name follows an
   abbreviation.

Which marks end a sentence by themselves, and which quotations and brackets hold one together, are rules of the script.

Texts are read once. That pass writes, for each document, its segments and the points still open with what the document
knows about them, and adds up the corpus counts; the open points are then resolved from that narrow table. Counts are thinned
in every task; the model that reaches the tasks holds only words with at least ``LEAST_SHARE`` of all counts, so at most
``1/LEAST_SHARE`` of either kind, whatever the corpus.

Null and empty texts and messages without own prose have no rows; null doc_id is kept; repeated rows give repeated
sentences; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.mail import parts
from tallymill.session import written

SENTENCES = "doc_id bigint, sent_start bigint, sent_end bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("sent_start", pa.int64()), ("sent_end", pa.int64())])

#: A word enters the corpus model if it makes up this share of all words counted in its role.
LEAST_SHARE = 1e-5
#: Longest word, in characters, that the model holds.
LONGEST = 24
#: Chance at which a word that ends sentences would never have ended a paragraph; below it the corpus says that it doesn't.
DOUBT = 0.005
#: Counters that a task holds before it hands them on.
HELD = 500_000

# Connectives that open a Thai sentence after a space, as reports and news have them.
_THAI_FIRST = re.compile(r"\s+(?:อย่างไรก็ตาม|อย่างไรก็ดี|นอกจากนี้|นอกจากนั้น|ดังนั้น|เพราะฉะนั้น|ด้วยเหตุนี้|ทั้งนี้|ต่อมา|จากนั้น|หลังจากนั้น|ขณะเดียวกัน|ในขณะเดียวกัน|ในทางกลับกัน)")

_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", "‚": "‘"}
_BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕"}
_CLOSERS = set(_PAIRS.values()) | set(_BRACKETS.values()) | {'"', "”", "’", "'", "“"}
_WIDE = "。！？｡．"
_MARKS = re.compile(r"[.…]*[!?！？؟]+[!?！？؟…]*|\.{2,}|…+(?:\.+)?|[。｡]+|[।॥]+|\.|[;;]|(?<=[ \n])\|(?=\s|$)|(?<=[ऀ-ॿ])\|")
_WORD_BEFORE = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯऀ-ःऺ-्॑-ॗॢॣ.'’\-])*$")
_NEXT = re.compile(r"[\s\"'“„«»‹(\[（「『¡¿—–\-*•]*")
_TOKEN = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*")
_CAMEL = re.compile(r"[a-z]{1,2}[A-Z][a-z]")
_GARBLED = re.compile(r"[\u00c2-\u00f4](?:[\u0080-\u00bf]|[\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122])+")
_FILL, _LETTER_FILL = "\u2060", "\u02c8"
_SPACED_LETTERS = re.compile(r"(?:(?<=\s)|^)(\w{1,2}\.\s+\w{1,2})$")


def _script(c: str) -> str:
    """The script whose rules hold next to ``c``."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "arabic"
    if 0x900 <= o < 0x980:
        return "devanagari"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "cjk"
    return "other"


def own_prose(text: str) -> list[tuple[int, int]]:
    """Spans of the paragraphs of a message's own prose."""
    found = parts(text)
    if not found or found[0].depth > 1 or found[0].kind != "text/plain" or found[0].encoding in ("base64", "quoted-printable"):
        return []
    at, end = found[0].start, found[0].end
    lines: list[tuple[int, int]] = []
    while at < end:
        stop = text.find("\n", at, end)
        after = end if stop < 0 else stop + 1
        last = after if stop < 0 else stop
        if last > at and text[last - 1] == "\r":
            last -= 1
        if text.startswith(("-----", "_____"), at) or text[at:last] == "-- ":
            break
        lines.append((at, last))
        at = after
    spans: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    for k, (a, b) in enumerate(lines):
        quoted = text.startswith(">", a)
        above = k + 1 < len(lines) and text.startswith(">", lines[k + 1][0]) and text[a:b].rstrip().endswith((":", "："))
        if quoted or above or not text[a:b].strip():
            if run:
                spans.append((run[0][0], run[-1][1]))
            run = []
        else:
            run.append((a, b))
    if run:
        spans.append((run[0][0], run[-1][1]))
    return spans


def _caseless(text: str) -> bool:
    """Whether a paragraph of a cased script has no capitals at all, so that case tells nothing."""
    return text == text.lower() != text.upper()


def ungarbled(text: str) -> str:
    """A text of the same length in which characters that were decoded with the wrong charset are readable.

    Dots and spaces fill all places of their garbled form; letters and other marks are followed by a filler.
    """

    def readable(m: re.Match) -> str:
        try:
            right = m.group().encode("cp1252").decode("utf-8")
        except UnicodeError:
            return m.group()
        out = []
        for c in right:
            n = len(c.encode("utf-8").decode("cp1252", "replace"))
            out.append(c * n if c == "…" or c.isspace() else c + (_LETTER_FILL if c.isalpha() else _FILL) * (n - 1))
        return "".join(out)

    fixed = _GARBLED.sub(readable, text)
    return fixed if len(fixed) == len(text) else text


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """(open, close, is_quote) of matched quotations and brackets in a paragraph."""
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []
    for m in re.finditer(r"[“”„«»‹›「」『』()（）\[\]【】\"]", text):
        c, i = m.group(), m.start()
        if c == '"':
            if any(s[0] == '"' for s in stack):
                expected = '"'
            elif i == 0 or text[i - 1].isspace() or text[i - 1] in "([（«“":
                stack.append(('"', i, True))
                continue
            else:
                continue
        else:
            expected = c
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == expected), None)
        if k is not None and (c != "“" or stack[k][0] == "“"):
            out.append((stack[k][1], i, stack[k][2]))
            del stack[k:]
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i, True))
        elif c in _BRACKETS:
            stack.append((_BRACKETS[c], i, False))
        elif c == "»":
            stack.append(("«", i, True))
    return out


def _cased(c: str) -> bool:
    return c.lower() != c.upper()



#: What follows a point: a lower-case letter, a digit, anything else, the paragraph's end; or a paragraph without capitals, where case tells nothing.
LOW, DIGIT, OTHER, END, CASELESS = range(5)
#: Further counts: documents that have a word in lower case, and capitalised within a sentence; a bit for each hash of the capitalised words that follow a key.
LOWER, NAME, NEXT = 5, 6, 7
#: Place in a key's counts of how many bits of ``NEXT`` are set, and the number below which they say nothing.
NEXT_OF, FEW = 4, 4
#: Who decided a point.
DOCUMENT, CORPUS, FORM = "document", "corpus", "form"
_SURE, _DECIDED = "\0sure", "\0decided "


@dataclass
class Evidence:
    """What a document shows beyond doubt."""

    abbreviations: Counter = field(default_factory=Counter)
    """Words before a point that goes on in lower case, with how often."""
    bare: set[str] = field(default_factory=set)
    """Words seen without a point."""
    names: set[str] = field(default_factory=set)
    """Words capitalised after a lower-case word."""
    lower: set[str] = field(default_factory=set)
    dandas: bool = False


_JOINED = frozenset("@/._=&?-:#0123456789")
_SCAN = re.compile(r"([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)(\s+)?(?=(\w)?)")


def gather(paragraphs: list[str]) -> Evidence:
    """Read a document's paragraphs for evidence."""
    seen = Evidence()
    for text in paragraphs:
        seen.dandas = seen.dandas or "।" in text
        lower_before, reached, caseless = False, 0, _caseless(text)
        for m in _SCAN.finditer(text):
            word, point, gap, after = m.groups()
            if text[max(0, m.start() - 1) : m.start()] in _JOINED or not gap and after or text[m.end() : m.end() + 1] in _JOINED:
                lower_before = False
                continue  # part of a name of a file, host or address
            word = word.replace(_LETTER_FILL, "")
            if word[0].islower():
                seen.lower.add(word)
            elif lower_before and m.start() == reached and word[0].isupper():
                seen.names.add(word)
            if not point:
                seen.bare.add(word.lower())
            elif gap and after and after.islower() and not caseless and not _CAMEL.match(text, m.end()):
                seen.abbreviations[word.lower()] += 1
            lower_before, reached = bool(gap) and not point and word[0].islower(), m.end()
    return seen


@dataclass
class Open:
    """A point that its document doesn't decide."""

    key: str
    """The word before it in its context, by which the corpus knows it."""
    follows: int
    first: str
    """The word that would begin a sentence."""
    form: bool
    """Whether it ends one if the corpus is silent too."""


def key_before(text: str, at: int, word: str, last: str) -> str:
    """How the corpus knows ``word``, which begins at ``at`` and ends in ``last``: numbers by the word before, spaced letters together, units beside a number."""
    ahead = text[max(0, at - 30) : at]
    if _NUMBER.fullmatch(word):
        before = ahead.split()
        tail = before[-1].lower() if before and ahead[-1:].isspace() else ""
        return ("#" if tail[-1:].isdigit() else tail if tail[-1:].isalpha() else "^") + " #"
    if len(last) <= 2 and (m := _LETTER_AHEAD.search(ahead)):
        return f"{m.group(1)}. {last}".lower()
    return ("# " if _NUMBER_AHEAD.search(ahead) else "") + last.lower()


_NUMBER = re.compile(r"[\d.]+")
_LETTER_AHEAD = re.compile(r"(?<!\w)([^\W\d_]{1,2})\.\s+$")
_NUMBER_AHEAD = re.compile(r"\d\s+$")


@dataclass
class Scan:
    """A document's segments, each to the next place where a sentence ends or may end, and its share of the corpus counts."""

    segments: list[tuple[int, int]] = field(default_factory=list)
    open: dict[int, Open] = field(default_factory=dict)
    """By segment, the points that close it but may not end a sentence."""


class Reader:
    """Reads the paragraphs of one document; adds to ``counts``: by key how often each kind follows, by decision how often it fell."""

    def __init__(self, evidence: Evidence, counts: Counter):
        self.evidence, self.counts = evidence, counts
        self.caseless = False
        self.counted: set[tuple[str, int]] = set()

    def read(self, text: str, offset: int, out: Scan) -> None:
        """Add the segments of a paragraph that begins at ``offset``, white space at their ends left out."""
        spans, start = _spans(text), 0
        self.caseless = _caseless(text)
        self.counted.clear()
        for end, point in self._ends(text, spans):
            if end <= start:
                continue
            a, b = start, end
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            start = end
            if a < b:
                if point is not None:
                    out.open[len(out.segments)] = point
                out.segments.append((offset + a, offset + b))
        if out.segments:
            out.open.pop(len(out.segments) - 1, None)  # a paragraph's end needs no decision

    def _ends(self, text: str, spans: list[tuple[int, int, bool]]) -> Iterator[tuple[int, Open | None]]:
        marks = [(m.start(), m.end()) for m in _MARKS.finditer(text)]
        if _THAI.search(text):
            spaces = {m.start() for m in _THAI_SPACE.finditer(text)} | {m.start() for m in _THAI_FIRST.finditer(text)}
            marks = sorted([*marks, *((at, at) for at in spaces)])
        reached, several = 0, len(marks) > 1
        for m0, m1 in marks:
            if m0 < reached:
                continue
            found = self._end(text, spans, m0, m1, several)
            if found is not None:
                yield found
                reached = found[0]
        if several and _is_thai(text[-1:]):
            self.counts[_thai_key(text, len(text)), END] += 1
        yield len(text), None

    def _end(self, text: str, spans: list[tuple[int, int, bool]], m0: int, m1: int, several: bool) -> tuple[int, Open | None] | None:
        """(where a sentence ends, None or what is open about that) at the mark text[m0:m1]; None if it doesn't end there."""
        if m0 == m1:  # a space in Thai
            if _within(spans, m1):
                return None
            if _THAI_FIRST.match(text, m1):
                return m1, None
            key = _thai_key(text, m1)
            if (key, OTHER) not in self.counted:
                self.counted.add((key, OTHER))
                self.counts[key, OTHER] += 1
            return m1, Open(key, OTHER, "", False)
        end, closed = m1, None
        while True:  # closing quotes and brackets belong to the sentence, also after a space, as in French
            k = end
            while k < len(text) and text[k] in "   " and k - end < 2:
                k += 1
            span = next((s for s in spans if s[1] == k), None) if k < len(text) and (k == end or text[k] in "»›") else None
            if span is None:
                if end < len(text) and (text[end] == _FILL or text[end] in "’'" and end == m1):
                    end += 1
                    continue
                break
            closed = span if closed is None or span[2] else closed
            end = k + 1
        if _within(spans, end):
            return None
        nxt = _NEXT.match(text, end).end()
        follows = text[nxt] if nxt < len(text) else ""
        mark, before = text[m0:m1], text[m0 - 1] if m0 else ""
        if not follows:
            if mark == "." and several and closed is None:
                self._point(text, m0, "", END)
            return len(text), None
        gap = end < len(text) and text[end].isspace()
        if closed is not None and closed[2]:
            return (end, None) if self._ends_quote(text, closed, end, follows) else None
        if mark[-1] in _WIDE or mark[0] in _WIDE or mark[0] in "।॥|" or "؟" in mark:
            return end, None
        if mark in ";\u037e":
            return (end, None) if gap and (mark == "\u037e" or _script(before) == "greek") else None
        if not gap:
            return (end, None) if any(c in "!?" for c in mark) and _script(follows) == "cjk" and _script(before) in ("cjk", "other") else None
        if any(c in "!?" for c in mark):
            return end, None
        token = re.match(r"\S*", text[nxt:]).group()
        new = self._may_begin(token)
        if closed is not None and mark == "." and new:
            ahead = text[: closed[0]].rstrip()
            if not ahead or ahead[-1] in _ENDING:
                return end, None  # a sentence wholly in brackets
        if len(mark) > 1 or mark == "…":
            return (end, None) if self._ends_dots(text, m0, token, new) else None
        kind = CASELESS if self.caseless else LOW if not new else DIGIT if follows.isdigit() else OTHER
        point = self._point(text, m0, token, kind)
        return None if point is False else (end, None) if point is True else (end, point)

    def _may_begin(self, token: str) -> bool:
        """Whether a sentence may begin with ``token``: not with a lower-case letter, but for a word with a capital right after it, as in product names."""
        first = next((c for c in token if c.isalnum()), "")
        return not first.islower() or self.caseless or bool(_CAMEL.match(token))

    def _ends_quote(self, text: str, span: tuple[int, int, bool], end: int, follows: str) -> bool:
        """Whether a quotation that ends in a mark ends the sentence around it."""
        if _cased(follows) or follows.isdigit() and end < len(text) and text[end].isspace():
            word = re.match(r"\S*", text[_NEXT.match(text, end).end() :]).group()
            return self._may_begin(word) and end < len(text) and text[end].isspace()
        return text[: span[0]].rstrip().endswith((":", "："))

    def _ends_dots(self, text: str, m0: int, token: str, new: bool) -> bool:
        """Whether dots end the sentence: not where it goes on after them."""
        if not new:
            return False
        first = next((c for c in token if c.isalnum()), "")
        mark = max((m.end() for m in _STOP.finditer(text, 0, m0)), default=0)
        words = text[mark:m0].split()
        if first and not _cased(first) and not first.isdigit():
            return len(words) > 3
        word = _TOKEN.match(token)
        return not (len(words) <= 2 and word and word.group() in self.evidence.names and word.group().lower() not in self.evidence.lower)

    def _point(self, text: str, m0: int, token: str, kind: int) -> bool | Open:
        """Whether a sentence ends with the point at ``m0`` where the document says so, else what is open."""
        seen = self.evidence
        found = _WORD_BEFORE.search(text, max(0, m0 - 40), m0)
        if found is None:
            return kind != LOW
        word = unicodedata.normalize("NFC", found.group().replace(_LETTER_FILL, ""))
        last = word.rpartition("-")[2].rpartition("’")[2].rpartition("'")[2] or word
        key, low = key_before(text, found.start(), word, last), last.lower()
        ordinary = low in seen.bare and len(low) > 2 and low.isalpha()
        if kind != CASELESS and (key, kind) not in self.counted:  # once a paragraph, so that repetition within one weighs nothing
            self.counted.add((key, kind))
            self.counts[key, kind] += 1
            if ordinary and len(low) > 3:
                self.counts[_SURE, kind] += 1
        if kind == END:
            return True
        decided = self._by_document(word, low, ordinary, token, kind)
        if decided is not None:
            self.counts[_DECIDED + DOCUMENT, int(decided)] += 1
            return decided
        first = _TOKEN.match(token)
        name = first.group() if first else ""
        if kind == OTHER and name[:1].isupper():
            self.counts[key, NEXT] |= 1 << (zlib.crc32(name.encode()) & 31)
        if kind == LOW:
            form = word.isalpha() and word.islower() and len(word) > 3 and (seen.abbreviations[low] < 2 or low in seen.bare)
        elif _NUMBER.fullmatch(word):
            form = True
        elif len(last) == 1 and last.isalpha() or len(name) > 1 and name.isupper() and low.isalpha() and len(low) < 4 or last.isupper() and len(last) <= 2 and re.match(r"[A-ZÀ-Þ]{1,3}\.", token):
            form = False
        elif _script(word[-1]) == "devanagari":
            form = len(last) > 3
        elif low in seen.abbreviations or "." in last and all(x.isalpha() and len(x) <= 2 for x in last.split(".")):
            form = kind == OTHER and name not in seen.names
        else:
            form = True
        return Open(key, kind, name, form)

    def _by_document(self, word: str, low: str, ordinary: bool, token: str, kind: int) -> bool | None:
        """What the document itself says of a point after ``word``, None if nothing."""
        seen = self.evidence
        if seen.dandas and _script(word[-1]) == "devanagari":
            return False
        if kind == LOW:
            return True if ordinary and len(low) > 3 else None
        if kind == OTHER and (first := _TOKEN.match(token)) and first.group()[0].isupper():
            if len(first.group()) > 1 and first.group().lower() in seen.lower and first.group() not in seen.names:
                return True
        return True if ordinary and kind != DIGIT else None


_ENDING = frozenset(".!?…。！？؟।॥)]»”\";\u037e")
_STOP = re.compile(r"[.!?…؟。।॥][)\]»”\"]*(?=\s)")
_THAI = re.compile("[ก-๛]")
_THAI_SPACE = re.compile("(?<=[ก-๛])\\s")


def _is_thai(c: str) -> bool:
    return "฀" < c < "๜"


def _thai_key(text: str, at: int) -> str:
    """The last three characters before a space, by which the corpus knows whether a Thai sentence ends there."""
    return "_" + text[max(0, at - 3) : at].rpartition(" ")[2]


def _within(spans: list[tuple[int, int, bool]], at: int) -> bool:
    """Whether ``at`` lies inside a quotation or bracket."""
    return any(a < at <= b for a, b, _ in spans)


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents, as far as they are frequent: by key what follows its points, and ordinary words that begin sentences."""

    points: dict[str, tuple[int, ...]] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    sure: tuple[int, int, int, int] = (0, 0, 0, 0)
    """What follows points that surely end sentences."""

    def ends(self, point: Open) -> bool | None:
        """Whether the point ends a sentence, None if the counts don't tell."""
        if point.follows == OTHER and len(point.first) > 1 and point.first[0].isupper() and point.first.lower() in self.common:
            return True
        seen, total = self.points.get(point.key), sum(self.sure)
        if seen is None or not self.sure[END] or total == self.sure[END]:
            return None
        final = self.sure[END] / total
        expected = seen[END] * (1 - final) / final  # points within paragraphs at which a sentence ends
        share = [n / (total - self.sure[END]) for n in self.sure[:END]]
        if point.follows in (LOW, CASELESS):  # of a word that goes on in lower case elsewhere nothing more can be told here
            return False if seen[LOW] > 4 * expected * share[LOW] + 2 else True if seen[END] > 2 else None
        if not seen[END]:
            if seen[NEXT_OF] < FEW and point.follows == OTHER and point.key[-1] != "#":
                return None  # always the same continuation: that may be the writer's habit
            return False if (1 - final) ** (seen[DIGIT] + seen[OTHER]) < DOUBT else None
        n = seen[point.follows]
        ratio = expected * share[point.follows] / max(1, n)
        return True if ratio >= 0.4 else False if ratio < 0.15 and n >= 8 else None


def scan(text: str, counts: Counter) -> Scan:
    """Read one message: what it says by itself, and its share of the corpus counts."""
    out = Scan()
    if spans := own_prose(text):
        paragraphs = [ungarbled(text[a:b]) for a, b in spans]
        reader = Reader(gather(paragraphs), counts)
        for (a, _), p in zip(spans, paragraphs, strict=True):
            reader.read(p, a, out)
        for w in reader.evidence.lower:
            counts[w, LOWER] += 1
        for w in reader.evidence.names:
            counts[w.lower(), NAME] += 1
    return out




def sentences(text: str, corpus: Corpus | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a message's own prose, in code points."""
    found, known = scan(text, Counter()), corpus or Corpus()
    out, start = [], None
    for k, (a, b) in enumerate(found.segments):
        start = a if start is None else start
        point = found.open.get(k)
        ends = True if point is None else known.ends(point)
        if ends or ends is None and point.form:
            out.append((start, b))
            start = None
    return out


def corpus_of(counts: Counter | dict[tuple[str, int], int], least_share: float = LEAST_SHARE) -> Corpus:
    """The model of counts added up over all documents."""
    points: dict[str, list[int]] = {}
    words: dict[str, list[int]] = {}
    for (key, what), n in counts.items():
        if key.startswith("\0") and key != _SURE:
            continue
        if what == NEXT:
            points.setdefault(key, [0] * 5)[NEXT_OF] = n.bit_count()
        elif what < LOWER:
            points.setdefault(key, [0] * 5)[what] += n
        else:
            words.setdefault(key, [0, 0])[what - LOWER] += n
    sure = tuple(points.pop(_SURE, [0] * 4)[:4])
    total, spoken = sum(sum(v[:4]) for v in points.values()), sum(x for x, _ in words.values())
    kept = {k: tuple(v) for k, v in points.items() if len(k) <= LONGEST and sum(v[:4]) >= total * least_share}
    common = frozenset(w for w, (low, name) in words.items() if 1 < len(w) <= LONGEST and low >= max(5, spoken * least_share) and low >= 20 * name)
    return Corpus(kept, common, sure)


SCANNED = "doc_id bigint, starts array<int>, ends array<int>, at array<int>, keys array<string>, follows array<int>, firsts array<string>, forms array<boolean>, word string, what int, n bigint"
_ints, _strings = pa.list_(pa.int32()), pa.list_(pa.string())
_SCANNED_ARROW = pa.schema([("doc_id", pa.int64()), ("starts", _ints), ("ends", _ints), ("at", _ints), ("keys", _strings), ("follows", _ints), ("firsts", _strings), ("forms", pa.list_(pa.bool_())), ("word", pa.string()), ("what", pa.int32()), ("n", pa.int64())])


def _table(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCANNED_ARROW.types, strict=True)], schema=_SCANNED_ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its segments and open points; per task the counts, handed on whenever many have gathered, so that memory stays bounded."""
    counts: Counter = Counter()

    def counted() -> pa.RecordBatch:
        rows = sorted((w, what, n) for (w, what), n in counts.items() if len(w) <= LONGEST)
        counts.clear()
        nothing = [None] * len(rows)
        return _table([*[nothing] * 8, *(list(zip(*rows, strict=True)) or [[], [], []])])

    for batch in batches:
        docs: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid and (found := scan(text.as_py(), counts)).segments:
                points = found.open.values()
                docs.append((doc, *zip(*found.segments, strict=True), list(found.open), [p.key for p in points], [p.follows for p in points], [p.first for p in points], [p.form for p in points]))
            if len(counts) > HELD:
                yield counted()
        if docs:
            nothing = [None] * len(docs)
            yield _table([*zip(*docs, strict=True), nothing, nothing, nothing])
    yield counted()


def _resolved(batch: pa.RecordBatch, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[str, bool]]]:
    """(document row, start, end) of each sentence of a batch of scanned documents, and who decided each open point how."""
    starts, at = batch.column("starts"), batch.column("at")
    size = np.diff(starts.offsets.to_numpy())
    first = np.cumsum(size) - size
    ends = np.ones(int(size.sum()), bool)
    flat = [batch.column(c).flatten().to_pylist() for c in ("keys", "follows", "firsts", "forms")]
    decided: list[tuple[str, bool]] = []
    for key, follows, name, form in zip(*flat, strict=True):
        known = corpus.ends(Open(key, follows, name, form))
        decided.append((FORM, form) if known is None else (CORPUS, known))
    ends[np.repeat(first, np.diff(at.offsets.to_numpy())) + at.flatten().to_numpy()] = [d for _, d in decided]
    begins = np.append(True, ends[:-1])[: len(ends)]
    row = np.repeat(np.arange(len(size)), size)
    return row[ends], starts.flatten().to_numpy()[begins], batch.column("ends").flatten().to_numpy()[ends], decided


def scanned(documents: DataFrame) -> tuple[DataFrame, Corpus, list[tuple[str, bool, int]]]:
    """The documents as read, written once; the corpus model; what the documents decided by themselves."""
    rows = written(documents.select("doc_id", "text").mapInArrow(_scan, SCANNED), "sentence-scan")
    of = lambda *what: F.col("what").isin(*what)
    per = rows.where("word is not null").groupBy("word").agg(*[F.sum(F.when(of(k), F.col("n"))).alias(f"n{k}") for k in range(NEXT)], F.bit_or(F.when(of(NEXT), F.col("n"))).alias(f"n{NEXT}"))
    per = written(per, "sentence-counts")
    points, lower = sum((F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(LOWER)), F.lit(0)), F.coalesce(F.col(f"n{LOWER}"), F.lit(0))
    total = per.where(~F.startswith("word", F.lit("\0"))).agg(F.sum(points).alias("p"), F.sum(lower).alias("w")).first()
    least = lambda c, of_all: (c > 0) & (c >= (of_all or 0) * LEAST_SHARE)
    kept = per.where(least(points, total["p"]) | least(lower, total["w"])).collect()  # at most 1/LEAST_SHARE words in either role
    counts = {(r["word"], k): r[f"n{k}"] for r in kept for k in range(NEXT + 1) if r[f"n{k}"] is not None}
    alone = [(DOCUMENT, bool(k), n) for (w, k), n in counts.items() if w == _DECIDED + DOCUMENT and n]
    return rows.where("word is null").select("doc_id", "starts", "ends", "at", "keys", "follows", "firsts", "forms"), corpus_of(counts), alone


def split_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end): the sentences of every document's own prose."""
    rows, corpus, _ = scanned(documents)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, _ = _resolved(batch, corpus)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema=_ARROW)

    return rows.mapInArrow(split, SENTENCES)


def decisions(documents: DataFrame) -> DataFrame:
    """(decided_by, ends, points): how many points the document, the corpus and mere form have decided, and how."""
    rows, corpus, alone = scanned(documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            tally.update(_resolved(batch, corpus)[3])
        who, n = list(zip(*tally, strict=True)) or [[], []], list(tally.values())
        yield pa.RecordBatch.from_arrays([pa.array(who[0], pa.string()), pa.array(who[1], pa.bool_()), pa.array(n, pa.int64())], names=["decided_by", "ends", "points"])

    shape = "decided_by string, ends boolean, points bigint"
    resolved = rows.mapInArrow(count, shape).unionAll(documents.sparkSession.createDataFrame(alone, shape))
    return resolved.groupBy("decided_by", "ends").agg(F.sum("points").alias("points"))
