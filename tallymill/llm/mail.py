"""The text parts of archived mail: headers, multipart structure, transfer encodings, charsets and HTML undone.

Nothing here raises on broken mail: what can't be decoded is replaced, a missing end boundary ends the message, cut-off
base64 gives what it still holds.
"""

from __future__ import annotations

import binascii
import re
from dataclasses import dataclass
from html import unescape

#: The end of a header block is a line with nothing in it; one with only white space is folded onto the field above.
_BLANK_LINE = re.compile(r"\n\r?\n|\r\r")
_FOLD = re.compile(r"(?:\r\n|\n|\r)[ \t]+")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:[ \t]*(.*?)[ \t\r]*$", re.I | re.M)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^;\s]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([^\s";]+)', re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
#: Elements that run within a line, so that removing their tags joins what stands on both sides.
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[!?/A-Za-z][^<>]*>")


@dataclass(frozen=True)
class Part:
    kind: str
    """Media type in lower case; text/plain where the header is missing."""
    params: str
    encoding: str
    start: int
    end: int
    """The body is text[start:end], still encoded."""
    depth: int = 0
    """Multipart levels above the part."""


def _headers(text: str, start: int, end: int) -> tuple[str, str, str, int]:
    """(media type, whole Content-Type value, transfer encoding, where the body starts)."""
    first = text[start : start + 2]
    if first[:1] == "\n" or first == "\r\n":
        return "text/plain", "", "", start + (1 if first[:1] == "\n" else 2)
    blank = _BLANK_LINE.search(text, start, end)
    head, body = (text[start : blank.start()], blank.end()) if blank else (text[start:end], end)
    kind, params, encoding = "", "", ""
    for field in _FIELD.finditer(_FOLD.sub(" ", head)):
        name, value = field.group(1).lower(), field.group(2)
        if name == "content-type" and not params:
            kind, params = value.partition(";")[0].strip().lower(), value
        elif name != "content-type" and not encoding:
            encoding = value.strip().lower()
    return kind or "text/plain", params, encoding, body


def parts(text: str, start: int = 0, end: int | None = None, depth: int = 0) -> list[Part]:
    """The leaf parts of the message (or part) in text[start:end], in order."""
    end = len(text) if end is None else end
    kind, params, encoding, body = _headers(text, start, end)
    if kind.startswith("multipart/") and depth < 20 and (named := _BOUNDARY.search(params)):
        mark = re.compile(r"^--" + re.escape(named.group(1) or named.group(2) or "") + r"(--)?[ \t]*\r?$", re.M)
        found: list[Part] = []
        at = None
        for line in mark.finditer(text, body, end):
            if at is not None:
                found += parts(text, at, _before_line(text, line.start()), depth + 1)
            at = None if line.group(1) else min(line.end() + 1, end)
            if at is None:
                break
        if at is not None:
            found += parts(text, at, end, depth + 1)
        return found
    if kind == "message/rfc822" and depth < 20:
        return parts(text, body, end, depth + 1)
    return [Part(kind, params, encoding, body, max(body, end), depth)]


def _before_line(text: str, at: int) -> int:
    """Where the line end before a boundary begins; that line end belongs to the boundary."""
    if at and text[at - 1] == "\n":
        at -= 1
    if at and text[at - 1] == "\r":
        at -= 1
    return at


def decoded(text: str, part: Part) -> str:
    """The part's content with transfer encoding and charset undone."""
    body = text[part.start : part.end]
    if part.encoding == "base64":
        letters = _NOT_BASE64.sub("", body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        raw = binascii.a2b_base64(letters + "=" * (-len(letters) % 4))
    elif part.encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "replace"))
    else:
        if "\x1b" not in body or not body.isascii():
            return body
        raw = body.encode()
    named = _CHARSET.search(part.params)
    charset = named.group(1) if named else "utf-8"
    try:
        return raw.decode(charset)
    except (LookupError, UnicodeDecodeError):
        pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            return raw.decode(charset, "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")


def without_markup(html: str) -> str:
    """What a reader sees: tags within a line vanish, others become line ends, references become characters."""
    html = _UNSEEN.sub(" ", html)
    return unescape(_TAG.sub("\n", _INLINE.sub("", html)))


def text_parts(text: str | None) -> list[str]:
    """The readable text of each text/plain and text/html part, attached files included."""
    if not text:
        return []
    out = []
    for part in parts(text):
        if part.kind == "text/plain":
            out.append(decoded(text, part))
        elif part.kind == "text/html":
            out.append(without_markup(decoded(text, part)))
    return out
