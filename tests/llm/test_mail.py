import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallymill.llm.mail import parts, text_parts, without_markup


def test_plain_message():
    assert text_parts("From: a@b.example\nSubject: x\n\nHello\n") == ["Hello\n"]
    assert text_parts("From: a@b.example\r\nSubject: x\r\n\r\nHello\r\n") == ["Hello\r\n"]
    assert text_parts(None) == text_parts("") == []
    assert text_parts("Subject: only headers") == [""]
    assert text_parts("\nno headers") == ["no headers"]


def test_white_space_lines_belong_to_the_field_above():
    assert text_parts("Received: a\n\t\nContent-Type: text/html\n\n<p>x</p>") == ["\nx\n"]


@pytest.mark.parametrize("charset", ["koi8-r", "windows-1251", "utf-8", "UTF-8"])
def test_encodings(charset):
    text = "Пишите на склад."
    b64 = base64.encodebytes(text.encode(charset)).decode()
    qp = "".join(f"={b:02X}" for b in text.encode(charset))
    for encoding, body in (("base64", b64), ("BASE64", b64), ("quoted-printable", qp)):
        assert text_parts(f'Content-Type: text/plain; charset="{charset}"\nContent-Transfer-Encoding: {encoding}\n\n{body}') == [text]


def test_folded_headers_and_unknown_charsets():
    assert text_parts("Content-Type: text/plain;\n charset=klingon\ncontent-transfer-encoding:\n base64\n\naGk=") == ["hi"]
    assert text_parts("Content-Type: text/plain; charset=us-ascii\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("é".encode()).decode()) == ["é"]


def test_cut_off_base64():
    whole = base64.b64encode(b"some longer text").decode()
    for n in range(len(whole)):
        got = text_parts("Content-Transfer-Encoding: base64\n\n" + whole[:n])[0]
        assert "some longer text".startswith(got.rstrip("�"))


MULTI = """Content-Type: multipart/mixed; boundary="b1"

preamble
--b1
Content-Type: multipart/alternative; boundary=b2

--b2
Content-Type: text/plain

one
--b2
Content-Type: text/html; charset=utf-8

<p>two&amp;</p>
--b2--
--b1
Content-Type: image/png
Content-Transfer-Encoding: base64

AAAA
--b1
Content-Disposition: attachment; filename=a.txt
Content-Type: text/plain

> quoted
--b1--
epilogue
"""


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_multipart(line_end):
    text = MULTI.replace("\n", line_end)
    assert [t.strip() for t in text_parts(text)] == ["one", "two&", "> quoted"]
    assert [(p.kind, p.depth) for p in parts(text)] == [("text/plain", 2), ("text/html", 2), ("image/png", 1), ("text/plain", 1)]
    cut = text[: text.index("> quoted") + 4]
    assert text_parts(cut)[-1] == "> qu"


def test_markup():
    assert without_markup("<style>p { a }</style><p>A <b>wo</b>rd &#233;<br>next<!-- no --></p>").split() == ["A", "word", "é", "next"]
    assert without_markup("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


@given(st.text(alphabet="-=: ;b1\r\n\tContent-Type: multipart/mixed; boundary=b", max_size=300))
def test_nothing_breaks_it(text):
    text_parts("Content-Type: multipart/mixed; boundary=b\n\n" + text)
    text_parts(text)
