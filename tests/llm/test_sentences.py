from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tallymill.llm import sentences as module
from tallymill.llm.sentences import Corpus, corpus_of, decisions, own_prose, scan, scanned, sentences, split_sentences, ungarbled


def counts_of(texts):
    total = Counter()
    for text in texts:
        scan(text, total)
    return total


@pytest.fixture(scope="session")
def learned():
    """The model of an archive of ten thousand messages."""
    archive = Path("/root/testdata/sf0.1/documents.parquet")
    if not archive.exists():
        pytest.skip("no test tables here")
    return corpus_of(counts_of(t for t in pq.read_table(archive, columns=["text"])["text"].to_pylist() if t))


# sentences of a paragraph, joined by a space (or nothing, in scripts without)
PARAGRAPHS = [
    ["Thanks a lot!", "See https://a.example/v.csv?t=58 for a handful of keys."],
    ["The total of $ 75,334.07 was booked at\n11:34 a.m. by R. V. Kempa.", "It ran until 6:21 p.m.", "Call me!"],
    ["We saw hours, rows, etc. with care.", "They listed hours, rows, etc.", "See below."],
    ["Dr. Kru and Mrs. Hov met.", "The U.S. desk left; Approx. 81 rows vs. 32 rows remain, i.e. fewer.", "No. 48 is missing."],
    ["He wrote “Vol is right!” and then left.", "Who said “Is it ready?” since spring?", "The reply was simply “No.”", "See it."],
    ['"Leave it. Nobody will ask," said Nol.', "(The host a.test answered from 198.51.100.1 only.)", "They left."],
    ["It was charged last night…", "iTally 5.19.6 and the view do not agree.", "Hm... maybe it was off."],
    ["„Das reicht. Mehr braucht niemand“, meinte Oss.", "Der 3. Lauf war der letzte.", "Am 7. August trafen sich Dr. Kru und Prof. Pel.", "Wir bleiben bei Fassung 6.", "Vielen Dank!"],
    ["Die Fa. Pel GmbH & Co. KG hat z. B. 75.694,67 Euro, d. h. alles.", "59 Zeilen fehlen am 11. März.", "Na ja … vielleicht."],
    ["« Attendez. Rien ne presse ! » a dit Tir.", "Voir p. ex. https://a.example pour M. Nyra.", "Il manque des lignes, etc.", "Quelle surprise !", "L’art. 3 cite c.-à-d. trop."],
    ["El Sr. Vash y la Dra. Tas llegaron.", "EE. UU. y la zona tienen 32 filas.", "La empresa Zar S. L. pidió el núm. 93.", "¿Y si quedó vacía?", "¡Ya funciona 🎉!"],
    ["Это около 91 тыс. строк и т. д. по списку.", "Нет строк, часов и т. д.", "Пишите на a@b.example.", "Счёт за 1886 г. закрыт.", "Г-н Улло и проф. Мел ушли.", "Ну... посмотрим."],
    ["Μπορείτε να στείλετε;", "Π.χ. η γραμμή ήρθε, κ.λπ. όπως είπε ο κ. Φεν.", "Τέλος."],
    ["قال د. بريلا إن العداد عاد فارغا.", "ربما... العداد وصل متأخرا.", "هل وصل؟", "«انتظر. لن يسأل أحد» هكذا رد بيل."],
    ["बहुत धन्यवाद!", "श्री G. तास के अनुसार सब ठीक है।", "(बाकी संलग्न है।)", "क्या आप देख सकते हैं?"],
    ["ขอบคุณมากค่ะ", "ไฟล์ a.v2.csv อยู่ที่นี่แล้วครับ", "เมื่อคืนนี้ เคมตูทิล เห็นมิเตอร์ใหม่ค่ะ"],
]
THAI_REPORT = ["รายงานระบุว่า มิเตอร์หยุดนับตั้งแต่วันจันทร์", "อย่างไรก็ตาม ร่างใบแจ้งหนี้มียอด 51.5", "นอกจากนี้ ไฟล์ \"เก่า นอกจากนี้ ใหม่\" อยู่ที่ a.v2.csv", "ดังนั้นสำเนายังว่างเปล่า"]
UNSPACED = [
    ["真奇怪！", "莫沙托问：“旧的键在哪里？”", "这是第66号；账单晚到了吗？！", "嗯……也许共享视图晚到了。", "“别动。没人会问！”索洛纳说。", "（其余内容见附件。）", "我们测得8.8GB。"],
    ["本当ですか！？", "「待って。誰も聞かないよ。」とケムさんが言いました。", "うーん…たぶん止まりました。", "（残りは添付をご覧ください。）", "ありがとう。"],
]


@pytest.mark.parametrize(("want", "gap"), [*[(p, " ") for p in PARAGRAPHS], *[(p, "") for p in UNSPACED]])
def test_scripts(want, gap, learned):
    text = "Subject: x\n\n" + gap.join(want) + "\n"
    assert [text[a:b] for a, b in sentences(text, learned)] == want
    if gap:  # a line end alone ends nothing
        wrapped = text.replace(" ", "\r\n")
        assert [wrapped[a:b].split() for a, b in sentences(wrapped, learned)] == [w.split() for w in want]


@pytest.mark.parametrize("gap", [" ", "\r\n"])
def test_thai_connectives_open_sentences(gap):
    text = "\n" + gap.join(THAI_REPORT) + "\n"
    assert [text[a:b] for a, b in sentences(text)] == THAI_REPORT


MESSAGE = """Content-Type: text/plain

Dear all,

No mark at the end

Am 05 Aug schrieb X:
> quoted. text.
Below the quotation. And more
on the next line.

Best, Y
-- 
Y. Z.
"""


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_own_prose(line_end):
    text = MESSAGE.replace("\n", line_end)
    assert [text[a:b].replace("\r\n", "\n") for a, b in sentences(text)] == ["Dear all,", "No mark at the end", "Below the quotation.", "And more\non the next line.", "Best, Y"]


@pytest.mark.parametrize("end", ["-----Original Message-----", "_____", "-- ", "------=_b"])
def test_prose_ends(end):
    text = f"\nMine.\n{end}\nNot mine."
    assert [text[a:b] for a, b in sentences(text)] == ["Mine."]


@pytest.mark.parametrize("header", ["Content-Type: text/html", "Content-Transfer-Encoding: base64", "Content-Transfer-Encoding: Quoted-Printable"])
def test_messages_without_rows(header):
    assert sentences(f"{header}\n\nOne. Two.") == []


def test_multipart_takes_its_first_part():
    text = "Content-Type: multipart/mixed; boundary=b\n\nPreamble.\n--b\n\nOne. Two.\n--b\n\nThree.\n--b--\n"
    assert [text[a:b] for a, b in sentences(text)] == ["One.", "Two."]
    assert sentences(text.replace("--b\n\nOne", "--b\nContent-Type: text/html\n\nOne")) == []


def test_the_document_settles_unknown_abbreviations():
    open_ = "\nWe met Vorst. Kempa again.\n"
    assert len(sentences(open_)) == 2
    known = open_ + "\nThen Vorst. and others came, as Kempa said.\n"
    assert [known[a:b] for a, b in sentences(known)] == ["We met Vorst. Kempa again.", "Then Vorst. and others came, as Kempa said."]
    for counts, pieces in (((0, 0, 40, 0, 9), 2), ((0, 0, 40, 0, 1), 3), ((0, 0, 40, 12, 9), 3), ((2, 0, 3, 0, 2), 3)):
        corpus = Corpus({"vorst": counts}, frozenset(), (20, 30, 900, 300))  # never at a paragraph's end; so, but always before one word; at its ends; too rare
        assert len(sentences(open_ + "\nHere is Kempa.\n", corpus)) == pieces
    assert len(sentences("\nWe met Vorst. Then we left.\n", Corpus({"vorst": (0, 0, 40, 0, 9)}, frozenset({"then"}), (20, 30, 900, 300)))) == 2


def test_garbled_letters_keep_their_places(learned):
    text = "„Läuft wieder“ … é"
    bad = "".join(c if c == " " else c.encode().decode("cp1252", "replace") for c in text)
    assert len(ungarbled(bad)) == len(bad)
    assert ungarbled("Ã¼ber plain é")[0] == "ü"
    text = "\nEl nÃºm. 57 estÃ¡ mal. La empresa X S. L. pidiÃ³ algo.\n"
    assert [text[a:b] for a, b in sentences(text, learned)] == ["El nÃºm. 57 estÃ¡ mal.", "La empresa X S. L. pidiÃ³ algo."]


def test_paragraph_without_capitals(learned):
    text = "\nthe guild of hov taxed weavers for each loom. every 24 years the river floods, etc. and more.\n"
    assert len(sentences(text, learned)) == 2


def test_ordinary_words_end_sentences_before_lower_case_too(learned):
    text = "\nThe rows came late. every year the river floods the delta. and so on?! according to him, approx. 5 of vars. and vars. ago.\n"
    assert [text[a:b].split()[0] for a, b in sentences(text, learned)] == ["The", "every", "and", "according"]


def invented(n):
    """An archive in which Zr. is a title, urt. ends lists, and the word before kl. 7. is always the same; no word of it is in any list."""
    names = ["Abo", "Bek", "Cul", "Dem", "Eno", "Fir", "Gol", "Hap"]
    texts = []
    for k in range(n):
        a, b = names[k % 8], names[k * 3 % 7]
        told = [f"They saw Zr. {a} and the rows.", "The rows hold keys, urt.", f"We asked {b} about keys.", f"It is kl. {k % 9}. Lauf of {a}.", "Some rows, urt. and keys are here."]
        order = [told[(k + i * 2) % 5] for i in range(4)]
        texts.append("\n" + " ".join(order) + "\n\nGreetings\n")
    return texts


def test_the_corpus_tells_titles_from_abbreviations_that_end_sentences():
    corpus = corpus_of(counts_of(invented(300)))
    text = "\nHere Zr. Tem came. Lists, urt. Then kl. 4. Lauf went on, urt. and more.\n"
    assert [text[a:b] for a, b in sentences(text, corpus)] == ["Here Zr. Tem came.", "Lists, urt.", "Then kl. 4. Lauf went on, urt. and more."]
    assert [text[a:b] for a, b in sentences(text)] == ["Here Zr.", "Tem came.", "Lists, urt.", "Then kl.", "4.", "Lauf went on, urt. and more."]


def test_tables_and_decisions(spark):
    rows = [*enumerate(invented(100)), (None, "\nOne. Two."), (100, None), (101, ""), (102, "\n" + "Word. " * 5000), (5, "\nSame. "), (5, "\nSame. "), (103, "\na\0b. C\0. D.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as sent_start", "2 as word", "3 as n")
    got = split_sentences(docs).collect()
    corpus = scanned(docs)[1]
    assert sorted(map(tuple, got), key=repr) == sorted(((doc, a, b) for doc, t in rows if t for a, b in sentences(t, corpus)), key=repr)
    assert sum(r["doc_id"] == 102 for r in got) == 5000 and sum(r["doc_id"] is None for r in got) == 2
    decided = {(r["decided_by"], r["ends"]): r["points"] for r in decisions(docs).collect()}
    assert decided["document", True] > 100 and decided["corpus", False] > 100
    assert split_sentences(docs.limit(0)).count() == 0 and decisions(docs.limit(0)).count() == 0


def test_document_and_corpus_decide_an_archive(learned, monkeypatch):
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:2000] if t]
    split = lambda corpus: Counter((k, *s) for k, t in enumerate(texts) for s in sentences(t, corpus))
    share = lambda got: sum((got & whole).values()) / sum(whole.values())
    whole, tally, counts = split(learned), Counter(), Counter()
    for t in texts:
        for point in scan(t, counts).open.values():
            tally["form" if learned.ends(point) is None else "corpus"] += 1
    by_document = sum(n for (k, _), n in counts.items() if k == module._DECIDED + module.DOCUMENT)
    assert by_document > 2 * tally["form"] and by_document + tally["corpus"] > 10 * tally["form"]
    assert share(split(Corpus())) < 0.92  # form alone, with what the documents show, is not enough


def test_the_corpus_does_not_depend_on_partitions(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(invented(200))), "doc_id bigint, text string").repartitionByRange(4, "doc_id")
    one, many = scanned(docs.coalesce(1))[1], scanned(docs)[1]
    assert one == many == corpus_of(counts_of(invented(200)))
    monkeypatch.setattr(module, "HELD", 3)
    assert scanned(docs)[1] == one


def test_spans_are_in_code_points():
    text = "\n🙂🙂 Fine. Ünd so.\n"
    assert [(a, b) for a, b in sentences(text)] == [(1, 9), (10, 17)]
    assert own_prose("") == []
