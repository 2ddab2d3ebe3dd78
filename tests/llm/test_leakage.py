import random
import unicodedata

import numpy as np
import regex

from tallymill.llm import leakage
from tallymill.llm.leakage import LETTERS, WORDS, leaks, normal, suffix_array, without_leaks

R = random.Random(5)
WORD = [f"w{i}" for i in range(60)] + ["été", "Straße", "İstanbul", "नमस्ते"]
PASSAGES = [" ".join(R.choice(WORD) for _ in range(R.randrange(8, 40))) for _ in range(8)]
HAN = "".join(chr(0x4E00 + R.randrange(300)) for _ in range(80))
ITEMS = [(k, "en", p, PASSAGES[-k - 1] if k % 2 else None) for k, p in enumerate(PASSAGES)] + [(50, "zh", HAN[:40], HAN[40:]), (51, "ja", "short", None), (52, None, None, ""), (None, "en", PASSAGES[0], None)]


def spoiled(words):
    words = unicodedata.normalize(R.choice(["NFC", "NFD"]), " ".join(words)).split()
    return "".join((w.upper() if R.random() < 0.2 and "i" not in w.lower() and "ß" not in w else w) + R.choice([" ", "\n> ", " - ", "_", "\r\n"]) for w in words)


def documents():
    docs = []
    for k in range(150):
        bits = []
        for _ in range(R.randrange(4)):
            p = R.choice(PASSAGES).split()
            a = R.randrange(len(p))
            bits.append(spoiled(p[a : a + R.randrange(9, 20)]))
            bits.append(" ".join(R.choice(WORD) for _ in range(R.randrange(5))) + " other. ")
        if R.random() < 0.2:
            a = R.randrange(60)
            bits.append(" ,".join(HAN[a : a + R.randrange(18, 30)]))
        docs.append((k, "Subject: x\n\n" + "".join(bits)))
    third = [(1000 + k, f"Content-Type: text/html\n\n<p>{PASSAGES[3].replace(' ', '</p><p>')}</p>") for k in range(60)]
    return docs + third + [(None, "\n" + PASSAGES[3]), (7, None), (8, ""), (2000, "\n" + "w1 " * 3000), (3000, docs[0][1]), (3000, docs[0][1])]


def brute(docs):
    word, letter = regex.compile(r"[\p{L}\p{M}\p{Nd}]+"), regex.compile(r"[\p{L}\p{Nd}]")
    from tallymill.llm.mail import text_parts

    out = []
    for doc, text in docs:
        found = set()
        for part in text_parts(text):
            for item, lang, *fields in ITEMS:
                if item is None:
                    continue
                for f in fields:
                    cut, n = (letter, LETTERS) if lang in ("zh", "ja") else (word, WORDS)
                    a, b = cut.findall(normal(part)), cut.findall(normal(f or ""))
                    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
                    if any(tuple(a[i : i + n]) in runs for i in range(len(a) - n + 1)):
                        found.add(item)
        out += [(doc, i) for i in found]
    return out


def frames(spark, docs, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string")


def test_equals_brute_force(spark):
    docs = documents()
    d, i = frames(spark, docs)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(brute(docs), key=key)
    assert len(want) > 100
    got = leaks(d.withColumn("units", d.doc_id), i)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=key) == want
    blocks = leaks(d, i, block_chars=200)
    assert sorted(((r["doc_id"], r["item_id"]) for r in blocks.collect()), key=key) == want
    clean = without_leaks(d, i)
    assert sorted(r[0] for r in clean.where("doc_id is not null").select("doc_id").collect()) == sorted(k for k, _ in docs if k is not None and k not in {w for w, _ in want})


def test_longest_run_and_its_place(spark):
    text = "\na b c " + " ".join(PASSAGES[2].split()[2:]) + " tail"
    d, i = frames(spark, [(1, text)], [(9, "en", PASSAGES[2], None)])
    r = leaks(d, i).first()
    assert (r["units"], r["doc_unit"], r["item_unit"], r["field"]) == (len(PASSAGES[2].split()) - 2, 3, 2, "passage")


def test_text_that_repeats_itself(monkeypatch):
    tests = [leakage.item_texts([(9, "passage", "la " * 3000), (10, "passage", "la " * 12 + "end")], False)]
    docs = [(1, 0, "la " * 4000, 1), (2, 0, "la " * 11, 2), (3, 0, "la " * 12, 3)]
    for most in (10**9, 1000):
        monkeypatch.setattr(leakage, "LISTED", most)
        got = leakage._shard(docs, tests).to_pylist()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 9), (1, 10), (3, 9), (3, 10)}
    assert max(r["units"] for r in leakage._shard(docs, tests).to_pylist()) >= 12


def test_longest_run_of_texts_that_repeat_themselves():
    tests = [leakage.item_texts([(9, "passage", "la " * 3000)], False)]
    (row,) = leakage._shard([(1, 0, "la " * 10_000, 1)], tests).to_pylist()
    assert (row["units"], row["doc_unit"], row["item_unit"]) == (3000, 0, 0)


def test_longest_runs_do_not_depend_on_how_many_are_listed(monkeypatch):
    r = random.Random(8)
    periodic = lambda: " ".join((r.choice(["a b", "a", "a a b", "b a"]) + " ") * r.randrange(2, 20) + r.choice(["", "c", "x"]) for _ in range(r.randrange(1, 6)))
    docs, items = [(k, 0, periodic(), k) for k in range(12)], [(k, "passage", periodic()) for k in range(10)]

    def longest(x, y):
        best, row = 0, [0] * (len(y) + 1)
        for u in x:
            row = [0] + [row[j] + 1 if u == v else 0 for j, v in enumerate(y)]
            best = max(best, *row)
        return best

    want = {(d, i): n for d, _, x, _ in docs for i, _, y in items if (n := longest(x.split(), y.split())) >= WORDS}
    assert len(want) > 20
    got = []
    for most in (10**9, 1000, 7):
        monkeypatch.setattr(leakage, "LISTED", most)
        got.append(leakage._shard(docs, [leakage.item_texts(items, False)]).to_pylist())
        assert {(r["doc_id"], r["item_id"]): r["units"] for r in got[-1]} == want
        assert all(docs[r["doc_id"]][2].split()[r["doc_unit"] :][: r["units"]] == items[r["item_id"]][2].split()[r["item_unit"] :][: r["units"]] for r in got[-1])
    assert got[0] == got[1] == got[2]


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "\n" + PASSAGES[0])])
    assert leaks(d.limit(0), i).count() == leaks(d, i.limit(0)).count() == 0
    assert without_leaks(d, i.limit(0)).count() == 1


def test_suffix_array():
    ids = np.random.default_rng(1).integers(0, 3, 300)
    starts = np.arange(280)
    got = suffix_array(ids, starts, 12)
    assert [tuple(ids[k : k + 12]) for k in got] == sorted(tuple(ids[k : k + 12]) for k in starts)


def test_suffixes_are_sorted_to_their_full_length():
    ids = np.append(np.tile([1, 2, 1, 1], 200), 0)
    starts = np.arange(700)
    got = suffix_array(ids, starts, len(ids))
    assert [tuple(ids[k:]) for k in got] == sorted(tuple(ids[k:]) for k in starts)


def test_words_that_only_share_a_hash_are_no_match(monkeypatch):
    hashes = leakage._word_hashes
    monkeypatch.setattr(leakage, "_word_hashes", lambda codes, cls: (hashes(codes, cls)[0] % np.uint64(3), hashes(codes, cls)[1]))
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = text(40)
    docs = [(1, 0, text(400), 1), (2, 0, passage, 2)]
    got = leakage._shard(docs, [leakage.item_texts([(9, "passage", passage)], False)]).to_pylist()
    assert [(x["doc_id"], x["units"]) for x in got] == [(2, 40)]
    assert leakage.words(leakage.normal("Ärger, 3 Ärzte – x_y")) == ["ärger", "3", "ärzte", "x", "y"]
    assert leakage.longest_equal(list("abcdx"), list("abzdx")) == (0, 2) and leakage.longest_equal(["a"], ["b"]) == (0, 0)
