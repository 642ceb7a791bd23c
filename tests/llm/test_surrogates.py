"""Surrogates: kind, format, coreference, distinctness and collisions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from footfall.llm import surrogates as sg

KEY = "a key for tests"
DOCS = "doc_id long, text string"
CASES = {
    "email": "Anna.Smith+x@Mail7.example.com",
    "phone": "+1 (017) 555-7713",
    "card": "4539 1488 0343 6467",
    "ip": "203.0.113.77",
    "ssn": "123-45-6789",
    "iban": "DE89 3704 0044 0532 0130 00",
}


def _texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def _luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10


def test_format_is_kept(spark):
    got = _texts(sg.digest(spark.createDataFrame([(i, f"a {v}, b") for i, v in enumerate(CASES.values())], DOCS), KEY))
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    for i, (kind, value) in enumerate(CASES.items()):
        text = got[i]
        assert shape(text) == shape(f"a {value}, b") and value not in text, kind
        assert re.fullmatch(f"a {re.escape(text[2:-3])}, b", text)
    assert got[0].endswith(".com, b") and got[1].startswith("a +1 (") and _luhn(got[2]) == _luhn(CASES["card"]) == 0
    assert all(0 <= int(o) <= 255 for o in got[3][2:-3].split(".")) and got[5].startswith("a DE")


def test_names_keep_gender_and_script(spark):
    rows = [(1, "Yesterday Laura Bennett met Peter Grant."), (2, "Вера Соколова и Иван Соколов."), (3, "Laura Bennett again")]
    got = _texts(sg.digest(spark.createDataFrame(rows, DOCS), KEY))
    first = re.fullmatch(r"Yesterday (\w+) ([\w-]+) met (\w+) ([\w-]+)\.", got[1])
    assert first[1] in sg.GIVEN["female_latin"].split() and first[3] in sg.GIVEN["male_latin"].split()
    second = re.fullmatch(r"(\w+) ([\w-]+) и (\w+) ([\w-]+)\.", got[2])
    assert second[1] in sg.GIVEN["female_cyrillic"].split() and second[4] in sg.FAMILY["male_cyrillic"].split()
    assert got[3] == f"{first[1]} {first[2]} again"


def test_coreference_and_key(spark):
    rows = [(1, "call +1 (017) 555-7713 or +1 017-555-7713"), (2, "X@Example.com x@example.com"), (None, "x@example.com")]
    docs = spark.createDataFrame(rows, DOCS)
    got = _texts(sg.digest(docs, KEY))
    a, b = re.findall(r"\+1[^o]*\d", got[1])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    x, y = got[2].split()
    assert x.lower() == y == got[None] and x[0].isupper()
    assert _texts(sg.digest(docs, KEY)) == got and _texts(sg.digest(docs, "another")) != got


def test_distinct_entities_stay_distinct(spark):
    """More names than there are pairs of one given and one family name, so many must try again."""
    given, rows = sg.GIVEN["female_latin"].split(), []
    for i in range(900):
        family = "".join(chr(97 + int(c)) for c in f"{i:04d}").capitalize()
        rows.append((i, f"{given[i % 20]} {family}"))
    rows += [(1000 + i, r[1]) for i, r in enumerate(rows[:50])]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (200_000, 0):
        got = {r.doc_id: r.text for r in sg.replace(docs, KEY, broadcast_rows=limit).collect()}
        real = {t for _, t in rows}
        assert len({got[i] for i in range(900)}) == 900 and not real & set(got.values())
        assert all(got[1000 + i] == got[i] for i in range(50))


def test_clean_texts_stay(spark, small, small_rows, odd, odd_rows, none):
    got = {r.doc_id: r for r in sg.digest(spark.read.parquet(f"{small}/documents.parquet"), KEY).collect()}
    assert len(got) == len(small_rows)
    personal = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![0-9A-Za-z])\d{16}(?![0-9A-Za-z])|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    for r in small_rows:
        mine = personal.findall(r["text"])
        if not mine and not got[r["doc_id"]].n_entities:
            assert got[r["doc_id"]].text == r["text"]
        assert len(got[r["doc_id"]].text) == len(r["text"]) or got[r["doc_id"]].n_name
        assert got[r["doc_id"]].n_entities >= len(mine)
        assert not any(m in got[r["doc_id"]].text for m in mine)
    clashing = odd.withColumns({c: F.lit(1) for c in ("kind", "form", "value", "attempt", "plain")})
    same = sg.replace(clashing, KEY).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in same))) == sorted(str((r[0], r[1])) for r in odd_rows)
    assert sg.replace(clashing, KEY).columns == [*clashing.columns, "__kinds"] and sg.replace(none, KEY).collect() == []


def test_names_behind_titles(spark):
    rows = [
        (1, "We met Mr. Quillon and Mrs. Ysolde Tarn-Abbot today."),
        (2, "Dr Vexley said my name is Orsolya Kempf."),
        (3, "Госпожа Ярцева и господин Тур."),
        (4, "Mr. Peter Grant, or Peter Grant"),
        (5, "mr. Quillon, the name is short, Sir and Dr. no"),
    ]
    got = _texts(sg.digest(spark.createDataFrame(rows, DOCS), KEY))
    family = lambda group, name: all(n in sg.FAMILY[group].split() for n in name.split("-"))
    first = re.fullmatch(r"We met Mr\. (\S+) and Mrs\. (\w+) (\S+) today\.", got[1])
    assert family("male_latin", first[1]) and first[2] in sg.GIVEN["female_latin"].split() and family("female_latin", first[3])
    second = re.fullmatch(r"Dr (\S+) said my name is (\w+) (\S+)\.", got[2])
    assert family("any_latin", second[1]) and second[2] in sg.GIVEN["any_latin"].split()
    third = re.fullmatch(r"Госпожа (\S+) и господин (\S+)\.", got[3])
    assert family("female_cyrillic", third[1]) and family("male_cyrillic", third[2])
    fourth = re.fullmatch(r"Mr\. (.+), or (.+)", got[4])
    assert fourth[1] == fourth[2] != "Peter Grant"
    assert got[5] == rows[4][1]


def test_cards_of_other_lengths(spark):
    """13, 15 and 19 digits with a right check digit are cards; with a wrong one they stay."""
    bodies = {13: "422222222222", 15: "37828224631000", 19: "601100099013942400"}
    cards = {n: next(b + str(d) for d in range(10) if _luhn(b + str(d)) == 0) for n, b in bodies.items()}
    amex = f"{cards[15][:4]} {cards[15][4:10]} {cards[15][10:]}"
    rows = [(n, f"card {c}.") for n, c in cards.items()] + [(100 + n, f"card {c[:-1]}{(int(c[-1]) + 1) % 10}.") for n, c in cards.items()]
    rows += [(1, f"{amex} is {cards[15]}"), (2, "1" * 20)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in sg.digest(docs, KEY).collect()}
    for n, c in cards.items():
        new = got[n].text[5:-1]
        assert new != c and len(new) == n and _luhn(new) == 0 and got[n].n_card == 1
    spaced, plain = got[1].text.split(" is ")
    assert re.fullmatch(r"\d{4} \d{6} \d{5}", spaced) and spaced.replace(" ", "") == plain == got[15].text[5:-1]
    assert all(got[i].text == t and not got[i].n_entities for i, t in rows if i > 100 or i == 2)
