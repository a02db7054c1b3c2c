import random
import re

import pytest

from tessera.llm import pii

F = pii.Feistel(b"k")


@pytest.mark.parametrize("n", [2, 7, 100, 997])
def test_permutation_and_inverse(n):
    image = [F.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n))
    assert [F.permute(y, n, "t", back=True) for y in image] == list(range(n))


TEXTS = [
    "call +1 (017) 555-7713 now", "card 4845168114407329 or 4845 1681 1440 7329.", "ip 97.51.17.173, von.34@mail7.example.com###",
    "iban GB82 WEST 1234 5698 7654 32", "on 2024-02-29 and 29.02.2024 and 12/31/1999", "ssn 123-45-6789", "la.é3@mail2.example.org",
]


@pytest.mark.parametrize("text", TEXTS)
def test_format_is_kept_and_undone(text):
    new, spans = pii.pseudonymise(text, F)
    assert spans and new != text
    shape = lambda s: re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d+(?=[.\s,]|$)", "9", re.sub(r"\d", "9", s))))
    assert shape(new).replace("99", "9")[:4] == shape(text).replace("99", "9")[:4]
    assert pii.pseudonymise(new, F, back=True)[0] == text


def test_equal_values_stay_linked_and_valid():
    one, _ = pii.pseudonymise("a 4845168114407329 b", F)
    two, _ = pii.pseudonymise("4845-1681-1440-7329", F)
    digits = re.search(r"\d{16}", one)[0]
    assert re.sub(r"\D", "", two) == digits
    assert pii.luhn_digit(digits[:-1]) == digits[-1]


@pytest.mark.parametrize("text", ["4845168114407328", "300.1.2.3", "version 1.2.3", "2023-02-30", "32.13.2020", "", "no data", "666-12-1234", "0000000000000000"])
def test_invalid_values_stay(text):
    assert pii.pseudonymise(text, F) == (text, [])


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"), ("x 4111111111111111 123", "card", "4111111111111111"), ("4845168114407329 7 items", "card", "4845168114407329"),
        ("4111-1111-1111-1111-12345", "card", "4111-1111-1111-1111"), ("to ES91 2100 0418 4502 0005 1332 IN full", "iban", "ES91 2100 0418 4502 0005 1332"),
        ("IBAN ES9121000418450200051332 EUR", "iban", "ES9121000418450200051332"), ("ES91 2100 0418 4502 0005 1332 INVOICE 7", "iban", "ES91 2100 0418 4502 0005 1332"),
        ("+1 (017) 555-7713 2024", "phone", "+1 (017) 555-7713"), ("+1 017 555 7713 2024 12", "phone", "+1 017 555 7713"), ("+49 30-1234-5678 2024", "phone", "+49 30-1234-5678"),
        ("+49 30 1234 5678", "phone", "+49 30 1234 5678"),
    ],
)
def test_value_before_another_number(text, kind, value):
    new, spans = pii.pseudonymise(text, F)
    at = text.index(value)
    assert spans == [(kind, at, at + len(value))]
    assert new == text.replace(value, pii.pseudonymise(value, F)[0]) != text
    assert pii.pseudonymise(new, F, back=True)[0] == text


def test_cards_before_other_digits_come_back():
    r = random.Random(3)
    for _ in range(500):
        payload = "".join(r.choice("0123456789") for _ in range(r.choice((12, 14, 15))))
        card = payload + pii.luhn_digit(payload)
        text = f"{card} {r.randrange(1000)} x"
        new, spans = pii.pseudonymise(text, F)
        assert len(spans) == 1 and pii.pseudonymise(new, F, back=True)[0] == text


def test_frame(spark):
    rows = [(1, "x 97.51.17.173", "a"), (2, None, "b"), (2, "", "b"), (None, "97.51.17.173 " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.replace_pii(docs, b"k")
    assert out.schema == docs.schema
    got = out.collect()
    assert [r[0] for r in got] == [1, 2, 2, None] and [r.text for r in got[1:3]] == [None, ""]
    ip = got[0].text[2:]
    assert got[3].text == f"{ip} " * 3000
    spans = pii.pii_spans(docs, b"k").collect()
    assert spans[0].text[spans[0].spans[0].start : spans[0].spans[0].end] == ip and len(spans[3].spans) == 3000
    assert [tuple(r) for r in pii.replace_pii(out, b"k", back=True).collect()] == rows
    assert pii.replace_pii(docs.limit(0)).count() == 0
