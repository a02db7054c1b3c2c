"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's format."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text

#: Key of the registered query and of tests; a production run passes its own.
DEMO_KEY = b"a key of one's own belongs here"
ROUNDS = 8
SLICE_BYTES = 8 << 20
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Alphabets that a character of an address stays within; others are kept.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)
           |  (?<![\w.+-])(?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\d-]))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<iso>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-]))
  | (?P<date>(?<![\d./-])\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)\d{4}(?![\d/-]))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
  | (?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d))
    """,
    re.VERBOSE,
)


#: A telephone's country code, kept as it is.
HEAD = re.compile(r"\+\d{1,3}(?=[ .(-])|\+\d|")
#: Characters of an IBAN by country (ISO 13616).
IBAN_SIZES = {
    country: int(size)
    for size, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
        "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}


class Feistel:
    """Keyed permutations of 0..n-1 for any n: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self._late_days: list[int] = []

    def late_days(self) -> list[int]:
        """Days since FIRST_DAY whose day of the month is over 12."""
        if not self._late_days:
            self._late_days = [n for n in range((LAST_DAY - FIRST_DAY).days + 1) if (FIRST_DAY + datetime.timedelta(n)).day > 12]
        return self._late_days

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        mask, size = (1 << half) - 1, (half + 7) // 8
        rounds = range(ROUNDS)[:: -1 if back else 1]
        while True:
            left, right = x >> half, x & mask
            for r in rounds:
                if back:
                    left, right = right ^ self._round(r, left, size, n, tweak) & mask, left
                else:
                    left, right = right, left ^ self._round(r, right, size, n, tweak) & mask
            x = left << half | right
            if x < n:
                return x

    def _round(self, r: int, half: int, size: int, n: int, tweak: str) -> int:
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(half.to_bytes(size, "big"), key=self.key, person=hashlib.blake2b(f"{tweak}|{n}|{r}|{block}".encode(), digest_size=16).digest()).digest()
            block += 1
        return int.from_bytes(out[:size], "big")


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _into(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in shape)


def _decimal(f: Feistel, digits: str, tweak: str, back: bool) -> str:
    return str(f.permute(int(digits), 10 ** len(digits), tweak, back)).zfill(len(digits))


def _card(f: Feistel, found: str, back: bool) -> str | None:
    """Also keeps the sum that digits behind the card would meet, so that a longer run of digits is a card
    after the change if and only if it was one before, and the same length is taken on the way back."""
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload, other = digits[:-1], luhn_digit(digits)
    while True:
        payload = _decimal(f, payload, "card", back)
        new = payload + luhn_digit(payload)
        if luhn_digit(new) == other and len(set(new)) > 1:
            return _into(found, new)


def _phone(f: Feistel, found: str, back: bool) -> str | None:
    head = HEAD.match(found)[0]
    rest = found[len(head) :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return head + _into(rest, _decimal(f, digits, "phone", back))


def _ip(f: Feistel, found: str, back: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(f: Feistel, found: str, back: bool) -> str | None:
    area, group, serial = (int(x) for x in found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    x = f.permute((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", back)
    place, x = divmod(x, 99 * 9999)
    return f"{place + 1 + (place >= 665):03d}-{x // 9999 + 1:02d}-{x % 9999 + 1:04d}"


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _characters(f: Feistel, text: str, tweak: str, back: bool) -> str:
    place = [next((a for a in ALPHABETS if c in a), None) for c in text]
    x = n = 0
    n = 1
    for c, a in zip(text, place, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    x = f.permute(x, n, tweak, back)
    out = []
    for c, a in zip(reversed(text), reversed(place), strict=True):
        if a:
            x, i = divmod(x, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _iban(f: Feistel, found: str, back: bool) -> str | None:
    text = found.replace(" ", "")
    if not 15 <= len(text) <= 34 or _iban_check(text[:2], text[4:]) != text[2:4]:
        return None
    account = _characters(f, text[4:], "iban", back)
    flat = iter(text[:2] + _iban_check(text[:2], account) + account)
    return "".join(c if c == " " else next(flat) for c in found)


def _email(f: Feistel, found: str, back: bool) -> str:
    local, host = found.split("@")
    labels = host.rsplit(".", 1)
    return f"{_characters(f, local, 'local', back)}@{_characters(f, labels[0], 'host', back)}.{labels[1]}"


def _day(f: Feistel, year: str, month: str, day: str, back: bool) -> datetime.date | None:
    try:
        value = datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    if not FIRST_DAY <= value <= LAST_DAY:
        return None
    return FIRST_DAY + datetime.timedelta(f.permute((value - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date", back))


def _iso(f: Feistel, found: str, back: bool) -> str | None:
    day = _day(f, found[:4], found[5:7], found[8:], back)
    return day and day.isoformat()


def _date(f: Feistel, found: str, back: bool) -> str | None:
    """dd.mm.yyyy; with / or - month first where only that is a date.  Both figures get two digits."""
    mark = re.search("[./-]", found)[0]
    first, second, year = found.split(mark)
    if day := _day(f, year, second, first, back):
        return f"{day.day:02d}{mark}{day.month:02d}{mark}{day.year}"
    # month first with a day over 12: permuted among such days, so that it still reads month first
    days = f.late_days() if mark != "." and int(second) > 12 else []
    try:
        own = (datetime.date(int(year), int(first), int(second)) - FIRST_DAY).days
        at = days.index(own)
    except ValueError:
        return None
    day = FIRST_DAY + datetime.timedelta(days[f.permute(at, len(days), "month first", back)])
    return f"{day.month:02d}{mark}{day.day:02d}{mark}{day.year}"


KINDS: dict[str, Callable[[Feistel, str, bool], str | None]] = {"email": _email, "phone": _phone, "iban": _iban, "iso": _iso, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def _ends(kind: str, found: str) -> list[int]:
    """Lengths of a find that may be the value, in the order to try; a shorter one ends before a separator.

    Only the format decides on the order of telephones and IBANs, so the way back takes the same one.
    """
    if kind not in ("phone", "iban", "card"):
        return [len(found)]
    ends = [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] in " .-" and found[i - 1].isalnum())]
    if kind == "iban":
        full = IBAN_SIZES.get(found[:2])
        return sorted(ends, key=lambda e: len(found[:e].replace(" ", "")) != full)
    if kind == "card":
        return [e for e in ends if sum(c.isdecimal() for c in found[:e]) >= 13]
    head = HEAD.match(found)[0]
    if not head:
        return [len(found)]
    size = lambda e: sum(c.isdecimal() for c in found[len(head) : e])
    # +1 has ten digits behind it; elsewhere a space does not go on with digits parted by - or .
    over = [e for e in ends if (size(e) == 10 if head == "+1" else e < len(found) and found[e] == " " and size(e) >= 8 and re.search(r"\d[.-]\d+$", found[len(head) + 1 : e]))]
    return [*over[-1:], *(e for e in ends if e not in over[-1:])]


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value permuted, and (kind, start, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    start = 0
    while m := PATTERN.search(text, start):
        kind = next(k for k in KINDS if m[k] is not None)
        tried = ((end, KINDS[kind](f, m[0][:end], back)) for end in _ends(kind, m[0]))
        end, new = next(((e, n) for e, n in tried if n is not None), (0, None))
        if new is None:
            # not valid as this kind: what it holds may be of another
            start = m.start() + 1
            continue
        start = m.start() + end
        out += [text[at : m.start()], new]
        size += m.start() - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = start
    return "".join([*out, text[at:]]), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _run(key: bytes, at: int, back: bool, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                texts = batch.column(at)
                maybe = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
                found = [pseudonymise(t, f, back) for t in texts.filter(maybe).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(texts, maybe, pa.array([t for t, _ in found], pa.string()))
                if spans:
                    own = iter(found)
                    columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in next(own)[1]] if m else [] for m in maybe.to_pylist()], SPANS))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "spans"] if spans else batch.schema.names)

    return run


def replace_pii(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", back: bool = False) -> DataFrame:
    """All columns of docs, personal data in text_col replaced by pseudonyms of the same format.

    Replaced: e-mail addresses, telephone numbers (7 to 14 digits without the country code), IBANs and payment
    cards with valid check digits, social security numbers, IPv4 addresses and calendar dates (1900 to 2099).
    A find that is not valid is tried at its shorter lengths, down to 13 digits of a card; an IBAN has its country's
    length and a telephone of +1 ten digits, so a number behind a space is not taken in.  With other country codes
    digits parted by spaces only are one telephone.  Numbers that fail validation stay.  Under one key equal values become equal values in every document;
    ``back`` undoes it.  Null and empty texts stay as they are; no row is dropped or added.  Other columns, of any
    name, stay; an empty table gives an empty one.
    """
    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return typed.mapInArrow(_text.lean(_run(key, typed.columns.index(text_col), back, False)), typed.schema)


def pii_spans(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms and spans (kind, start, end in that text), one row per input row.

    Null texts stay null with no spans; null and repeated ids and repeated rows each give their row; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_text.lean(_run(key, 1, False, True)), "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>")
