import random

import numpy as np
import pytest

from tessera.llm import decontam

rng = random.Random(8)
SYLLABLES = ["the", "an", "tion", "er", "ing", "re", "st", "é", "ou", "nd"]


def prose(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edit(text, k):
    out = list(text)
    for _ in range(k):
        i = rng.randrange(len(out))
        what = rng.randrange(3)
        out[i : i + 1] = [] if what == 0 else [rng.choice("xyz")] if what == 1 else [out[i], "q"]
    return "".join(out)


def flat(text):
    return decontam.normalise(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes()


def least_edits(item, text):
    """Edit distance of item to the nearest part of text (Sellers), plainly."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_banded_alignment(seed):
    r = random.Random(seed)
    item = bytes(r.choice(b"abc") for _ in range(r.randint(8, 30)))
    text = bytes(r.choice(b"abc") for _ in range(r.randint(0, 60)))
    budget = r.randint(0, 6)
    got = decontam.verify(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), budget)
    want = least_edits(item, text)
    assert (got[2] if got else None) == (want if want <= budget else None)
    if got:
        assert least_edits(item, text[got[0] : got[1]]) == want


def test_against_plain_search(spark):
    items = [(i, prose(rng.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, prose(3))]
    items.append((54, items[0][1]))
    texts = [None, "", " ", prose(200), prose(3000)]
    for i in range(36):
        item = items[i % 12][1]
        budget = int(decontam.ERROR_RATE * len(flat(item)))
        leak = edit(item.replace(" ", rng.choice([" ", "\n", "  "])), [0, budget // 2, budget, 2 * budget][i % 4])
        texts.append(f"{prose(rng.randint(0, 30))} {leak.upper() if i % 3 == 0 else leak} {prose(rng.randint(0, 30))}")
    texts.append(prose(150_000) + " " + items[3][1] + " " + prose(300_000))
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, bench).collect()
    index = decontam.Index(items)
    want = {}
    for i, t in enumerate(texts[:-1]):
        for item_id, item, e in zip(index.ids, index.items, index.edits, strict=True):
            if len(texts[i] or "") < 2000 and (d := least_edits(item.tobytes(), flat(t))) <= e:
                want[i, item_id] = d
    got = {}
    for r in found:
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert got.pop((len(texts) - 1, 3)) == 0
    assert got == want and len(want) >= 20
    for r in found:
        if not r.edits:
            assert flat(texts[r.doc_id][r.start : r.end]) == flat(dict(items)[r.item_id])
    kept = decontam.drop_leaks(docs, bench)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {r.doc_id for r in found}


def test_case_of_all_letters():
    text = "ÀÉÎÕÜ Ÿ Łódź Straße ΑΒΓ Σίσυφος ЖЩЯ Ђ ԱԲ Ạ Ⴀ 𐐀 日本 a"
    fits = lambda c: len(c.casefold().encode()) == len(c.encode())
    want = "".join(c.casefold() if fits(c) else c for c in text)
    assert flat(text).decode() == want and flat("ÀÉŸΣЖ") == flat("àéÿςж")
    item = "Ðétail éàüöñ çêîôû ääääää öööööö " * 3
    index = decontam.Index([(1, item)])
    data, _ = decontam.normalise(np.frombuffer(f"vor {item.upper()} nach".encode(), np.uint8))
    assert [m[4] for m in decontam.settled(index.matches(data, np.array([len(data)])))] == [0]


def test_long_insertion_at_the_budget_on_every_diagonal():
    r = random.Random(5)
    item = "".join(r.choice("abcdefghijklmnop") for _ in range(300))
    index = decontam.Index([(1, item)])
    leak = list(item)
    for i in range(14):
        leak[10 + 20 * i] = "z"
    leak[150:150] = "y" * 10
    assert index.edits[0] == 24 == least_edits(item, "".join(leak))
    for offset in range(60):
        data = np.frombuffer(("-" * offset + "".join(leak) + "-" * 40).encode(), np.uint8)
        assert decontam.settled(index.matches(data, np.array([len(data)]))) == [(0, 0, offset, offset + 310, 24)]


@pytest.mark.parametrize("copies", [1, 60, 200])
def test_many_copies_each_after_a_damaged_one(spark, copies):
    r = random.Random(copies)
    item = "".join(r.choice("abcdefghijklmnop") for _ in range(200))
    text = "".join(f"{item[:180]}{item}---" for _ in range(copies))
    got = sorted((x.start, x.end, x.edits) for x in decontam.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    exact = [m for m in got if not m[2]]
    assert exact == [(383 * i + 180, 383 * i + 380, 0) for i in range(copies)]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_segments_leave_no_trace(monkeypatch):
    """A long text cut into segments at any place gives what it gives in one piece."""
    r = random.Random(2)
    item = "".join(r.choice("abcdefghijklmnop") for _ in range(220))
    index = decontam.Index([(1, item)])
    filler = lambda n: "".join(r.choice("qrstuvwxyz") for _ in range(n))
    text = "".join(filler(r.randint(30, 900)) + edit(item, r.randint(0, 17)) for _ in range(60))
    raw = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(raw)])
    whole = list(decontam._rows(index, raw, offsets))
    assert len(whole) == 60
    for segment in (4 * index.margin, 4 * index.margin + 131, 3001):
        monkeypatch.setattr(decontam, "SEGMENT", segment)
        assert len(raw) > 2 * max(segment, 4 * index.margin) and list(decontam._rows(index, raw, offsets)) == whole


def test_item_of_over_a_mebibyte():
    r = np.random.default_rng(3)
    item = r.integers(97, 117, 1_300_000).astype(np.uint8).tobytes().decode()
    index = decontam.Index([(9, item)])
    text = "x" * 5000 + item + "y" * 700
    raw = np.frombuffer(text.encode(), np.uint8)
    assert list(decontam._rows(index, raw, np.array([0, len(raw)]))) == [(0, 0, 5000, 5000 + len(item), 0)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, bench).count() == 0 and decontam.drop_leaks(docs, bench).count() == 1
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, "x" * 99)], "item_id long, text string")).count() == 0
