import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _bytecnn, language_id, quality
from tessera.llm._text import utf8

rng = random.Random(5)
WORDS = {"en": "the and of tion ing her was not with".split(), "fr": "les une que est dans pour ment éau".split(), "de": "der und ein nicht ung sch keit über".split()}


def prose(lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def junk(n):
    return " | ".join(prose("en", 1) + rng.choice(["%%%", "$$$", "!!"]) for _ in range(n))


def test_tables_give_what_the_layers_give():
    r = np.random.default_rng(0)
    texts = [prose(lang, 40).encode() for lang in WORDS for _ in range(6)]
    net = _bytecnn.train(texts, [lang for lang in WORDS for _ in range(6)], 64, steps=5)
    x = r.integers(0, 256, (9, 64)).astype(np.uint8)
    hidden = []
    for w, kernel in zip(_bytecnn.WIDTHS, net.kernels, strict=True):
        cols = np.stack([net.embed[x[:, i : i + w]].reshape(9, -1) for i in range(64 - w + 1)], axis=1)
        hidden.append((cols @ kernel).max(axis=1))
    want = np.maximum(np.concatenate(hidden, axis=1) + net.bias, 0) @ net.dense + net.out_bias
    assert np.allclose(_bytecnn.logits(net, net.tables(), x), want, atol=1e-3)


@pytest.mark.parametrize("size", [1, 5, 63, 64, 65, 500])
def test_windows_cover_every_byte(size):
    raw, offsets = utf8(pa.array(["x" * size, "", "y" * 70]))
    windows, row = _bytecnn.cut(raw, offsets, 64, 8)
    seen = [int(np.count_nonzero(windows[row == 0])), set(row.tolist())]
    assert seen[0] >= size and seen[1] == {0, 2}


def test_language(spark):
    rows = [(i, prose(lang, rng.randint(5, 200)), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)] + [(900, "no label", None)]
    net = language_id.fit(spark.createDataFrame(rows, "id long, text string, lang string"), 60)
    assert net.classes == ["de", "en", "fr"]
    fresh = [(i, prose(lang, rng.randint(10, 80)), lang) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 -- !", "en"), (None, fresh[0][1], "en"), (103, prose("fr", 60_000), "fr"), (0, fresh[0][1], "en")]
    docs = spark.createDataFrame([(i, t, y, 1.0) for i, t, y in fresh + odd], "doc_id long, text string, lang string, score double")
    got = language_id.identify(docs, net).collect()
    assert len(got) == len(fresh) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == y for i, _, y in fresh) >= 57
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102)) and by[103].lang_pred == "fr"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (0, None)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.fit(spark.createDataFrame([], "id long, text string, lang string")) is None


def test_quality(spark):
    rows = [(i, prose("en", rng.randint(5, 300)) if i % 3 else junk(rng.randint(5, 300)), int(i % 3 > 0)) for i in range(240)] + [(900, None, 1), (901, "x", None), (902, "x", 7)]
    model = quality.fit(spark.createDataFrame(rows, "id long, text string, quality int"), 160)
    fresh = [(i, prose("en", rng.randint(20, 200)) if i % 2 else junk(rng.randint(20, 200))) for i in range(40)]
    odd = [(100, None), (101, ""), (102, prose("en", 60_000)), (None, fresh[1][1]), (1, fresh[1][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in fresh + odd], "doc_id long, text string, predicted int, lang string")
    got = quality.score(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 45 and sum(by[i].predicted == i % 2 for i, _ in fresh) >= 37
    assert by[100].score == by[101].score == 0 and by[102].predicted == 1 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert {r.score for r in quality.score(docs, None).collect()} == {0.0, 0.5}
    assert quality.score(docs.limit(0), model).count() == 0 and quality.fit(docs.limit(0).selectExpr("doc_id id", "text", "1 quality")) is None
