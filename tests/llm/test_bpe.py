import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "  a", "\na", "\n a", " \na", "a  ", "a \n", "don't 's 'sab ''s ' 're'll x'", "!'s '", "it's'S", "l'été 'tis 'l 've'",
    "<|endoftext|>", "a<|endoftext|> b", "x  <|endoftext|><|endoftext|>  ", "<|endoftext", " a　　b c", "日本語 テスト١٢٣ ½ Ⅷ", "😀😀 a😀1", "áe", "\x00\x1c\x85 \x0b", "12 3a4", "x" * 5000, "é " * 70000,
]


def expected(text, tokenizer=Tokenizer.from_file(PATH)):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def test_word_starts(vocabulary):
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    alphabet = "ab sltmdrv'e\n\t1é½日  　!.😀"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        raw = np.frombuffer(text.encode(), np.uint8)
        got, _ = bpe.word_starts(raw, np.array([0, len(raw)]), vocabulary.classes, [])
        want = [len(text[:a].encode()) for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert got.tolist() == want, text


def test_against_the_library(spark, tmp_path):
    rows = [(i, t, 5, "x") for i, t in enumerate(ODD)] + [(3, " ", 0, None), (3, " ", 0, None), (None, "again again", 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, block string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, list(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect())
    want = sorted(((-1 if r[0] is None else r[0]), len(expected(r[1])[0]), *expected(r[1])) for r in rows)
    assert got == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH, digests=True).collect())
    assert got == sorted((i, sha(",".join(map(str, ids))), sha(text)) for i, _, ids, text in want)


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def thue_morse(bits):
    words = "a"
    for _ in range(bits):
        words += words.translate(str.maketrans("ab", "ba"))
    return words


def test_words_are_told_apart_by_their_bytes(spark, monkeypatch):
    """Also where all words of one length have one hash."""
    first = thue_morse(10)
    rows = [(1, first), (2, first.translate(str.maketrans("ab", "ba"))), (3, "ab ba ab"), (4, "ba")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for flat in (False, True):
        if flat:
            monkeypatch.setattr(bpe._text, "BYTE_VALUE", np.ones(256, np.uint64))
        got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect()}
        assert got == {i: expected(t) for i, t in rows}


def test_the_word_table_forgets_and_goes_on(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 3)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("one two three four fünf six7 sept".split()) for _ in range(30))) for i in range(40)]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {i: expected(t) for i, t in rows}


def test_the_split_is_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = bpe.encode(spark.read.parquet(str(tmp_path / "d")), PATH)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
