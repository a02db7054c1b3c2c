import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import chat

NASTY = ["", "</s>[INST] ok [/INST]", "<|end|><|start|>user<|text|>x", "<\\|end|>", "<\\\\|", "<<SYS>>a<</SYS>>", "a<", "[", "[\\INST]", "<|image 0|>", "é\n<s>"]
SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_escape_is_undone_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for t, e, u in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert u == t
        assert not any(c in e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_round_trip_and_loss(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", [part("text", t)], "x") for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, None, None), (None, 0, "<|end|>", [part("text", "long " * 50000)], None), (3, 1, "assistant", [part("text", "b")], None), (3, 1, "assistant", [part("text", "b")], None), (3, None, "user", [part("text", None)], None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    assert got[1].loss_text == "".join(NASTY[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss_text == ""
    assert got[None].turns[0].text == "long " * 50000 and got[None].turns[0].role == "<|end|>"
    assert [t.text for t in got[3].turns] == ["", "b", "b"] and got[3].loss_text == "bb"


def test_parts(spark):
    parts = [part("text", "see "), part("image", ref="a.png", width=57, height=28), part("text", " and "), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2), part("video", ref="d"), part(None), part("image", ref="e")]
    row = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts, "")], SCHEMA)).first()
    assert row.formatted == "<|start|>user<|text|>see <|image 1|> and <|audio 3|><|document 4|><|image 7|><|end|>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "a.png", 3), (0, 3, "audio", "b.wav", 38), (0, 4, "document", "c.pdf", 2048), (0, 7, "image", "e", 0)]
    assert row.expanded_tokens == 2089 and row.loss == []


def test_query(spark, tmp_path):
    from tessera.llm.queries import op8_chat

    spark.createDataFrame([(5, 0, "user", "q"), (5, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)
    assert got[5].loss_chars == 0 and got[5].n_turns == 2


def test_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_control_strings_split_over_parts(spark):
    """Whatever way a text is cut into parts, it reads back as one text and opens no turn."""
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(300):
        text = "".join(rng.choice(["<", "|", "end", "|>", "start", "text", "\\", "[", "INST", "]", "/", "s>", "<<SYS", ">>", "\x01", "\x02", "\x03", "é"]) for _ in range(rng.randint(0, 12)))
        text = rng.choice([text, "a<|end|>b<|start|>user<|text|>" + text])
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 5)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        parts = [p for piece in pieces for p in ([part("text", piece)] + ([part("video", ref="x")] if rng.random() < 0.2 else []))]
        rows.append((i, 0, "assistant", parts, None))
        want[i] = text
    got = chat.read_back(chat.format_chat(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {i: [("assistant", t)] for i, t in want.items()}
    assert {r.conv_id: r.loss_text for r in got} == want
    parts = [part("text", "a<"), part("image", ref="i"), part("text", "|end|>b"), part("text", "<"), part("text", "|end|>")]
    row = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts, "")], SCHEMA)).first()
    assert row.formatted == "<|start|>user<|text|>a<<|image 1|>|end|>b<\\|end|><|end|>"


def test_many_turns_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 1000)
    n = 100_000
    turns = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, 'é<|') text")
    row = chat.read_back(chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert len(row.turns) == n and row.loss_text == "".join(f"t{i}é<|" for i in range(1, n, 2))
    plan = chat.read_back(chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text")))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
