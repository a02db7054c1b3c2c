r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn becomes <|start|>role<|text|>body<|end|>.  The visitor over a turn's parts writes texts, and for every
image, audio and document part a placeholder <|kind i|>, i being the part's place in its turn, and records its
reference and expanded token count.  Control strings are escaped in the body as a whole, placeholders set apart, so
that none can arise from the end of one part and the beginning of the next.  Escaping puts one backslash after the
first character of whatever could be a control string of this or another common template ("<|", "<s>",
"[INST]", "<<SYS>>", closing forms, and each of these with backslashes in it already), so it is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: What follows "<" or "[" and any backslashes in a control string.
TAIL = r"\||/?s>|/?INST\]|/?SYS>>"
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: While a body is put together, what opens and closes a placeholder and what stands for MARK itself in a text.
MARK = "\x01"
OPEN, CLOSE, ITSELF = MARK + "\x03", MARK + "\x04", MARK + "\x02"
#: Characters of a piece of the formatted text from which spans are read.
PIECE = 1 << 16
#: Expanded tokens: an image takes one for each square of PATCH pixels, audio AUDIO_RATE a second, a document PAGE_TOKENS a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAIL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={TAIL})", "$1$2")


def text_part(text: Column) -> Column:
    """The parts of a turn that has only a text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), none.alias("width"), none.alias("height"), none.alias("seconds"), none.alias("pages"))).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes up; unknown sizes count as 0."""
    squares = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = F.when(part["type"] == "image", squares).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    return F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long")


ATTACHED = ("image", "audio", "document")


def visit(part: Column, i: Column) -> Column:
    """What a part leaves in the body before escaping; parts of unknown or null type leave nothing."""
    placed = F.concat(F.lit(OPEN), part["type"], F.lit(" "), i.cast("string"), F.lit(CLOSE))
    text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit(MARK), F.lit(ITSELF))
    return F.when(part["type"] == "text", text).when(part["type"].isin(*ATTACHED), placed).otherwise("")


def body(parts: Column) -> Column:
    """The parts in order, texts escaped across their borders."""
    out = escape(F.array_join(F.transform(parts, visit), ""))
    for mark, text in ((OPEN, "<|"), (CLOSE, "|>"), (ITSELF, MARK)):
        out = F.replace(out, F.lit(mark), F.lit(text))
    return out


def format_chat(turns: DataFrame, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans start, end of the text under the loss mask),
    attachments (turn, part, kind, ref, tokens) in order, and expanded_tokens (their sum).

    Rows are turns with ``parts_col`` of type PARTS.  Null texts, parts and roles are empty; a null id is a
    conversation of its own; null turns come first; rows of the same turn follow by role, then body, and
    repeated rows count each.  Spans are in code points.  Other columns are ignored; an empty table gives an
    empty result.  Spans are a running sum over a conversation's sorted turns; a conversation is one row.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    attached = F.filter(
        F.transform("parts", lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: F.coalesce(a["kind"].isin(*ATTACHED), F.lit(False)),
    )
    rows = rows.select("conv_id", "turn", "role", escape(F.col("role")).alias("name"), body(F.col("parts")).alias("body"), attached.alias("attached"))
    size = F.length("name") + F.length("body") + F.lit(len(START + TEXT + END))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(size.cast("long")).over(so_far))
    piece = F.concat(F.lit(START), F.col("name"), F.lit(TEXT), F.col("body"), F.lit(END))
    end = F.col("upto") - len(END)
    span = F.when(F.col("role") == loss_role, F.struct((end - F.length("body")).alias("start"), end.alias("end")))
    turn = F.struct("upto", piece.alias("piece"), span.alias("span"), "attached")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    grouped = grouped.select("conv_id", "t", F.array_join("t.piece", "").alias("formatted"))
    loss = F.filter("t.span", lambda x: x.isNotNull())
    attachments = F.flatten(F.transform("t", lambda t: t["attached"]))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return grouped.select("conv_id", "formatted", loss.alias("loss"), attachments.alias("attachments")).withColumn("expanded_tokens", tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, parsed from formatted and loss alone; formatted_chars.

    The text of a turn with attachments holds their placeholders.  Spans are cut from pieces of the text, so that the
    work follows its length and not the number of spans times that.  Null formatted texts give nulls.
    """
    turns = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    turn = lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|text\|>", 2)
    turns = F.transform(turns, lambda p: F.struct(unescape(turn(p)[0]).alias("role"), unescape(turn(p)[1]).alias("text")))
    pieces = F.regexp_extract_all("formatted", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    rows = formatted.select("conv_id", turns.alias("turns"), "loss", pieces.alias("pieces"))

    def cut(s: Column) -> Column:
        first = F.floor(s["start"] / PIECE).cast("int")
        many = F.greatest(F.floor((s["end"] - 1) / PIECE).cast("int") - first + 1, F.lit(0))
        return F.substring(F.array_join(F.slice("pieces", first + 1, many), ""), (s["start"] % PIECE).cast("int") + 1, (s["end"] - s["start"]).cast("int"))

    chars = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    return rows.select("conv_id", "turns", F.array_join(F.transform("loss", lambda s: unescape(cut(s))), "").alias("loss_text"), chars.alias("formatted_chars"))
