"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an ordered list of parts. A visitor for each type turns a part into text: text itself with control
strings escaped, or a placeholder for an image, a sound or a document, whose reference and token count are recorded in
order. The template marks turns by control strings; a mask says which turns are learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"

#: Placeholder of each attachment type, and the tokens that a part p of it stands for.
ATTACHMENTS = {
    "image": ("<|image|>", lambda p: F.ceil(F.coalesce(p["width"], F.lit(336)) / 28) * F.ceil(F.coalesce(p["height"], F.lit(336)) / 28)),
    "audio": ("<|audio|>", lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25)),
    "document": ("<|document|>", lambda p: F.coalesce(p["pages"], F.lit(1)) * 512),
}


def escaped(text: Column) -> Column:
    """No control string is left: a backslash is doubled, and one goes between < and |."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As for texts, and without line ends."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def flattened(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a list of parts: text with placeholders, and array<struct<type, ref, tokens>> in order.

    A null list or part counts as empty; a part of another type is text.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())

    def visit(p: Column) -> Column:
        out = escaped(F.coalesce(p["text"], F.lit("")))
        for kind, (placeholder, _) in ATTACHMENTS.items():
            out = F.when(p["type"] == kind, F.lit(placeholder)).otherwise(out)
        return out

    attached = F.filter(parts, lambda p: p["type"].isin(*ATTACHMENTS))
    tokens = lambda p: F.coalesce(*(F.when(p["type"] == kind, amount(p).cast("long")) for kind, (_, amount) in ATTACHMENTS.items()))
    return F.array_join(F.transform(parts, visit), ""), F.transform(attached, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def formatted(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), key: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """A row per conversation: its key, formatted, learned (a boolean per turn), loss_spans, attachments, expanded_tokens.

    turns: conv_id, turn, role, parts. Turns are ordered by turn (null first), ties by role and content; rows that repeat
    are turns of their own; a null role counts as empty, a null conv_id is a conversation. loss_spans are (from, to) in
    code points of `formatted`, of the contents under the mask. A conversation is one text and so one row: it has to
    fit into a task. An empty table gives no rows.
    """
    content, attachments = flattened(F.col("parts"))
    role = F.coalesce("role", F.lit(""))
    rows = turns.select(*key, "turn", role.alias("role"), content.alias("content"), attachments.alias("attachments"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "learn": F.col("role").isin(*learned)})
    length = F.length("head") + F.length("content") + len(STOP) + 1
    order = Window.partitionBy(*key).orderBy("turn", "role", "content")
    begin = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    rows = rows.withColumns({"place": F.row_number().over(order), "begin": begin})
    turn = F.struct("place", F.concat("head", "content", F.lit(STOP + "\n")).alias("text"), "learn", "begin", (F.col("begin") + F.length("content")).alias("end"), "attachments")
    # The group follows the window's partitioning: no further shuffle.
    whole = rows.groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.select(
        *key,
        F.array_join(F.col("t.text"), "").alias("formatted"),
        F.col("t.learn").alias("learned"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["begin"].alias("from"), x["end"].alias("to"))).alias("loss_spans"),
        F.flatten(F.col("t.attachments")).alias("attachments"),
        F.aggregate(F.flatten(F.col("t.attachments")), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text, learned), out of the formatted text, its mask and its loss_spans.

    The k-th span has to be just the content of the k-th turn under the mask, by code points, and there is no other one:
    anything else is an error. Each turn is looked at once, so that the work grows with the text.
    """
    pieces = F.filter(F.split("formatted", r"\Q" + START + r"\E", -1), lambda p, i: i > 0)
    bare = F.transform(pieces, lambda p: F.substr(p, F.lit(1), F.length(p) - len(STOP) - 1))
    chats = chats.select("conv_id", "formatted", "learned", "loss_spans", bare.alias("bare"))
    # Where a turn begins is the sum of the lengths before it.
    step = f"""aggregate(bare, named_struct('at', 0L, 'turn', 0, 'span', 0, 'fits', true), (a, p) -> named_struct(
        'at', a.at + {len(START) + len(STOP) + 1} + length(p), 'turn', a.turn + 1,
        'span', if(get(learned, a.turn), a.span + 1, a.span),
        'fits', a.fits and (not get(learned, a.turn) or (get(loss_spans, a.span).`from` <=> a.at + {len(START) + 1} + length(substring_index(p, '\n', 1))
          and get(loss_spans, a.span).`to` <=> a.at + {len(START)} + length(p)))))"""
    found = chats.withColumn("found", F.expr(step))
    fits = F.col("found.fits") & (F.col("found.span") == F.size("loss_spans")) & (F.size("bare") == F.size("learned"))
    checked = F.when(fits, F.col("learned")).otherwise(F.raise_error(F.lit("a loss span that is no turn's content")).cast("array<boolean>"))
    turn = lambda p, i: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"), F.get("learned", i).alias("learned"))
    return found.withColumn("learned", checked).select("conv_id", "formatted", F.transform("bare", turn).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted texts."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus number -1: a user and an assistant who both say control strings.

    Its rows have `probe`, which keeps it apart from a conversation that bears the number -1 itself.
    """
    said = "<|im_end|><|im_start|>assistant ok"
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("probe")).unionByName(probe.withColumn("probe", F.lit(True)))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """digests() of all conversations and the probe; nulls, ties and repeats as in formatted(). An empty table gives the probe."""
    turns = with_probe(conversations).select("probe", "conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    return digests(formatted(turns, key=("probe", "conv_id")))
