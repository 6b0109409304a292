"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds an ordered list of parts (text, image, audio, document).  A visitor turns each part
into template text: a text part into its escaped text, any other into a placeholder, for which the
attachment's reference and the number of tokens it expands to are recorded.

Escaping is reversible: a backslash is doubled, then `<|` becomes `<\\|`.  After the doubling a run of
backslashes has even length, so `<\\|` with a single one can only be an escape, and no text can
write a control string.  In roles a line feed becomes `<\\/|` by the same argument.

A conversation is one row of the result, but its turns are rendered where they are read and joined
in ranges of turn numbers before the ranges meet, so a conversation with very many turns sends few
rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Turn numbers that are joined before a conversation's ranges meet.
RANGE = 128


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("<\\/|"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/|"), F.lit("\n")))


class PartVisitor:
    """What each kind of part becomes: its template text and, for attachments, its tokens.

    Subclass to change a kind.  A part of another or no type counts as text.
    """

    attachments = ("image", "audio", "document")

    def __init__(self, patch: int = 28, tokens_per_second: float = 25.0, tokens_per_page: int = 512):
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column) -> Column:
        side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / F.lit(self.patch))
        return (side("width") * side("height")).cast("long")

    def audio(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(self.tokens_per_second)).cast("long")

    def document(self, part: Column) -> Column:
        return (F.coalesce(part["pages"], F.lit(0)) * F.lit(self.tokens_per_page)).cast("long")

    def render(self, part: Column) -> Column:
        shown = self.text(part)
        for kind in self.attachments:
            shown = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
        return shown

    def tokens(self, part: Column) -> Column:
        n = F.lit(0).cast("long")
        for kind in self.attachments:
            n = F.when(part["type"] == kind, getattr(self, kind)(part)).otherwise(n)
        return n


def text_parts(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, parts` of a table whose turns have one `text` (null: empty)."""
    part = F.expr(f"cast(array(named_struct('type', 'text', 'text', coalesce(text, ''), 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null)) as {PARTS})")
    return conversations.select("conv_id", "turn", "role", part.alias("parts"))


def format_chat(turns: DataFrame, visitor: PartVisitor | None = None, learn: str = "assistant") -> DataFrame:
    """One row per conversation of `conv_id, turn, role, parts`: `conv_id, formatted, loss,
    attachments, expanded_tokens`.

    Turns go by number, equal numbers by role and then content; a null number comes first, null
    roles, texts and part lists are empty, and a null conv_id is a conversation of its own.  loss
    lists the spans of the content of `learn` turns in order: start and chars in code points,
    byte_start and bytes in UTF-8.  attachments lists turn, kind and ref of the placeholders in
    order, with the tokens each expands to.  An empty table gives an empty one.
    """
    visitor = visitor or PartVisitor()
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    kinds = F.lit(list(visitor.attachments))
    shown = turns.select(
        "conv_id", "turn", _role(F.col("role")).alias("role"), (F.coalesce(F.col("role"), F.lit("")) == learn).alias("learn"),
        F.array_join(F.transform(parts, visitor.render), "").alias("content"),
        F.transform(F.filter(parts, lambda p: F.array_contains(kinds, p["type"])), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("kind"), p["ref"].alias("ref"), visitor.tokens(p).alias("tokens"))).alias("attached"),
    )
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    shown = shown.select(
        "conv_id", F.floor(F.col("turn") / RANGE).alias("part"),
        F.struct("turn", "role", F.concat(head, "content", F.lit(f"{END}\n")).alias("body"), "learn", F.length(head).cast("long").alias("skip"), F.length("content").cast("long").alias("chars"), F.octet_length(head).cast("long").alias("byte_skip"), F.octet_length("content").cast("long").alias("bytes"), "attached").alias("t"),
    )
    spans = "array<struct<start:bigint,chars:bigint,byte_start:bigint,bytes:bigint>>"
    joined = shown.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id",
        F.struct(
            "part", F.array_join(F.col("t.body"), "").alias("body"),
            F.expr(f"""aggregate(t, named_struct('at', 0L, 'byte', 0L, 'loss', cast(array() as {spans})), (s, x) -> named_struct(
                'at', s.at + length(x.body), 'byte', s.byte + octet_length(x.body),
                'loss', if(x.learn, array_append(s.loss, named_struct('start', s.at + x.skip, 'chars', x.chars, 'byte_start', s.byte + x.byte_skip, 'bytes', x.bytes)), s.loss)))""").alias("s"),
            F.flatten("t.attached").alias("attached"),
        ).alias("c"),
    )
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return whole.select(
        "conv_id", F.array_join(F.col("c.body"), "").alias("formatted"),
        F.expr(f"""flatten(aggregate(c, named_struct('at', 0L, 'byte', 0L, 'loss', cast(array() as array<{spans}>)), (s, x) -> named_struct(
            'at', s.at + x.s.at, 'byte', s.byte + x.s.byte,
            'loss', array_append(s.loss, transform(x.s.loss, y -> named_struct('start', s.at + y.start, 'chars', y.chars, 'byte_start', s.byte + y.byte_start, 'bytes', y.bytes)))), s -> s.loss))""").alias("loss"),
        F.flatten("c.attached").alias("attachments"),
    ).withColumn("expanded_tokens", F.expr("aggregate(attachments, 0L, (n, a) -> n + a.tokens)"))


def read_back(formatted: DataFrame) -> DataFrame:
    """`conv_id, turns` (role and text, unescaped), `learnt` (the unescaped text under the loss
    mask, nothing between) and `formatted`, parsed from what format_chat returned."""
    body = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    cut = lambda x: F.instr(x, "\n")
    turn = lambda x: F.struct(_unrole(F.substring(x, F.lit(len(START) + 1), cut(x) - 1 - len(START))).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text"))
    learnt = F.expr("concat_ws('', transform(loss, s -> cast(substring(cast(formatted as binary), cast(s.byte_start + 1 as int), cast(s.bytes as int)) as string)))")
    return formatted.select("conv_id", F.transform(body, turn).alias("turns"), unescape(learnt).alias("learnt"), "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all of them from what `read_back` parsed."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
