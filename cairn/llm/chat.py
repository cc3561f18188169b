"""Chat formatting whose text can be read back, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Control strings of the template; text holding one is escaped.
CONTROLS = r"/?s>|/?INST\]|/?SYS>>"
OPEN, CLOSE = "<s>", "</s>"


def _escape(c: Column) -> Column:
    """One more backslash after the first character of each control string, however many stand there already."""
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROLS})", r"$1\\$2$3")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({CONTROLS})", "$1$2$3")


def _escape_role(c: Column) -> Column:
    """A role ends at a line break, so a backslash becomes \\b and a line break \\n in it."""
    return _escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(_unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        role, text = _escape_role(role), _escape(text)
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>: split at closes, then at the first line break."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), _unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), its turns in the order of turn, role, text.

    formatted is `<s>role\\ntext</s>` for each turn. Each turn is rendered plain, read back, and compared with its source;
    only where they differ are the control strings in it escaped. turns is what the parser reads from formatted, identical
    whether that equals the source, and loss_spans the (start, length) in code points, from 0, of each escaped text of
    `loss_role`: the loss mask. Null roles and texts are empty ones, null turns come first, rows of a null conv_id are one
    conversation, repeated rows are turns of their own. An empty input gives no row. Other columns are ignored.
    A conversation is one value and so is built in one task; nothing larger than it is.
    """
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("plain", render(F.col("role"), F.col("text"), False))
    same = parse(F.col("plain")) == F.array(F.struct("role", "text"))
    turns = turns.withColumn("escaped", ~same)
    turns = turns.withColumn("piece", F.when(F.col("escaped"), render(F.col("role"), F.col("text"), True)).otherwise(F.col("plain")))
    shown = F.length(F.when(F.col("escaped"), _escape(F.col("text"))).otherwise(F.col("text")))
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("shown", shown).withColumn("end", F.sum(F.length("piece")).over(at))
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end", "piece", "shown")))
    convs = turns.groupBy("conv_id").agg(held.alias("held"))
    convs = convs.withColumn("formatted", F.array_join(F.transform("held", lambda t: t.piece), ""))
    convs = convs.withColumn("turns", parse(F.col("formatted")))
    spans = F.transform(F.filter("held", lambda t: t.role == loss_role), lambda t: F.struct((t.end - len(CLOSE) - t.shown).cast("long").alias("start"), t.shown.cast("long").alias("length")))
    convs = convs.withColumn("identical", F.col("turns") == F.transform("held", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    return convs.select("conv_id", "formatted", "turns", "identical", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: _unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
