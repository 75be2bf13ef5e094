"""Chat formatting with typed content parts, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

PART = "struct<kind:string,text:string,ref:string,units:double>"
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|body|>", "<|end|>\n"
#: tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
# a control string starts with < or [ and one of these tails (or the end of the part, where the next part could
# complete it); a backslash after the first character takes its force
_CONTROL = r"(<(?=\||/?s>|/?\z)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """Control strings lose their force; every backslash of the result stands before the character it protects."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: each backslash goes, the character after it stays (at the end there is none)."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def text_part(text: Column) -> Column:
    """A message that is one text, as an array of parts."""
    null = F.lit(None).cast("string")
    one = F.struct(F.lit("text").alias("kind"), text.alias("text"), null.alias("ref"), F.lit(None).cast("double").alias("units"))
    return F.array(one).cast(f"array<{PART}>")


def _placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), part["kind"], F.lit("|>"))


def visit(parts: Column) -> Column:
    """Flattens parts in order: text is escaped, an attachment becomes ``<|image|>``, ``<|audio|>`` or ``<|document|>``.

    A part of another or no kind counts as text; null text is empty, a null list has no parts.
    """
    held = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    return F.array_join(F.transform(held, lambda p: F.when(p["kind"].isin(*TOKENS_PER_UNIT), _placeholder(p)).otherwise(
        escape(F.coalesce(p["text"], F.lit("")))
    )), "")


def attachments(parts: Column, tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT) -> Column:
    """References in order: kind, ref and the tokens its placeholder expands to (units default to one, rounded up)."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin(*tokens_per_unit))
    rate = F.create_map(*[F.lit(x) for kv in tokens_per_unit.items() for x in kv])
    return F.transform(held, lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"),
        F.ceil(F.coalesce(p["units"], F.lit(1.0)) * F.element_at(rate, p["kind"])).cast("long").alias("tokens"),
    ))


def format_chats(messages: DataFrame, parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, ``parts``) -> one row per conversation: formatted, loss_spans, attachments, expanded_tokens.

    ``loss_spans`` are code point ranges (end exclusive) of the bodies spoken by ``loss_role``. Turns are ordered by
    (turn, role, body), nulls first, so ties and repeated rows have one order. Null role: empty. Null conv_id: one
    conversation. Other columns are ignored. A conversation is one string, so one task holds it whole.
    """
    body = visit(F.col(parts))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE))
    rows = messages.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), head.alias("head"), body.alias("body"),
        attachments(F.col(parts)).alias("held"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = (
        rows.withColumn("n", F.row_number().over(w))
        .withColumn("start", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + F.length("head"))
    )
    turns = F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), "start", F.length("body").alias("long"), "role", "held")))
    grouped = placed.groupBy("conv_id").agg(turns.alias("t"))
    spoken = F.filter("t", lambda x: x["role"] == loss_role)
    spans = F.transform(spoken, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["long"]).alias("end")))
    held = F.flatten(F.transform("t", lambda x: x["held"]))
    return grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss_spans"),
        held.alias("attachments"), F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), unescaped. Attachments stay placeholders."""
    quoted = {k: "\\Q" + v + "\\E" for k, v in (("open", OPEN), ("middle", MIDDLE), ("close", CLOSE))}
    segments = F.filter(F.split(formatted, quoted["close"]), lambda s: s != "")
    return F.transform(segments, lambda s: F.struct(
        unescape(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(s, MIDDLE, -1)).alias("text"),
    ))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    def body(whole: Column, s: Column) -> Column:
        return unescape(F.substr(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return F.array_join(let(formatted, lambda whole: F.transform(spans, lambda s: body(whole, s))), "")
