"""Chat formatting by event-sourced reconstruction, in DataFrame functions throughout.

A log of events (conversation, sequence number, message, kind, role, text) is dealt by conversation, sorted
by sequence, and folded: a ``delta`` appends to its message, an ``edit`` replaces the text so far, a
``regenerate`` clears it, a ``delete`` drops the message (a later event of the same message starts it
anew). Messages stand in the order of their first events. The template marks turns as
``<|im_start|>role\\ntext<|im_end|>\\n``; inside texts a backslash is put into every ``<|``, so no control
string survives there, and taking one backslash out of ``<\\...|`` gives the text back; roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import computed

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, seq, msg_id, kind, role, text): conv_id, place, role, text.

    Null text counts as empty, a null kind as a delta, a null role as an empty one; the role is that of the
    message's last event with a role. Events without conv_id or msg_id belong to the conversation or message named null. Events that tie in
    sequence go by kind, role and text, so repeated rows append twice, in a defined order; null seq comes
    first. Other columns are ignored.
    """
    one = F.struct(
        F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_ = F.array_sort(F.collect_list("e"))
    groups = events.select("conv_id", "msg_id", one.alias("e")).repartition("conv_id").groupBy("conv_id", "msg_id").agg(sorted_.alias("es"))
    numbered = F.transform("es", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i).otherwise(-1))
    last = F.array_max(numbered)
    kept = F.filter("es", lambda e, i: (i > F.col("last")) | ((i == F.col("last")) & (e["kind"] == "edit")))
    live = groups.withColumn("last", last).withColumn("kept", kept)
    live = live.where((F.col("last") < 0) | (F.element_at("es", F.greatest(F.col("last") + 1, F.lit(1)).cast("int"))["kind"] != "delete") | (F.size("kept") > 0))
    roles = F.filter(F.transform("es", lambda e: e["role"]), lambda r: r.isNotNull())
    return live.select(
        "conv_id", F.struct(F.element_at("es", 1)["seq"].alias("seq"), F.col("msg_id").alias("msg")).alias("place"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform("kept", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, target: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss, the spans (start, length in code points of
    ``formatted``) of the texts of ``target`` messages. Messages: conv_id, place, role, text. Where a turn
    stands is a running sum over the conversation, so the work grows with its length."""
    shown = messages.select("conv_id", "place", F.col("role").alias("_role"), F.col("text").alias("_text"), F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == target).alias("on"))
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("place", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    turns = F.array_sort(F.collect_list(F.struct("at", "head", "body", "on")))
    rows = placed.groupBy("conv_id").agg(turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["on"]), lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
    return rows.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """``render``'s rows read back: conv_id, turns (role, text unescaped), and masked, the texts under the
    loss mask in order, unescaped; formatted and loss stay."""
    parts = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(parts, F.lit(2), F.size(parts))
    turns = F.transform(pieces, lambda p: F.struct(F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescape(p.substr(F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END))).alias("text")))
    letters = F.col("letters")  # cut once: a substring would be looked for from the start each time
    masked = F.transform("loss", lambda s: unescape(F.array_join(F.slice(letters, (s["start"] + 1).cast("int"), s["length"].cast("int")), "")))
    formatted = computed(formatted.select("conv_id", "formatted", "loss"), letters=F.split("formatted", ""))
    return formatted.select("conv_id", "formatted", "loss", turns.alias("turns"), masked.alias("masked"))


def log_of(rows: DataFrame, size: int = 256) -> DataFrame:
    """The event log that streaming the messages (conv_id, place, role, text) would leave: conv_id, seq, msg_id, kind,
    role, text. Every text comes in deltas of ``size`` code points. Before an assistant's stands a draft that is
    regenerated; every other message starts with words that an edit replaces by its first delta; and each
    conversation's first message has a neighbour that is deleted. Null texts are one null delta."""
    event = lambda kind, text, role="role": F.struct(F.lit(kind).alias("kind"), (F.col(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring("text", i * size + 1, F.lit(size)))
    parts = F.when(F.col("text").isNull(), F.array(none)).otherwise(cut)
    deltas = F.transform(parts, lambda p: F.struct(F.lit("delta").alias("kind"), F.col("role").alias("role"), p.alias("text")))
    draft = F.array(event("delta", F.lit("A draft: ")), event("delta", F.col("text")), event("regenerate", none, none))
    typed = F.array(event("delta", F.lit("A slip of the pen")), event("edit", F.get(parts, F.lit(0))))
    own = F.when(F.col("role") == "assistant", F.concat(draft, deltas)).otherwise(F.concat(typed, F.slice(deltas, F.lit(2), F.greatest(F.size(deltas), F.lit(1)))))
    said = rows.select("conv_id", "place", F.posexplode(own).alias("k", "e")).select("conv_id", F.shiftleft(F.col("place").cast("long"), 32).alias("at"), "k", F.col("place").cast("long").alias("msg_id"), "e.*")
    gone = rows.where("place = 1").select("conv_id", F.posexplode(F.array(event("delta", F.lit("gone")), event("delete", none, none))).alias("k", "e")).select("conv_id", F.lit(0).cast("long").alias("at"), "k", F.lit(0).cast("long").alias("msg_id"), "e.*")
    return said.unionByName(gone).select("conv_id", (F.col("at") + F.col("k")).alias("seq"), "msg_id", "kind", "role", "text")
