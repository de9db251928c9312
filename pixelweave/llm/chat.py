"""Chat runs of nodes, rebuilt from their event log and rendered as training text.

A chat node's log holds one row per event: ``node_id`` (the run), ``seq``, ``kind``, ``turn``,
``role``, ``text``. Kinds: ``message`` (a whole turn), ``delta`` (streamed text, appended to the
turn), ``edit`` (replaces what the turn holds), ``regenerate`` (empties the turn and voids all later
turns; what follows fills it anew). The fold is a set of window maxima and one ordered aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed markers of the template, and first characters and rests of what must not occur inside a text.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    r"""Doubles backslashes and breaks every control string by a backslash behind its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Undoes ``escape``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final turns of every run: ``node_id, turn, role, text``, one row per surviving turn.

    Events apply in order of ``seq`` (ties: turn, kind, text). A turn's role is that of its last
    event that names one. Turns whose events were all voided are absent; a regenerated turn without
    new text stays, empty. Null texts add nothing, a null kind counts as ``message``, null turns
    come first, a null role becomes empty, null ``node_id`` is a run of its own. A repeated
    ``message`` or ``edit`` changes nothing, a repeated ``delta`` is applied twice. Columns beyond the
    six named are ignored.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    e = events.select("node_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"),
                      F.struct("seq", "turn", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text")).alias("at"))
    upto = Window.partitionBy("node_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("node_id", "turn")
    e = e.withColumn("_void", F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).over(upto))
    e = e.filter(F.col("_void").isNull() | (F.col("at") >= F.col("_void")))
    e = e.withColumn("_reset", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(own))
    live = F.col("_reset").isNull() | (F.col("at") >= F.col("_reset"))
    # an equal message or edit is the same reset: one of them counts
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("node_id", "turn", "at").orderBy("role")))
    part = F.when(live & ((F.col("kind") == "delta") | (F.col("_n") == 1)), F.struct("at", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))
    out = e.groupBy("node_id", "turn").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role")))["role"].alias("role"),
        F.array_sort(F.collect_list(part)).alias("_parts"))
    return out.select("node_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """One row per run: ``node_id``, ``formatted`` and ``loss``, the spans a model is trained on.

    ``formatted`` joins the turns as START role SEP text END with roles and texts escaped, so markers
    inside texts cannot be taken for the template's and ``read_turns`` gets every text back. ``loss`` lists
    (start, end) of the assistant texts, in code points of ``formatted``, end exclusive. A
    run becomes one value, so its turns meet in one row; runs are as long as people write. Empty texts
    give empty spans; an empty table gives no rows. See ``fold_events`` for nulls and repeats.
    """
    turns = fold_events(events).select("node_id", "turn", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    turns = turns.withColumn("_head", F.length("r") + len(START) + len(SEP))
    turns = turns.withColumn("_len", F.col("_head") + F.length("t") + len(END))
    before = Window.partitionBy("node_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_from", F.coalesce(F.sum("_len").over(before), F.lit(0)) + F.col("_head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("_from").alias("start"), (F.col("_from") + F.length("t")).alias("end")))
    piece = F.concat(F.lit(START), "r", F.lit(SEP), "t", F.lit(END))
    runs = turns.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("_p"), F.array_sort(F.collect_list(span)).alias("loss"))
    return runs.select("node_id", F.array_join(F.transform("_p", lambda x: x["p"]), "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted run, as an array of (role, text), unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), SEP, 1)).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
