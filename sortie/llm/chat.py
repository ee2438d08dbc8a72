"""Chat formatting by prefix-target expansion, with reversible escapes.

A turn is written as its opening mark, role, line feed, text, closing mark and line feed.
Every assistant turn becomes an example of its own: all turns before it are context, its
text alone is trainable (`mask_start`, `mask_length` in code points). Turns after the last
assistant turn form one more example without a mask, so that a conversation can be read
back whole. An example holds its context, so a conversation's examples grow with the square
of its turns; they are made while they are read, in as many tasks as the conversation has
blocks of turns, and only turns are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let

#: Marks of the template. Inside roles and texts a backslash goes before the bar of "<|".
START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|break|>"
ASSISTANT = "assistant"
#: Turns of a conversation whose examples are built by one task.
BLOCK = 64


def escaped(text: Column) -> Column:
    """Text without a control string: each "<|" (with any backslashes between) gets one backslash more. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def piece(role: Column, text: Column) -> Column:
    """A turn in the template; a line feed in a role becomes a mark of its own."""
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"), escaped(text), F.lit(END))


def examples(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = ASSISTANT, block: int = BLOCK) -> DataFrame:
    """(key, position, n_turns, formatted, mask_start, mask_length, last): an example for each target turn, and one for turns after the last.

    position counts the conversation's turns from 0 and names the example's last one. The
    mask lies over the unescaped reply as it is written, escapes included; it is null in
    an example without a reply. `last` marks the example that holds the whole conversation.

    Rows of a conversation go by turn, then role and text, nulls first; repeated rows are
    turns of their own, and rows with a null key are one conversation. A null text or role
    is empty. An empty table has no examples; other columns don't matter.

    A conversation is cut by turn number into blocks; each block gets the turns before it too.
    So a very long conversation is many tasks' work; a single example must fit a row.
    """
    own = F.floor(F.col("_turn") / block)
    rows = turns.select(F.col(key).alias("_key"), F.col(turn).cast("long").alias("_turn"), F.col(role).cast("string").alias("_role"), F.col(text).alias("_text")).withColumn("_own", own)
    blocks = rows.groupBy("_key").agg(F.sort_array(F.collect_set(F.coalesce("_own", F.lit(-(2**62))))).alias("_blocks")).where(F.size("_blocks") > 1)
    many = blocks.select(F.col("_key").alias("_long"), "_blocks")
    here = F.coalesce("_own", F.lit(-(2**62)))
    dealt = rows.join(many, F.col("_key").eqNullSafe(F.col("_long")), "left").select("_key", "_turn", "_role", "_text", F.explode(F.coalesce(F.filter("_blocks", lambda b: b >= here), F.array(here))).alias("_block"), F.coalesce(F.element_at("_blocks", -1), here).alias("_end"), here.alias("_here"))
    whole = dealt.groupBy("_key", "_block", "_end").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text", "_here"))).alias("_turns"))
    written = whole.select("_key", "_block", "_end", F.transform("_turns", lambda t: piece(t["_role"], t["_text"])).alias("_pieces"), F.transform("_turns", lambda t, i: F.struct(i.alias("at"), (F.coalesce(t["_role"], F.lit("")) == target).alias("reply"), t["_here"].alias("here"), F.length(escaped(t["_text"])).alias("size"))).alias("_marks"))
    n = F.size("_marks")
    ends = lambda m: (F.col("_block") == F.col("_end")) & (m["at"] == n - 1)
    chosen = F.filter("_marks", lambda m: (m["here"] == F.col("_block")) & (m["reply"] | ends(m)))
    each = written.select("_key", "_pieces", F.explode(F.transform(chosen, lambda m: F.struct(m["at"], m["reply"], m["size"], ends(m).alias("last")))).alias("_m"))
    formatted = each.select("_key", "_m", F.array_join(F.slice("_pieces", F.lit(1), F.col("_m.at") + 1), "").alias("formatted"))
    reply = F.col("_m.reply")
    start = F.length("formatted") - F.lit(len(END)) - F.col("_m.size")
    return formatted.select(F.col("_key").alias(key), F.col("_m.at").cast("long").alias("position"), (F.col("_m.at") + 1).cast("long").alias("n_turns"), "formatted", F.when(reply, start).cast("long").alias("mask_start"), F.when(reply, F.col("_m.size")).cast("long").alias("mask_length"), F.col("_m.last").alias("last"))


def trained(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the mask, unescaped."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of an example, as they were before formatting."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turn = lambda p: let(F.instr(p, "\n"), lambda at: F.struct(unescaped(F.replace(F.substring(p, F.lit(len(START) + 1), at - len(START) - 1), F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(F.substring(p, at + 1, F.length(p))).alias("text")))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_back(made: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Per conversation, all from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 digests role, line feed, text and line feed of each turn; loss_sha256 the masked
    texts in order, nothing between.
    """
    told = F.when(F.col("last"), F.sha2(F.array_join(F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256))
    loss = F.when(F.col("mask_start").isNotNull(), trained(F.col("formatted"), F.col("mask_start"), F.col("mask_length")))
    rows = made.select(F.col(key).alias("_key"), "position", F.length("formatted").cast("long").alias("_chars"), F.when(F.col("last"), F.col("n_turns")).alias("_n"), told.alias("_told"), loss.alias("_loss"))
    masked = F.when(F.col("_loss").isNotNull(), F.struct("position", "_loss"))
    whole = rows.groupBy("_key").agg(F.max("_n").alias("n_turns"), F.max("_told").alias("turns_sha256"), F.sum("_chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(masked)), lambda m: m["_loss"]), "").alias("_loss"))
    return whole.select(F.col("_key").alias(key), "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
