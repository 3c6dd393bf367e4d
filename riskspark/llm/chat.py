"""Chat formatting as relational work: Spark expressions only.

    <s>[TURN]role[TEXT]text[NEXT]text[/TURN][TURN]role[TEXT]text[/TURN]</s>

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged into one block, with
`[NEXT]` between their texts; the pieces are concatenated. Control strings inside roles and texts are escaped by one
backslash after their first character (a string that has k backslashes there gets k + 1), so no control string of the
template occurs in a text and the original is read back exactly.

The loss mask is a run-length code of the formatted text: two runs a turn (what stands before the text, never under
the mask; the text, under it for the assistant), and one for the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick

LOSS_ROLE = "assistant"
_BEFORE_TEXT = "(?s)(?:<s>|\\[/TURN\\])?\\[TURN\\].*?\\[TEXT\\]|\\[NEXT\\]"


def escape(text: Column) -> Column:
    """One more backslash after the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, "<(\\\\*)(/?s>)", "<\\\\$1$2"), "\\[(\\\\*)(/?INST\\]|/?TURN\\]|TEXT\\]|NEXT\\]|/?SYS\\])", "[\\\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash less; undoes escape()."""
    return F.regexp_replace(
        F.regexp_replace(text, "<\\\\(\\\\*)(/?s>)", "<$1$2"), "\\[\\\\(\\\\*)(/?INST\\]|/?TURN\\]|TEXT\\]|NEXT\\]|/?SYS\\])", "[$1$2"
    )


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """conv_id, formatted and loss_runs (array of chars, in_loss) of every conversation; one shuffle, by conversation.

    Null texts and roles are empty. Null conversation ids make one conversation, with a null id. Turns are ordered by
    turn (null first); ties by role, then text; repeated rows are turns of their own. An empty table gives no rows.
    A conversation becomes one value, so it is bounded by what a row can hold.
    """
    rows = pick(turns, conv_id=conversation, turn=turn, role=role, text=text).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    escaped = rows.select("conv_id", F.struct("turn", "role", "text", escape(F.col("role")).alias("shown"), escape(F.col("text")).alias("said")).alias("t"))
    sorted_turns = escaped.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t = F.col("t")

    def piece(x: Column, i: Column) -> Column:
        """What stands before a text, the text, and whether it is under the mask."""
        same = (i > 0) & (F.get(t, i - 1)["role"] == x["role"])
        opening = F.concat(F.when(i == 0, "<s>").otherwise("[/TURN]"), F.lit("[TURN]"), x["shown"], F.lit("[TEXT]"))
        return F.struct(
            F.when(same, F.lit("[NEXT]")).otherwise(opening).alias("before"),
            x["said"].alias("said"),
            (x["role"] == loss_role).alias("in_loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform(t, piece).alias("p"))
    p = F.col("p")
    ending = "[/TURN]</s>"

    def run(chars: Column, in_loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), in_loss.alias("in_loss"))

    runs = F.flatten(
        F.transform(p, lambda x: F.array(run(F.char_length(x["before"]), F.lit(False)), run(F.char_length(x["said"]), x["in_loss"])))
    )
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["said"])), ""), F.lit(ending)).alias("formatted"),
        F.concat(runs, F.array(run(F.lit(len(ending)), F.lit(False)))).alias("loss_runs"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, read from a formatted text alone."""
    body = F.regexp_replace(formatted, "^<s>|\\[/TURN\\]</s>$", "")
    blocks = F.transform(F.split(body, "\\[/TURN\\]", -1), lambda b: F.split(F.substring(b, len("[TURN]") + 1, 2**31 - 1), "\\[TEXT\\]", -1))

    def turns(block: Column) -> Column:
        shown = unescape(F.get(block, F.lit(0)))
        return F.transform(F.split(F.get(block, F.lit(1)), "\\[NEXT\\]", -1), lambda x: F.struct(shown.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_runs: Column) -> Column:
    """Array of the texts under the loss mask, unescaped: the mask's runs cut them out of the formatted text."""
    cut = F.split(F.regexp_replace(formatted, "\\[/TURN\\]</s>$", ""), _BEFORE_TEXT, -1)  # an empty string, then each text
    texts = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    masked = F.transform(
        texts, lambda x, i: F.struct(F.get(loss_runs, 2 * i + 1)["in_loss"].alias("on"), F.substring(x, F.lit(1), F.get(loss_runs, 2 * i + 1)["chars"].cast("int")).alias("x"))
    )
    return F.transform(F.filter(masked, lambda m: m["on"]), lambda m: unescape(m["x"]))


def digests(conversations: DataFrame) -> DataFrame:
    """Figures of formatted conversations, all read back from the formatted text and the mask."""
    read = conversations.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_runs")), "").alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
