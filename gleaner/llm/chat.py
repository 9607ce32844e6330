"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable.  An example is a prefix of its conversation's formatted text, so a conversation
is formatted once, and ``expand`` gives each example its own text and mask.

A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Inside roles and texts a
backslash is doubled, and the control strings of common templates get a backslash after their
first character; ``unescape`` gives the original back.

Null roles and texts are empty.  Turns are ordered by number (null first), role and text; repeated
rows are turns of their own.  Null conversation ids are one conversation.  A conversation that does
not end with an assistant turn gets a last example without a trainable part, so that every turn is
in some example.  Extra columns are ignored; an empty table gives an empty result.  One
conversation is one text and therefore handled by one task at a time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Strings that steer this or other common templates.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def _marked(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    doubled = _replace(F.coalesce(text, F.lit("")), "\\", "\\\\")
    return functools.reduce(lambda out, c: _replace(out, c, _marked(c)), CONTROL, doubled)


def unescape(text: Column) -> Column:
    plain = functools.reduce(lambda out, c: _replace(out, _marked(c), c), reversed(CONTROL), text)
    return _replace(plain, "\\\\", "\\")


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, formatted, examples), one row per conversation.

    ``examples``: structs (target: number of the turn from 1, chars: length of the prefix,
    loss_start: code points before the trainable text, loss_chars: its length).
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("head", F.concat(F.lit(TURN), role, F.lit(TEXT)))
        .withColumn("block", F.concat("head", text, F.lit(END)))
        .withColumns(
            {
                "target": F.row_number().over(order),
                "last": F.lead(F.lit(False), 1, True).over(order),
                "start": F.coalesce(F.sum(F.char_length("block")).over(ahead), F.lit(0)),
            }
        )
    )
    trained = F.coalesce(F.col("role") == assistant, F.lit(False))
    example = F.struct(
        "target",
        (F.col("start") + F.char_length("block")).alias("chars"),
        (F.col("start") + F.char_length("head")).alias("loss_start"),
        F.when(trained, F.char_length("block") - F.char_length("head") - len(END)).alias("loss_chars"),
    )
    collected = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("target", "block"))).alias("blocks"),
        F.array_sort(F.collect_list(F.when(trained | F.col("last"), example))).alias("examples"),
    )
    return collected.select(
        "conv_id", F.concat_ws("", F.col("blocks.block")).alias("formatted"), "examples"
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example: (conv_id, target, chars, text, loss_start, loss_chars).

    ``text`` is the whole example: the turns before its target as context, then the target.  The texts
    of a conversation together grow with the square of its turns, so they are formed row by row and
    should not be shuffled.  ``loss_chars`` is null in an example without a trainable part.
    """
    spans = formatted.select("conv_id", "formatted", F.inline("examples"))
    text = F.substring(F.col("formatted"), F.lit(1), F.col("chars")).alias("text")
    return spans.select("conv_id", "target", "chars", text, "loss_start", "loss_chars")


def example_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, target, text, loss_start, loss_chars) of expanded examples: text and mask alone."""
    return examples.select("conv_id", "target", "text", "loss_start", "loss_chars")


def trainable_text() -> Column:
    """The text under an example's mask, unescaped; null where nothing is trainable."""
    return unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as structs (role, text)."""
    blocks = F.split(formatted, END.replace("|", "\\|"))
    turns = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return F.transform(
        turns,
        lambda b: F.struct(
            unescape(_replace(F.split_part(b, F.lit(TEXT), F.lit(1)), TURN, "")).alias("role"),
            unescape(F.split_part(b, F.lit(TEXT), F.lit(2))).alias("text"),
        ),
    )
