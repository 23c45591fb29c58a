"""Training examples from conversations by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Without ``<``, so that no text holds a mark of the template; ``unescaped`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    # An escaped text has "&" only as the start of an entity, so the order of these replacements is safe.
    text = F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    """The role stands on the first line of its turn; a newline in it is escaped too."""
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))


def examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``last_turn``, ``formatted``, ``loss_start``, ``loss_length``: one row per assistant turn.

    The example of a turn holds all turns before it and the turn itself; only
    its text is under the loss (a span of ``formatted`` in code points).  A
    conversation that does not end with an assistant turn has one more example
    that ends with its last turn and has no loss, so every turn is in the output.
    ``last_turn`` counts from 1.

    Turns go by ``turn`` (null first), ties by role and text; repeated rows are
    repeated turns.  A null role or text is empty; rows without a conversation
    id are one conversation.  Other columns are ignored, no rows give none.

    Turns move once, by conversation.  A conversation has to fit into a row, as
    its last example does in any form; examples are rows of their own, made one
    at a time.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    talks = talks.select(
        "conv_id",
        "said",
        F.transform("said", lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(CLOSE))).alias("shown"),
    )

    def end(at: Column) -> Column:
        said = F.element_at("said", at)
        size = F.length(escaped(said["text"]))
        return F.struct(at.alias("last_turn"), size.alias("size"), (said["role"] == TRAINED_ROLE).alias("trained"))

    places = F.sequence(F.lit(1), F.size("said"))
    ends = F.filter(places, lambda at: (F.element_at("said", at)["role"] == TRAINED_ROLE) | (at == F.size("said")))
    # Only numbers are exploded; each text is made in its own row.
    made = talks.select("conv_id", "shown", F.explode(F.transform(ends, end)).alias("end"))
    made = made.select("conv_id", "end.*", F.array_join(F.slice("shown", F.lit(1), F.col("end.last_turn")), "").alias("formatted"))
    return made.select(
        "conv_id",
        "last_turn",
        "formatted",
        (F.length("formatted") - F.col("size") - len(CLOSE)).alias("loss_start"),
        F.when(F.col("trained"), F.col("size")).otherwise(0).alias("loss_length"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """What the formatted texts and loss spans of ``examples`` say: one row per conversation.

    ``n_turns`` and ``turns_sha256`` come from the longest example, ``loss_chars`` and ``loss_sha256`` from the text
    under the loss of all examples in order, ``formatted_chars`` counts all formatted text.
    """
    loss = unescaped(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    talks = made.groupBy("conv_id").agg(
        F.max_by("formatted", "last_turn").alias("whole"),
        F.sort_array(F.collect_list(F.struct("last_turn", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.split(F.col("whole"), CLOSE)
    read = talks.select(
        "conv_id",
        "formatted_chars",
        F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.concat(unescaped(F.substr(part, F.lit(len(OPEN) + 1))), F.lit("\n"))
        ).alias("turns"),
        F.array_join(F.col("losses.loss"), "").alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
