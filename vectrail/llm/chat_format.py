"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and its text alone
is trainable. A conversation that does not end on an assistant turn gives one more example, with
nothing trainable, so that the last example of a conversation always holds all its turns.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""Text without control strings: ``\`` becomes ``\b`` and ``<|`` becomes ``\l``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def format_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` to examples ``(conv_id, example, formatted, loss_start,
    loss_length)``; positions count code points from 0 and cover the escaped text of the target.

    Turns are ordered by turn, role and text, nulls first, so ties and repeated rows have a fixed
    place and stay. Null roles and texts are empty, a null conv_id is one conversation of its own,
    other columns are ignored. The examples of a conversation hold its prefixes, so their size grows
    with the square of its number of turns; conversations do not depend on each other.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("item"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    segments = F.transform(
        "items",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == target_role).alias("target"),
        ),
    )
    placed = grouped.select("conv_id", segments.alias("segments")).select(
        "conv_id",
        "segments",
        F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("upto"),
    )
    last = F.element_at("segments", F.col("upto"))
    chosen = placed.where(last["target"] | (F.col("upto") == F.size("segments")))
    whole = lambda s: F.concat(s["head"], s["body"], F.lit(END))
    context = F.array_join(F.transform(F.slice("segments", 1, F.col("upto") - 1), whole), "")
    return chosen.select(
        "conv_id",
        F.col("upto").cast("long").alias("example"),
        context.alias("context"),
        last.alias("last"),
    ).select(
        "conv_id",
        "example",
        F.concat("context", whole(F.col("last"))).alias("formatted"),
        (F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.target"), F.length("last.body")).otherwise(0).cast("long").alias(
            "loss_length"
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of structs ``(role, text)``."""
    parts = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.split_part(p, F.lit(TEXT), F.lit(1))).alias("role"),
            unescape(
                F.split_part(F.split_part(p, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))
            ).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    masked = F.substring(formatted, (loss_start + 1).cast("int"), loss_length.cast("int"))
    return unescape(masked)


def conversation_digest(examples: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its examples hold, read back from them."""
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        "formatted",
    )
    grouped = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.max_by("formatted", "example").alias("longest"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = grouped.select(
        "conv_id",
        "formatted_chars",
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
        read_turns(F.col("longest")).alias("turns"),
    )
    plain = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(plain, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
