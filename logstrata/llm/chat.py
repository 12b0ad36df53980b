"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is
trainable. Turns after the last reply are kept in a closing example with nothing to train.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mean something to this template or to the tokenizers of others; in a text they are escaped.
CONTROLS = (TURN, TEXT, END, "</s>", "<s>", "[INST]", "[/INST]")
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double each backslash and put one into each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_conversations(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Expand conversations (conv_id, turn, role, text) into training examples.

    Returns conv_id, example (index of its last turn), is_last, formatted, loss_start, loss_end. The loss span is
    in code points of formatted, end exclusive, and null in a closing example. Turns are ordered by turn,
    null first, then role and text, so that rows that share a turn have a defined order; a null role or text is empty;
    repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table gives no
    example. Other columns are not read.
    """
    turns = (
        conversations.select(
            F.col(conv).alias("conv_id"),
            F.struct(
                F.col("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    laid = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
        F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("trainable"),
    )
    last = F.size("texts") - 1
    picked = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("trainable", i) | (i == last))
    examples = laid.select("*", F.explode(picked).alias("example"))
    whole = F.transform(
        F.sequence(F.lit(0), F.col("example")),
        lambda i: F.concat(F.get("heads", i), F.get("texts", i), F.lit(END)),
    )
    end = F.char_length("formatted") - len(END)
    trains = F.get("trainable", F.col("example"))
    return (
        examples.withColumn("formatted", F.array_join(whole, ""))
        .withColumn("loss_end", F.when(trains, end))
        .select(
            "conv_id",
            "example",
            (F.col("example") == last).alias("is_last"),
            "formatted",
            (F.col("loss_end") - F.char_length(F.get("texts", F.col("example")))).alias("loss_start"),
            "loss_end",
        )
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted example."""
    parts = F.split(formatted, "\\Q" + END + "\\E", -1)
    rest = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, len(TURN) + 1, 2**31 - 1))
    role = lambda p: F.substring_index(p, TEXT, 1)
    text = lambda p: p.substr(F.char_length(role(p)) + len(TEXT) + 1, F.lit(2**31 - 1))
    return F.transform(rest, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, from nothing but its formatted examples."""
    turns = F.when(F.col("is_last"), parse_turns(F.col("formatted")))
    each = examples.select(
        "conv_id",
        "example",
        F.char_length("formatted").cast("long").alias("chars"),
        turns.alias("turns"),
        F.when(
            F.col("loss_start").isNotNull(),
            unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))),
        ).alias("target"),
    ).select(
        "conv_id",
        "example",
        "chars",
        "target",
        F.size("turns").cast("long").alias("n"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("sha"),
    )
    found = each.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.withColumn("loss", F.array_join(F.transform("targets", lambda t: t["target"]), "")).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
