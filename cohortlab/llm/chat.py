"""Operator 3: prefix-target expansion of conversations.

Every assistant turn becomes its own example: all turns before it are context,
and only that reply is trainable. Turns after the last reply (or a conversation
without one) make one more example without a trainable span, so that nothing of
a conversation is lost. Texts and roles are escaped reversibly, so an example
can be read back into its turns. DataFrame expressions only.

A turn is written ``<|turn|>role\\ntext<|end|>\\n``. Escaping doubles every
backslash and then puts one behind the first character of each control string;
a run of backslashes from a text is even, so a single one marks an escape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import table

TURN, END = "<|turn|>", "<|end|>\n"
#: What no text may show unescaped, the marks of this template and of common others.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REPLY_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), reversed(CONTROL), text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role stands on one line: its newlines are escaped as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def expand(turns: DataFrame, reply_role: str = REPLY_ROLE) -> DataFrame:
    """Examples of all conversations.

    ``turns``: conv_id, turn, role, text; more columns are ignored. One row per
    example: conv_id, example (from 0), context (text not trained on), target
    (the trainable reply, empty in the closing example), tail (the end mark
    behind it), trainable, loss_start, loss_end (code points in context || target || tail). Turns are ordered by
    turn, then role, then text (nulls first), so equal turn numbers and
    repeated rows keep a defined order and each stays a turn of its own. Null
    roles and texts count as empty; rows without conv_id form one conversation.
    A conversation is one row while it is formatted, as each example holds all
    turns before its reply.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    marked = convs.select("conv_id", "turns", heads.alias("heads"), bodies.alias("bodies"))
    whole = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    is_reply = lambda t: t["role"] == reply_role
    n = F.size("turns")
    replies = F.filter(F.transform("turns", lambda t, i: F.when(is_reply(t), i)), lambda i: i.isNotNull())
    ends = marked.select("conv_id", "heads", "bodies", n.alias("n"), replies.alias("replies"), whole.alias("whole"))
    closing = F.when(F.coalesce(F.element_at("replies", F.when(F.size("replies") > 0, -1)), F.lit(-1)) < F.col("n") - 1, F.array("n"))
    listed = ends.select("conv_id", "heads", "bodies", "whole", "n", F.concat("replies", F.coalesce(closing, F.array().cast("array<int>"))).alias("at"))
    rows = listed.select("conv_id", "heads", "bodies", "whole", "n", F.posexplode_outer("at").alias("example", "at"))
    before = F.array_join(F.slice("whole", F.lit(1), F.col("at")), "")
    built = rows.select(
        "conv_id", "example", (F.col("at") < F.col("n")).alias("trainable"),
        F.concat(before, F.coalesce(F.get("heads", F.col("at")), F.lit(""))).alias("context"),
        F.coalesce(F.get("bodies", F.col("at")), F.lit("")).alias("target"),
    )
    return built.select(
        "conv_id", "example", "context", "target", F.when(F.col("trainable"), END).otherwise("").alias("tail"), "trainable",
        F.length("context").cast("long").alias("loss_start"),
        (F.length("context") + F.length("target")).cast("long").alias("loss_end"),
    )


def formatted(examples: DataFrame) -> Column:
    return F.concat("context", "target", "tail")


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and trained text of each conversation, parsed from its formatted examples alone.

    One row per conversation: conv_id, n_turns, turns_sha256 (role, newline,
    text, newline per turn), loss_chars, loss_sha256 (all text under the loss
    mask, in order), formatted_chars (of all its examples), n_examples.
    """
    last = F.max_by("text", "example")
    spans = F.sort_array(F.collect_list(F.struct("example", "loss")))
    masked = examples.select(
        "conv_id", "example", formatted(examples).alias("text"), "loss_start", "loss_end"
    ).select(
        "conv_id", "example", "text", F.length("text").cast("long").alias("chars"),
        unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("loss"),
    )
    convs = masked.groupBy("conv_id").agg(
        last.alias("text"), F.array_join(F.transform(spans, lambda s: s["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    parts = F.filter(F.split("text", r"<\|turn\|>", -1), lambda p: p != "")
    turn = lambda p: F.regexp_replace(p, r"<\|end\|>\n$", "")
    said = F.transform(parts, lambda p: F.concat(_role(turn(p)), F.lit("\n"), _text(turn(p)), F.lit("\n")))
    return convs.select(
        "conv_id", F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(said, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"), F.col("n_examples").cast("long").alias("n_examples"),
    )


def _role(turn: Column) -> Column:
    return unescape_role(F.substring_index(turn, "\n", 1))


def _text(turn: Column) -> Column:
    return unescape(F.substring(turn, F.length(F.substring_index(turn, "\n", 1)) + 2, F.length(turn)))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(expand(turns))
