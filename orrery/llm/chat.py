"""Chat formatting with a grammar round trip, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

# In a text, "<|" with any number of backslashes between the two gets one more; reading takes it away again. So an
# escaped text has no control string, and a text without such a pair stays as it is.


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def render(turns: Column) -> Column:
    """One string of an array of (role, text) structs."""
    return F.concat(
        F.lit(""),
        F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "\n"),
        F.when(F.size(turns) > 0, "\n").otherwise(""),
    )


def parse(formatted: Column) -> Column:
    """The (role, text) structs of a rendered string, unescaped: the deterministic grammar is
    (START role newline text END newline)*, in which neither role nor text holds START or END."""
    bodies = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**31 - 2)

    def turn(body: Column) -> Column:
        inner = F.split(body, r"<\|im_end\|>")[0]
        cut = F.instr(inner, "\n")
        return F.struct(_role_in(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(bodies, turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted, mask): a training string for each conversation of (conv_id, turn, role, text).

    Rows of a conversation go by turn (null first), then role, then text; repeated rows stay; null role or text is
    empty; rows with null conv_id are one conversation. A conversation is rendered as it is and parsed again;
    where that gives other turns than the source, its texts are rendered escaped and parsed once more, and what still differs
    then is an error rather than a row, as one more escape is not taken away by reading. mask holds (start, stop)
    code points of the formatted string: the texts of assistant turns, over which the loss is taken.
    Columns besides these four are left out.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    plain = lambda t: F.struct(_role_out(t["role"]).alias("role"), t["text"].alias("text"))
    safe = lambda t: F.struct(_role_out(t["role"]).alias("role"), escaped(t["text"]).alias("text"))
    held = (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )
    shown = (
        held.withColumn("_raw", F.transform("turns", plain))
        .withColumn("_same", parse(render(F.col("_raw"))) == F.col("turns"))
        .withColumn("_shown", F.when(F.col("_same"), F.col("_raw")).otherwise(F.transform("turns", safe)))
    )
    head = len(START) + 1
    step = lambda t: F.length(t["role"]) + F.length(t["text"]) + F.lit(head + len(END) + 1)
    walked = F.aggregate(
        "_shown",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("mask")),
        lambda a, t: F.struct(
            (a["at"] + step(t)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(a["mask"], F.array(F.struct((a["at"] + head + F.length(t["role"])).alias("start"), (a["at"] + head + F.length(t["role"]) + F.length(t["text"])).alias("stop")))),
            ).otherwise(a["mask"]).alias("mask"),
        ),
    )
    told = shown.withColumn("formatted", render(F.col("_shown")))
    kept = F.col("_same") | (parse(F.col("formatted")) == F.col("turns"))
    lost = F.raise_error(F.concat(F.lit("turns aren't read back from conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")
    return told.select("conv_id", "turns", F.when(kept, F.col("formatted")).otherwise(lost).alias("formatted"), walked["mask"].alias("mask"))


def report(formatted: DataFrame) -> DataFrame:
    """Digest columns, all read back from the formatted string and its mask."""
    read = formatted.withColumn("_read", parse(F.col("formatted"))).withColumn(
        "_loss", F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int")))), "")
    )
    told = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
