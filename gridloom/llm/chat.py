"""Chat formatting: every assistant turn becomes an example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings. The template uses the first three; texts may hold none of them as they are.
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
CONTROL = (START, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _tails() -> str:
    return "|".join("".join(f"\\{x}" if not x.isalnum() and x != "_" else x for x in c[1:]) for c in sorted(CONTROL, key=lambda c: (-len(c), c)))


#: A control string, or one into which backslashes were put after its first character.
PATTERN, STUFFED = rf"([<\[])(\\*)({_tails()})", rf"([<\[])\\(\\*)({_tails()})"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every control string, stuffed or not, in ``text``."""
    return F.regexp_replace(text, PATTERN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, STUFFED, "$1$2$3")


def examples(turns: DataFrame) -> DataFrame:
    r"""Examples of conversations given by rows (conv_id, turn, role, text).

    A turn reads ``<|turn|>role<|says|>text<|done|>`` and a line end, role and text escaped.
    The example of an assistant turn holds all turns before it as context; only its
    own text is trainable. Turns after the last assistant turn make one more
    example, of which nothing is trainable, so no turn is lost.

    Defined cases: turns go by turn, null first, then role, then text; a null
    role or text is empty; a null conv_id is a conversation; repeated rows
    are turns of their own; only the role ``assistant`` (byte for byte) is
    trained on; an empty table gives no example; further columns are not
    looked at. A conversation is one group, as its examples are one text.

    Returns conv_id, example (from 0), formatted, loss_start and loss_length
    (code points, from 0; null where nothing is trainable), whole (the example
    that holds all turns).
    """
    spoken = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE))
    parts = spoken.select("conv_id", F.struct(F.col("t.turn"), F.col("t.role"), F.col("t.text"), head(F.col("t")).alias("head"), escape(F.col("t.text")).alias("body")).alias("t"))
    talks = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    tail = END + "\n"
    laid = talks.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("all"),
        # where each turn's text begins and ends, as running sums
        F.aggregate(
            "ts",
            F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<role:string,start:bigint,stop:bigint>>)").alias("out")),
            lambda a, t: F.struct(
                (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(tail)).cast("long").alias("at"),
                F.concat(a["out"], F.array(F.struct(t["role"].alias("role"), (a["at"] + F.length(t["head"])).cast("long").alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).cast("long").alias("stop")))).alias("out"),
            ),
        )["out"].alias("spans"),
    )
    said = F.filter("spans", lambda s: s["role"] == "assistant")
    rest = F.when(F.element_at("spans", -1)["role"] != "assistant", F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))))
    cut = laid.select("conv_id", "all", F.posexplode(F.concat(said, F.coalesce(rest, F.expr("cast(array() as array<struct<role:string,start:bigint,stop:bigint>>)")))).alias("example", "s"))
    upto = F.coalesce((F.col("s.stop") + len(tail)).cast("int"), F.length("all"))
    return cut.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.substring(F.col("all"), F.lit(1), upto).alias("formatted"),
        F.col("s.start").alias("loss_start"), (F.col("s.stop") - F.col("s.start")).alias("loss_length"), (upto == F.length("all")).alias("whole"),
    )


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int")))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    return F.transform(
        F.filter(F.split(formatted, F.lit(r"<\|done\|>\n")), lambda p: p != ""),
        lambda p: F.struct(unescape(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), MIDDLE, 1)).alias("role"), unescape(F.substring_index(p, MIDDLE, -1)).alias("text")),
    )


def digests(made: DataFrame) -> DataFrame:
    """What is read back from examples: one row for each conversation."""
    turns = parse(F.col("formatted"))
    own = made.select(
        "conv_id", "example", F.length("formatted").alias("chars"), trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.when(F.col("whole"), F.size(turns)).alias("n"),
        F.when(F.col("whole"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("sha"),
    )
    by = own.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: F.coalesce(e["loss"], F.lit(""))), "").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
