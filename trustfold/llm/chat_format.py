"""Chat formatting into budgeted training windows (native DataFrame code only).

Turns are written as ``<|role|>text</s>`` with the control characters of role and text escaped
reversibly, so that no text can imitate a marker. Prefix sums of turn tokens cut a conversation
into turn-aligned spans: turns that lie within one budget interval form a span, and a turn that
crosses an interval's end is a span of its own. Hence a span exceeds its budget only where one
turn alone does. Every span becomes a window: the first system turn (if it is not in the span
itself), limited history repeated from before the span, then the span. Loss covers the assistant
turns of the span; repeated turns are masked.

Defined cases: null text and role read as empty, rows with a null turn come last, ties are put
in order of role and text, repeated rows are all formatted, a null conversation id is one conversation.
An empty table gives an empty result. Other columns are ignored. One conversation is one row of
output digests, so its text meets in one task; a conversation must fit Spark's 2 GB string limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</s>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;")]


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def token_estimate(text: Column) -> Column:
    """About four characters a token, and one for the marker."""
    return (F.ceil(F.length(text) / F.lit(4)) + 1).cast("long")


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 192, target_role: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window (0, 1, ...), formatted, n_repeated, n_tokens, loss_spans.

    loss_spans holds (start, length) in code points of ``formatted``, from 1.
    """
    conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    marked = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("pos", F.row_number().over(conv))
        .withColumn("head", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>")))
        .withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .withColumn("tokens", token_estimate(F.col("piece")))
        .select("conv_id", "pos", "role", "head", "body", "piece", "tokens")
    )
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    system = F.when(F.col("role") == "system", F.struct("pos", "piece", "tokens"))
    summed = (
        marked.withColumn("upto", F.sum("tokens").over(upto))
        .withColumn("system", F.min(system).over(whole))
        .withColumn("start", F.col("upto") - F.col("tokens"))
        .withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))))
        .withColumn("slot", F.floor(F.col("start") / F.col("room")))
        .withColumn("alone", F.col("slot") != F.floor((F.col("upto") - 1) / F.col("room")))
    )
    # Turns before this one that begin within the history budget, without the retained system turn.
    near = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    kept = F.when((F.col("system").isNull()) | (F.col("pos") != F.col("system.pos")), F.struct("pos", "piece", "tokens"))
    begun = summed.withColumn("past", F.collect_list(kept).over(near))
    turn = F.struct("pos", "piece", F.col("role").alias("role"), F.length("head").alias("skip"), F.length("body").alias("size"), "tokens")
    spans = begun.groupBy("conv_id", "slot", "alone").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.min(F.struct("pos", "past")).alias("first"),
        F.first("system").alias("system"),
    )
    retained = F.when(F.col("system").isNotNull() & (F.col("system.pos") < F.col("first.pos")), F.array(F.struct("system.pos", "system.piece", "system.tokens")))
    lead = F.concat(
        F.coalesce(retained, F.array().cast("array<struct<pos:int,piece:string,tokens:bigint>>")), F.array_sort("first.past")
    )
    loss = F.aggregate(
        "turns",
        F.struct(F.col("lead_chars").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["role"] == target_role,
                F.array_append(acc["spans"], F.struct((acc["at"] + t["skip"] + 1).alias("start"), t["size"].alias("length"))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = lambda pieces: F.array_join(F.transform(pieces, lambda t: t["piece"]), "")
    count = lambda pieces: F.aggregate(pieces, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return (
        spans.withColumn("lead", lead)
        .withColumn("lead_text", text(F.col("lead")))
        .withColumn("lead_chars", F.length("lead_text"))
        .select(
            "conv_id",
            F.col("first.pos").alias("first_pos"),
            F.concat("lead_text", text(F.col("turns"))).alias("formatted"),
            F.size("lead").alias("n_repeated"),
            (count(F.col("lead")) + count(F.col("turns"))).alias("n_tokens"),
            loss.alias("loss_spans"),
        )
        .withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_pos")) - 1)
        .drop("first_pos")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Parse windows into conv_id, window, turns array<struct<role, text>> without repeats, loss_text."""
    pieces = F.split("formatted", END)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(3)), "|>", 1)).alias("role"),
        unescape(F.substring_index(p, "|>", -1)).alias("text"),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["length"]))), "")
    return windows.select("conv_id", "window", "formatted", F.transform(own, turn).alias("turns"), loss.alias("loss_text"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """Digests per conversation, computed from the formatted windows alone."""
    read = read_back(windows)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    rows = read.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", line), "").alias("said"),
            "loss_text",
            F.size("turns").alias("n"),
            F.length("formatted").alias("chars"),
        ).alias("w"),
    )
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("w")).alias("ws"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows")
    ).select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
