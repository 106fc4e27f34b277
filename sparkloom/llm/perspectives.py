"""Chat formatting by multi-party perspective rotation (operator 5). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The markers of the format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns that one row holds; a longer dialogue is several rows.
TURNS = 64
#: The speaker who is nobody's perspective.
SYSTEM = "system"


def _role(role: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(role), F.lit("")), F.lit("unknown"))


def _safe(text: Column) -> Column:
    """Text whose own '<|' can't be read as a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


#: What tells a conversation; the key is not null, so that joins and groups share a partitioning.
_CONV = ("conv_key", "conv_none")


def _ranked(said: DataFrame) -> DataFrame:
    """(mid, conv, nth): the place from 0 of each message in its conversation, by turn, role and digest of the text.

    Ranges of all messages in order are numbered apart and moved on by what
    earlier ranges hold of the same conversation, so no task sees a
    conversation whole. Texts stay behind.
    """
    parts = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "role", "digest", "mid"]
    narrow = said.select(*_CONV, "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "mid")
    # Written out: ranges are sampled, and would differ if they were made twice.
    ranged = materialize(narrow.repartitionByRange(parts, *_CONV, *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy(*_CONV, "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*_CONV).orderBy("range")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy(*_CONV, "range").orderBy(*order))
    return ranged.withColumn("here", nth).join(before, [*_CONV, "range"]).select(
        "mid", *_CONV, (F.col("before") + F.col("here") - 1).alias("nth")
    )


def rotate(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """For every participant, the dialogue with that speaker as the assistant.

    Rows (conv_id, participant, segment, n_messages, n_own, rendered, mask,
    n_masked). Messages come in the order of turn, then role and the text's
    MD5. The participant's messages are headed ``assistant``, the system's
    ``system``, all others ``user name=<role>``. ``mask`` lists the spans
    start:end (code points in ``rendered``, end exclusive) that are learnt: the
    participant's texts with their closing marker. A segment holds ``turns``
    successive messages, whatever their turn numbers, so no row holds more
    however long a conversation is; a participant without a message there
    still gets it, all context.

    A null text counts as empty, a null or blank role as ``unknown``; null
    turns come first; null conv_ids are one conversation. Markers inside texts
    are broken up. Repeated messages are kept. A conversation in which only the
    system speaks gives no rows, an empty table none. Extra columns are not read.
    """
    said = materialize(
        conversations.select(
            F.monotonically_increasing_id().alias("mid"),
            F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_key"),
            F.col("conv_id").isNull().alias("conv_none"),
            F.col("turn").cast("long").alias("turn"),
            _role(F.col("role")).alias("role"),
            _safe(F.col("text")).alias("text"),
        )
    )
    placed = materialize(_ranked(said).select("mid", *_CONV, "nth", F.floor(F.col("nth") / turns).alias("segment")))
    participants = said.select(*_CONV, F.col("role").alias("participant")).where(F.col("participant") != SYSTEM).distinct()
    views = placed.select(*_CONV, "segment").distinct().join(participants, list(_CONV))
    segments = (
        said.select("mid", "role", "text").join(placed, "mid")
        .groupBy(*_CONV, "segment")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text"))).alias("messages"))
    )
    seen = segments.join(views, [*_CONV, "segment"]).withColumn("conv_id", F.when(~F.col("conv_none"), F.col("conv_key")))

    own = F.col("participant")
    lines = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(
                F.lit(OPEN),
                F.when(m["role"] == own, "assistant").when(m["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), m["role"])),
                F.lit("\n"),
            ).alias("head"),
            F.concat(m["text"], F.lit(CLOSE)).alias("body"),
            (m["role"] == own).alias("own"),
        ),
    )
    shaped = seen.select("conv_id", "participant", "segment", lines.alias("lines"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        span = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        return F.struct(
            end.alias("at"),
            F.when(x["own"], acc["n"] + end - start).otherwise(acc["n"]).alias("n"),
            F.when(x["own"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    masked = shaped.withColumn("spans", F.aggregate("lines", start, step))
    return masked.select(
        "conv_id", "participant", "segment",
        F.size("lines").cast("long").alias("n_messages"),
        F.size(F.filter("lines", lambda x: x["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join("spans.out", ",").alias("mask"),
        F.col("spans.n").cast("long").alias("n_masked"),
    )
