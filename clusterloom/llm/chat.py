"""Chat formatting by multi-party perspective rotation.

For every participant a dialogue is rendered once, with that speaker as the
assistant, all others as named users, and a mask over what the assistant says.

A dialogue of any length is rendered in segments of ``segment_turns`` turn
numbers, so no task holds a whole one. Should very many rows share a turn
number, their segment is parted further by a hash of the row. Participants are
the distinct speakers of a dialogue, joined to its segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage

SEGMENT_TURNS = 64
#: Rows of a segment above which it is parted by a hash.
SEGMENT_ROWS = 512
#: The speaker of a turn without one.
UNKNOWN = "unknown"


def _render(turns: Column, perspective: Column, system: Sequence[str]) -> Column:
    """The text of a segment and the spans, in code points, that are targets."""
    nothing = F.struct(
        F.lit("").alias("text"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans")
    )

    def add(so_far: Column, turn: Column) -> Column:
        own = turn["speaker"] == perspective
        head = (
            F.when(turn["speaker"].isin(*system), F.lit("<|system|>\n"))
            .when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user|>"), turn["speaker"], F.lit("\n")))
        )
        body = F.concat(turn["text"], F.lit("<|end|>"))
        text = F.concat(so_far["text"], head, body, F.lit("\n"))
        lo = F.length(so_far["text"]) + F.length(head)
        span = F.struct(lo.cast("long").alias("lo"), (lo + F.length(body)).cast("long").alias("hi"))
        spans = F.when(own, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"])
        return F.struct(text.alias("text"), spans.alias("spans"))

    return F.aggregate(turns, nothing, add)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", system: Sequence[str] = ("system",),
                 segment_turns: int = SEGMENT_TURNS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``(conv, segment, part, perspective, n_turns, n_own, text, spans)``.

    One row for each participant and segment of a dialogue, the segments in which
    the participant says nothing included. Each turn is a header line, its text
    with an end mark, and a line end; ``spans`` are the code points of the text
    that the assistant is trained on, end marks included. ``segment`` is the turn
    number over ``segment_turns``; ``part`` is 0 unless the segment was parted.

    Turns go by number, then speaker, then text. A row that comes again with the
    same dialogue, number, speaker and text is the same turn. A null text is
    empty, a null role is the speaker ``unknown``, turns without a number come
    last (null ``segment``), and rows without a dialogue id form one dialogue of
    their own. Roles in ``system`` keep their header and have no perspective; a
    dialogue of nothing else gives no row.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("segment", F.floor(F.col("turn") / segment_turns))
    same = ["conv", "segment"]
    crowded = cut_lineage(
        rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment_rows)
        .select(*[F.col(c).alias(f"{c}_c") for c in same], F.ceil(F.col("n") / segment_rows).alias("n_parts"))
    )
    if crowded.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        here = F.col("conv").eqNullSafe(F.col("conv_c")) & F.col("segment").eqNullSafe(F.col("segment_c"))
        place = F.coalesce(F.col("turn") - F.col("segment") * segment_turns, F.lit(0)) * F.col("n_parts")
        number = place + F.pmod(F.xxhash64("speaker", "text"), F.col("n_parts"))
        rows = rows.join(crowded, here, "left").withColumn("part", F.coalesce(number, F.lit(0)).cast("long"))
    # repeated rows collapse before the shuffle
    segments = rows.groupBy("conv", "segment", "part").agg(
        F.sort_array(F.collect_set(F.struct("turn", "speaker", "text"))).alias("turns")
    )
    speakers = (
        rows.filter(~F.col("speaker").isin(*system))
        .select(F.col("conv").alias("conv_s"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    both = segments.join(speakers, F.col("conv").eqNullSafe(F.col("conv_s")))
    own = F.filter("turns", lambda t: t["speaker"] == F.col("perspective"))
    return both.withColumn(
        "rendered", _render(F.col("turns"), F.col("perspective"), system)
    ).select(
        F.col("conv").alias(conv_col), "segment", "part", "perspective",
        F.size("turns").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_own"),
        "rendered.text", "rendered.spans",
    )
