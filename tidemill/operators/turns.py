"""Conversations put together from their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one part of a conversation, by number.
PART = 128


def assemble(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row for each part of a conversation: conv_id, part, n_turns, n_missing, n_repeated, roles and transcript, from conv_id, turn, role and text.

    A part has the turns of `part` consecutive numbers, so no row holds a whole conversation that never ends. Turns stand by number, and those of one number by role and
    text (nulls first). n_missing counts the numbers left out before a turn of the part since the turn before it, in
    whichever part that stands (from 0 on for the first); n_repeated counts turns whose role is that of the turn before. In
    the transcript turns of one role in a row become one, after the role's name; runs stand on lines of their own. A null role or text counts as empty.
    roles has the role of each run. Rows without a conv_id or turn, or with a negative turn, are left out.

    The nested rows are bounded by the part; from part to part only the last turn's number and role are carried, by a window
    over one small row for each part.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nested = turns.where("conv_id IS NOT NULL AND turn >= 0").groupBy("conv_id", F.floor(F.col("turn") / part).cast("long").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    last = F.col("rows")[F.size("rows") - 1]
    order = Window.partitionBy("conv_id").orderBy("part")
    carried = nested.select("conv_id", "part", F.lag(F.struct(last["turn"].alias("turn"), last["role"].alias("role"))).over(order).alias("carried"))
    both = nested.join(carried, ["conv_id", "part"])

    def before(i: Column, name: str) -> Column:
        return F.when(i > 0, F.get(F.col("rows"), i - 1)[name]).otherwise(F.col("carried")[name])

    gaps = F.transform("rows", lambda r, i: F.greatest(F.lit(0), r["turn"] - F.coalesce(before(i, "turn"), F.lit(-1)) - 1))
    repeated = F.filter("rows", lambda r, i: F.coalesce(r["role"] == before(i, "role"), F.lit(False)))
    starts = F.filter("rows", lambda r, i: (i == 0) | (r["role"] != F.get(F.col("rows"), i - 1)["role"]))
    said = F.transform("rows", lambda r, i: F.when((i > 0) & (r["role"] == F.get(F.col("rows"), i - 1)["role"]), F.concat(F.lit(" "), r["text"])).otherwise(F.concat(F.when(i > 0, F.lit("\n")).otherwise(F.lit("")), r["role"], F.lit(": "), r["text"])))
    return both.select(
        "conv_id", "part", F.size("rows").cast("long").alias("n_turns"), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g).alias("n_missing"), F.size(repeated).cast("long").alias("n_repeated"),
        F.array_join(F.transform(starts, lambda r: r["role"]), ",").alias("roles"), F.array_join(said, "").alias("transcript"),
    )
