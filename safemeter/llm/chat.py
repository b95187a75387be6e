"""Chat formatting by rotating the perspective over the parties of a dialogue.

For every participant the dialogue is rendered with that speaker as the assistant, the
others as named users, and only the assistant's turns trained.  The result has a row per
perspective and turn; the segments of a perspective, joined in the order of ``position``,
are its dialogue.  Positions and character offsets are running sums: within the partitions
of a range sort, then over the partitions' totals, so one conversation may hold any share
of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_partitions, written

#: The role whose turns are context for everyone: rendered as it is, never trained, no perspective of its own.
SYSTEM = "system"
#: Name of a speaker that is null.
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotated(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn: the conversation id, ``perspective``
    (a speaker), ``position`` (0, 1, 2 ...), ``role`` (system, assistant or user), ``name``
    (of a user, else null), ``segment`` (the rendered turn), ``start`` and ``end`` (character
    offsets of its content in the rendered dialogue) and ``trained``.

    Turns go by turn number, nulls first; equal numbers go by speaker, then text, so repeated
    rows each appear.  Null text counts as empty; a null speaker is named ``unknown``; rows
    with a null conversation id form one conversation.  A conversation of system turns only
    has no participant and so no rows.  A conversation of p participants and t turns has
    p * t rows, as the format asks.  An empty table gives an empty result.  Other columns are not
    read.
    """
    spark = turns.sparkSession
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), speaker.alias("who"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["c", "t", "who", "said", "row"]
    rows = written(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "turns")
    parties = rows.where(F.col("who") != SYSTEM).select("c", "who").distinct().select(F.col("c").alias("conv"), F.col("who").alias("perspective"))
    turned = rows.join(parties, rows["c"].eqNullSafe(parties["conv"])).drop("conv")

    own = F.col("who") == F.col("perspective")
    role = F.when(F.col("who") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    turned = turned.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("who")))
    head = F.concat(F.lit(OPEN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    turned = turned.withColumn("head", F.char_length(head)).withColumn("segment", F.concat(head, F.col("said"), F.lit(CLOSE)))
    turned = turned.withColumn("length", F.char_length("segment").cast("long"))

    near = Window.partitionBy("c", "perspective", "part").orderBy("t", "who", "said", "row").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    turned = turned.withColumns({"n_here": F.coalesce(F.count("*").over(near), zero), "at_here": F.coalesce(F.sum("length").over(near), zero)})
    far = Window.partitionBy("c", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turned.groupBy("c", "perspective", "part").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    parts = parts.select(F.col("c").alias("c2"), F.col("perspective").alias("p2"), F.col("part").alias("part2"), F.coalesce(F.sum("n").over(far), zero).alias("n_before"), F.coalesce(F.sum("size").over(far), zero).alias("at_before"))
    out = turned.join(parts, turned["c"].eqNullSafe(parts["c2"]) & (turned["perspective"] == parts["p2"]) & (turned["part"] == parts["part2"]))
    start = F.col("at_here") + F.col("at_before") + F.col("head")
    return out.select(
        F.col("c").alias(conv_col), "perspective", (F.col("n_here") + F.col("n_before")).alias("position"), "role", "name", "segment",
        start.alias("start"), (start + F.char_length("said")).alias("end"), (F.col("role") == "assistant").alias("trained"),
    )


ROTATED_SQL = """
with said as (select conv_id, turn, coalesce(role, 'unknown') as who, coalesce(text, '') as said from conversations),
parties as (select distinct conv_id, who as perspective from said where who <> 'system'),
turned as (
  select s.*, p.perspective, case when who = 'system' then 'system' when who = perspective then 'assistant' else 'user' end as role
  from said s join parties p on s.conv_id is not distinct from p.conv_id),
rendered as (
  select *, case when role = 'user' then who end as name,
    '<|im_start|>' || role || case when role = 'user' then ' name=' || who else '' end || chr(10) as head from turned),
whole as (select *, head || said || '<|im_end|>' || chr(10) as segment from rendered),
placed as (
  select *, row_number() over w - 1 as position, coalesce(sum(length(segment)) over (w rows between unbounded preceding and 1 preceding), 0) as written
  from whole window w as (partition by conv_id, perspective order by turn nulls first, who, said))
select conv_id, perspective, cast(position as bigint) as position, role, name, segment, cast(written + length(head) as bigint) as "start",
  cast(written + length(head) + length(said) as bigint) as "end", role = 'assistant' as trained from placed
"""
