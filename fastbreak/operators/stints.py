"""Stretches during which neither team substitutes, and events stamped with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(possessions: DataFrame, lookup: DataFrame) -> DataFrame:
    """One team's lineup from a substitution to its next one, by clock and by action id, dealt by game."""
    last = possessions.where("quarter >= 4").groupBy("game_id", "quarter").agg(F.max("id").alias("last_id"))
    last = last.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("quarter", "last_id"))).alias("lasts"))
    rows = lookup.select("id", "game_id", "team_id", "quarter", "quarter_time", "end_game_seconds_remaining", "lineup_id", "lineup_hash").repartition("game_id").distinct()
    rows = rows.join(last, "game_id", "left").withColumn("last_id", F.col("lasts")[F.col("quarter")])
    w = Window.partitionBy("game_id", "team_id").orderBy("quarter", F.desc("end_game_seconds_remaining"), "id")
    rows = rows.withColumns({"next_q": F.lead("quarter").over(w), "next_s": F.lead("end_game_seconds_remaining").over(w), "next_id": F.lead("id").over(w)})
    return rows.selectExpr(
        "game_id", "team_id", "quarter", "lineup_hash", "end_game_seconds_remaining as start_segment",
        "case when next_q > quarter and next_q >= 5 then 0D else coalesce(next_s, 0D) end as end_segment", "id as start_id", "coalesce(next_id, last_id) as end_id",
    )


_SEGMENT = ("team_id", "quarter", "lineup_hash", "start_segment", "end_segment", "start_id", "end_id")


def _odd(start: str, end: str, by: list[str]) -> Column:
    """Whether intervals of one key overlap; an interval without end has none."""
    following = F.lead(start).over(Window.partitionBy(*by).orderBy(start, F.col(end).asc_nulls_last()))
    return F.coalesce(F.col(end) > following, following.isNotNull())


def stints(possessions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Both teams' segments intersected, once with each team as the offence.

    One pass over the game's segments by their first id: each meets the segment that the other team is in just then.
    Where a game's ids don't follow the clock, so that a team's own segments overlap, each meets all that came before.
    """
    seg = segments(possessions, lookup).where("end_id is null or end_id > start_id").withColumn("bucket", F.expr("case when quarter < 5 then 0 else quarter end"))
    game = Window.partitionBy("game_id")
    seg = seg.withColumns({"odd": _odd("start_id", "end_id", ["game_id", "team_id", "bucket"]), "low": F.min("team_id").over(game), "high": F.max("team_id").over(game)})
    seg = seg.withColumn("odd", F.max(F.col("odd") | ~F.col("team_id").isin(F.col("low"), F.col("high"))).over(game))
    past = Window.partitionBy("game_id", "bucket").orderBy("start_id", "team_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(*_SEGMENT)
    of = {side: F.last(F.when(F.col("team_id") == F.col(side), own), ignorenulls=True).over(past) for side in ("low", "high")}
    other = F.when(F.col("team_id") == F.col("low"), of["high"]).otherwise(of["low"])
    met = seg.withColumn("others", F.when(F.col("odd"), F.collect_list(F.when(F.col("odd"), own)).over(past)).otherwise(F.array(other)))
    met = met.select("game_id", own.alias("own"), F.explode("others").alias("other")).where("other.team_id != own.team_id")
    pair = F.array(F.struct(F.col("own").alias("o"), F.col("other").alias("d")), F.struct(F.col("other").alias("o"), F.col("own").alias("d")))
    rows = met.select("game_id", F.explode(pair).alias("p")).select("game_id", "p.o", "p.d").where("least(o.end_id, d.end_id) > greatest(o.start_id, d.start_id)").selectExpr(
        "o.team_id as team_id", "d.team_id as team_id_defense", "game_id", "case when least(o.quarter, d.quarter) < 5 then 0 else least(o.quarter, d.quarter) end as q_bucket",
        "least(o.start_segment, d.start_segment) as final_start_seg", "greatest(o.end_segment, d.end_segment) as final_end_seg",
        "o.lineup_hash as lineup_hash_offense", "d.lineup_hash as lineup_hash_defense", "greatest(o.start_id, d.start_id) as final_start_id", "least(o.end_id, d.end_id) as final_end_id",
    )
    return rows.withColumn("segment_id", F.dense_rank().over(Window.partitionBy("game_id").orderBy("final_start_id", "final_end_id")))


_STINT = ("team_id_defense", "final_start_seg", "final_end_seg", "lineup_hash_offense", "lineup_hash_defense", "final_start_id", "final_end_id", "segment_id")


#: Bits of the ids that share a slice of a game: no window of the stamps sees more of it at once.
SLICE = 14


def stamp(possessions: DataFrame, stint_rows: DataFrame) -> DataFrame:
    """Every action with the stint in [start, end) of its own team, if there is one.

    Games are cut into slices of ids. Stints stand among the actions of each slice that they reach, at their first id
    there, and each action looks back at the last one; where stints of a team overlap, at all of its slice.
    """
    # One sort serves all of these windows.
    key = ["game_id", "team_id", "q_bucket", "slice"]
    reached = F.explode(F.expr(f"sequence(shiftright(final_start_id, {SLICE}), shiftright(final_end_id - 1, {SLICE}))")).alias("slice")
    starts = stint_rows.where("final_end_id > final_start_id").select("*", reached).select(*key, F.expr(f"greatest(final_start_id, shiftleft(slice, {SLICE}))").alias("id"), F.struct(*_STINT).alias("stint"))
    actions = possessions.withColumn("slice", F.shiftright("id", SLICE)).withColumn("stint", F.lit(None).cast(starts.schema["stint"].dataType))
    rows = actions.unionByName(starts, allowMissingColumns=True).repartition("game_id", "slice").withColumn("action", F.col("stint").isNull())
    by = Window.partitionBy(*key).orderBy("id", "action")
    # The stint before this one in the list, or the one that the action may be in.
    before = F.last("stint", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    rows = rows.withColumn("odd", F.max(F.col("stint").isNotNull() & (F.col("before.final_end_id") > F.col("id"))).over(Window.partitionBy(*key)))
    every = F.collect_list(F.when(F.col("odd"), F.col("stint"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    listed = rows.withColumn("listed", F.when(F.col("odd"), every).otherwise(F.array("before"))).where("stint is null")
    found = F.explode_outer(F.filter("listed", lambda x: x["final_end_id"] > F.col("id")))
    return listed.select(*possessions.columns, found.alias("found")).select(*possessions.columns, *(F.col(f"found.{c}").alias(c) for c in _STINT))
