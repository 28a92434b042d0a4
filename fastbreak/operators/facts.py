"""The fact by side, the schedule by team, and totals by game."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_long(stamped: DataFrame, excluded: Iterable[int] = ()) -> DataFrame:
    """Each stamped action once for the offence and once for the defence (then of the defending team), in one scan."""
    rows = stamped.where(~F.col("game_id").isin(list(excluded))) if list(excluded) else stamped
    sides = F.array(
        F.struct(F.lit("offense").alias("type_lineup"), F.col("team_id").alias("team"), F.col("lineup_hash_offense").alias("lineup_hash")),
        F.struct(F.lit("defense").alias("type_lineup"), F.col("team_id_defense").alias("team"), F.col("lineup_hash_defense").alias("lineup_hash")),
    )
    out = rows.withColumn("side", F.explode(sides)).drop("team_id", "team_id_defense", "lineup_hash_offense", "lineup_hash_defense")
    return out.select("*", "side.type_lineup", F.col("side.team").alias("team_id"), "side.lineup_hash").drop("side").where("lineup_hash is not null")


def sched_long(schedule: DataFrame, team_dict: DataFrame) -> DataFrame:
    """One row per game and team, teams named as in the rosters."""
    for k in (1, 2):
        ids = team_dict.select("game_year", F.col("team_id_schedule").alias(f"team{k}"), F.col("team_id_rosters").alias(f"id{k}"))
        schedule = schedule.join(ids, ["game_year", f"team{k}"])

    def side(a: int, b: int):
        return F.struct(F.lit(f"team{a}").alias("team_slot"), F.col(f"id{a}").alias("team_id"), F.col(f"team_name_eng_{a}").alias("team_name"), F.col(f"score_team{a}").alias("team_score"), F.col(f"id{b}").alias("opp_team_id"), F.col(f"team_name_eng_{b}").alias("opp_team_name"), F.col(f"score_team{b}").alias("opp_score"))

    return schedule.distinct().select("game_id", "game_year", "game_date", "gn", "game_type", F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select("game_id", "game_year", "game_date", "gn", "game_type", "s.*")


def final_schedule(long: DataFrame) -> DataFrame:
    """With margin, whether the team won, and whether it was at home."""
    return long.selectExpr("game_id", "game_year", "game_date", "gn", "game_type", "team_id", "team_name", "opp_team_id", "opp_team_name", "team_score", "opp_score", "team_score - opp_score as margin", "team_score > opp_score as has_won", "team_slot = 'team1' as is_home")


def ended(column: str = "final_end_poss"):
    """1 where a possession ended."""
    return F.coalesce(F.col(column), F.lit(False)).cast("int")


def lineup_cube(long: DataFrame, schedule: DataFrame) -> DataFrame:
    """Possessions and points (null if nothing was scored) of each team's lineup by side and game.

    All sums by lineup, team, player or group are sums of these rows; nothing else needs the actions again.
    """
    sums = long.groupBy("team_id", "lineup_hash", "type_lineup", "game_id").agg(F.sum(ended()).alias("poss"), F.sum("team_score").alias("pts"))
    return sums.join(schedule.select("game_id", "game_date", "game_year").distinct(), "game_id")


def lineup_totals_by_day(cube: DataFrame) -> DataFrame:
    """The same with no points as 0."""
    return cube.select("game_id", "team_id", "lineup_hash", "type_lineup", F.col("poss").alias("total_poss"), F.coalesce("pts", F.lit(0)).alias("total_pts"), F.col("game_date").alias("g_date"), "game_year")
