"""Cleaned actions, rosters and substitutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_actions(actions: DataFrame) -> DataFrame:
    """Typed, scored actions, one for each (game, team, id): the one with the first user_time; without any, none.

    Of several with this time the least by the other columns in their order counts, nulls first.
    """
    seconds = "cast(split(quarter_time, ':')[0] as int) * 60 + cast(split(quarter_time, ':')[1] as int)"
    out = actions.where("type != 'clock'").withColumn("end_quarter_seconds_remaining", F.expr(f"try_cast({seconds} as int)"))
    out = out.withColumn("end_game_seconds_remaining", F.expr("cast(end_quarter_seconds_remaining + case when quarter < 5 then (4 - quarter) * 600 else 0 end as double)"))
    # A free throw of unknown outcome has unknown points.
    out = out.withColumn("parameters_points", F.expr("case when type = 'freeThrow' and parameters_made is null then null when type = 'freeThrow' and parameters_made = 'made' then 1 else parameters_points end"))
    out = out.withColumn("team_score", F.expr("case when parameters_made = 'made' then parameters_points end"))
    out = out.withColumn("parent_action_id", F.expr("case when parent_action_id = 0 then id else parent_action_id end"))
    key = ["game_id", "team_id", "id"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("user_time", *(c for c in out.columns if c not in (*key, "user_time"))))
    return out.where("user_time is not null").withColumn("__first", first).where("__first = 1").drop("__first")


def extract_rosters(documents: DataFrame, game_year: int | None = None) -> DataFrame:
    """(game, team, player) of both teams, away before home where a player is in both lists of one team."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("result.gameInfo.awayTeam").alias("team")), F.struct(F.lit(1).alias("side"), F.col("result.gameInfo.homeTeam").alias("team")))
    both = documents.where("result.gameInfo.homeTeam is not null and result.gameInfo.awayTeam is not null")
    rows = both.select(F.col("result.gameInfo.gameId").alias("game_id"), F.explode(sides).alias("s")).select("game_id", "s.side", "s.team", F.posexplode("s.team.players").alias("place", "p"))
    rows = rows.selectExpr("game_id", "team.id as team_id", "p.id as player_id", "p.firstName as firstname", "p.lastName as lastname", "team.name as team_name", "team.nameLocal as team_name_local", "side", "place")
    first = F.row_number().over(Window.partitionBy("game_id", "team_id", "player_id").orderBy("side", "place"))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first", "side", "place").withColumn("game_year", F.lit(game_year).cast("int"))


def substitutions(actions: DataFrame) -> DataFrame:
    """Substitutions; whoever comes in or goes out is the action's player."""
    out = actions.where("type = 'substitution'")
    for name in ("parameters_player_in", "parameters_player_out"):
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), F.col("player_id")))
    return out
