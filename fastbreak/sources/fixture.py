"""The driver's events as play-by-play tables (FIXTURES.md, section 2)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _keyed(events: DataFrame) -> DataFrame:
    """Events with the symbols of the mapping: day, clock, team slot, opponent, key."""
    seconds = "hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as int)"
    out = events.selectExpr("cast(event_id as int) as id", "ts", "user_id", "event_type", f"{seconds} as sod", "hour(ts) as h", "datediff(ts, date'2024-01-01') as d", "cast(get_json_object(props, '$.k') as int) as k", "cast(user_id % 4 as int) as t")
    out = out.withColumn("opp", F.expr("t ^ (1 + d % 3)"))
    return out.withColumn("game_id", F.expr("d * 4 + least(t, opp)"))


def raw_actions(events: DataFrame) -> DataFrame:
    """One row per event, before cleaning."""
    kind = """case event_type when 'view' then 'shot' when 'click' then 'rebound' when 'purchase' then 'freeThrow' when 'signup' then 'substitution'
              else case when k < 40 then 'turnover' when k < 75 then 'foul' when k < 90 then 'block' else 'quarter' end end"""
    clock = "case when h < 23 then (21600 - (sod - (h div 6) * 21600)) div 36 else (3600 - (sod - 82800)) div 12 end"
    out = _keyed(events).withColumn("type", F.expr(kind)).withColumn("clock", F.expr(clock).cast("int"))
    parent = F.last(F.when(~F.col("type").isin("rebound", "freeThrow", "block"), F.col("id")), ignorenulls=True).over(Window.partitionBy("game_id").orderBy("id").rangeBetween(Window.unboundedPreceding, 0))
    return out.withColumn("parent_action_id", F.coalesce(parent, F.col("id"))).selectExpr(
        "game_id", "id", "parent_action_id", "t + 1 as team_id", "cast((t + 1) * 100 + (user_id div 4) % 8 as int) as player_id", "type",
        "cast(case when h < 23 then 1 + h div 6 else 5 end as int) as quarter",
        "lpad(cast(clock div 60 as string), 2, '0') || ':' || lpad(cast(clock % 60 as string), 2, '0') as quarter_time", "cast(ts as string) as user_time",
        "case type when 'shot' then case when k < 45 then 'made' when k < 90 then 'missed' else 'blocked' end when 'freeThrow' then case when k < 75 then 'made' else 'missed' end end as parameters_made",
        "case type when 'rebound' then case when k < 30 then 'offensive' else 'defensive' end when 'foul' then case when k < 70 then 'personal' else 'technical' end when 'quarter' then 'end-of-quarter' end as parameters_type",
        "case type when 'shot' then case when k % 3 = 0 then 3 else 2 end when 'freeThrow' then 1 end as parameters_points",
        "case when type = 'freeThrow' then 1 + k % 2 end as parameters_free_throw_number", "case when type = 'freeThrow' then 2 end as parameters_free_throws_awarded",
        "case when type = 'substitution' and k % 10 < 7 then cast((t + 1) * 100 + (user_id div 4) % 8 as int) end as parameters_player_in",
        "case when type = 'substitution' and k % 10 >= 7 then cast((t + 1) * 100 + (user_id div 4) % 8 as int) end as parameters_player_out",
    )


def games(events: DataFrame) -> DataFrame:
    """One row per game: its day and its two teams, the lower slot first."""
    return _keyed(events).groupBy("game_id").agg(F.min("d").alias("d"), F.min(F.least("t", "opp")).alias("low"), F.max(F.greatest("t", "opp")).alias("high"))


def rosters(events: DataFrame) -> DataFrame:
    """Eight players for each team of each game."""
    team = games(events).select("game_id", "d", F.explode(F.array("low", "high")).alias("t"))
    return team.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")).selectExpr(
        "game_id", "t + 1 as team_id", "(t + 1) * 100 + slot as player_id", "'P' as firstname", "cast(slot as string) as lastname", "'T' || (t + 1) as team_name",
        "cast(null as string) as team_name_local", "case when d < 15 then 2025 else 2026 end as game_year",
    )


def schedule(events: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per game, with the points of its made shots as scores."""
    points = actions.where("parameters_made = 'made'").groupBy("game_id", "team_id").agg(F.sum("team_score").alias("points"))
    base = games(events)
    for name in ("low", "high"):
        base = base.join(points.select("game_id", (F.col("team_id") - 1).alias(name), F.col("points").alias(f"{name}_points")), ["game_id", name], "left")
    base = base.selectExpr("*", "case when d % 2 = 0 then low else high end as one", "case when d % 2 = 0 then high else low end as two", "coalesce(low_points, 0) as lp", "coalesce(high_points, 0) as hp")
    return base.selectExpr(
        "game_id", "case when d < 15 then 2025 else 2026 end as game_year", "date_add(date'2024-01-01', d) as game_date", "d + 1 as gn", "element_at(array(5, 16, 34), game_id % 3 + 1) as game_type",
        "11 + one as team1", "11 + two as team2", "'T' || (one + 1) as team_name_eng_1", "'T' || (two + 1) as team_name_eng_2",
        "cast(case when d % 2 = 0 then lp else hp end as int) as score_team1", "cast(case when d % 2 = 0 then hp else lp end as int) as score_team2",
    )


def team_dict(spark: SparkSession) -> DataFrame:
    return spark.sql("select cast(y as int) as game_year, cast(10 + t as int) as team_id_schedule, cast(t as int) as team_id_rosters from (select explode(array(2025, 2026)) as y) cross join (select explode(sequence(1, 4)) as t)")


#: The one game that the fact leaves out here.
EXCLUDED = [14]


def season(game_year: int) -> tuple[date, date]:
    """First and last day of the mapping's seasons."""
    return (date(2024, 1, 1), date(2024, 1, 15)) if game_year < 2026 else (date(2024, 1, 16), date(2024, 1, 30))


def documents(events: DataFrame) -> DataFrame:
    """One play-by-play document per game, as the feed lands it."""
    parameters = {"made": "made", "type": "type", "points": "points", "playerIn": "player_in", "playerOut": "player_out", "freeThrowNumber": "free_throw_number", "freeThrowsAwarded": "free_throws_awarded"}
    plain = {"id": "id", "parentActionId": "parent_action_id", "type": "type", "quarter": "quarter", "quarterTime": "quarter_time", "userTime": "user_time", "teamId": "team_id", "playerId": "player_id"}
    action = F.struct(*(F.col(v).alias(k) for k, v in plain.items()), F.struct(*(F.col(f"parameters_{v}").alias(k) for k, v in parameters.items())).alias("parameters"))
    actions = raw_actions(events).groupBy("game_id").agg(F.sort_array(F.collect_list(action)).alias("actions"))
    player = F.struct(F.col("player_id").alias("id"), F.col("firstname").alias("firstName"), F.col("lastname").alias("lastName"))
    teams = rosters(events).groupBy("game_id", "team_id", "team_name").agg(F.sort_array(F.collect_list(player)).alias("players"))
    team = F.struct(F.col("team_id").alias("id"), F.col("team_name").alias("name"), "players")
    both = teams.groupBy("game_id").agg(F.min(team).alias("homeTeam"), F.max(team).alias("awayTeam"))
    info = F.struct(F.col("game_id").alias("gameId"), "homeTeam", "awayTeam").alias("gameInfo")
    return actions.join(both, "game_id").select(F.struct(info, "actions").alias("result"))


def schedule_documents(schedule: DataFrame) -> DataFrame:
    """The schedule feed, one document per season."""
    game = F.struct(F.col("game_id").cast("string").alias("ExternalID"), F.date_format("game_date", "d/M/yyyy").alias("game_date_txt"), "score_team1", "score_team2", "team1", "team2", "team_name_eng_1", "team_name_eng_2", "gn", "game_type")
    return schedule.groupBy("game_year").agg(F.collect_list(game).alias("games")).select("games")
