"""Who is on court after each substitution, and the groups of players in each lineup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feeds import unseen

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def lineups_lookup(rosters: DataFrame, subs: DataFrame) -> DataFrame:
    """Every rostered player at every substitution of the team, with what is known of them and the lineup then.

    Of several substitutions at one clock reading the last counts; which one that is, is the same for all players, so
    the others reach only the player whom they are about. The fan-out is the size of a roster, so both inputs are dealt
    by game before it; the join and all windows find their rows where they are.
    """
    players = rosters.repartition("game_id").groupBy("player_id", "game_id", "team_id").agg(F.min("game_year").alias("game_year"))
    events = subs.repartition("game_id").select("game_id", F.col("team_id").alias("of_team"), "id", "quarter", "quarter_time", "end_game_seconds_remaining", "user_time", "parameters_player_in", "parameters_player_out")
    clock = Window.partitionBy("game_id", "of_team", "quarter", "quarter_time", "end_game_seconds_remaining").orderBy(F.desc("id"), F.desc("user_time"))
    events = events.withColumn("back", F.row_number().over(clock))
    # The team is no key of the join: rows would have to be dealt by it too.
    rows = players.join(events, "game_id").where("team_id - of_team = 0").drop("of_team")
    rows = rows.withColumn("is_on", F.expr("case when player_id = parameters_player_in then 1 when player_id = parameters_player_out then 0 end")).where("back = 1 or is_on is not null")
    by_player = Window.partitionBy("game_id", "player_id").orderBy("id", "quarter", F.desc("end_game_seconds_remaining"), "user_time")
    rows = rows.withColumn("is_on", F.last("is_on", ignorenulls=True).over(by_player.rowsBetween(Window.unboundedPreceding, 0))).where("back = 1").withColumnRenamed("is_on", "is_on_verdict")
    at = Window.partitionBy("game_id", "team_id", "quarter", "end_game_seconds_remaining").orderBy("player_id").rowsBetween(*WHOLE)
    on = F.when(F.col("is_on_verdict") == 1, F.col("player_id").cast("string"))
    rows = rows.withColumns({
        "lineup_id": F.nullif(F.array_join(F.collect_list(on).over(at), "_"), F.lit("")),
        "n_on": F.sum(F.when(F.col("is_on_verdict") == 1, 1).otherwise(0)).over(Window.partitionBy("game_id", "team_id", "quarter", "id")),
    })
    return rows.withColumn("lineup_hash", F.md5("lineup_id")).select("game_id", "team_id", "player_id", "id", "quarter", "quarter_time", "end_game_seconds_remaining", "is_on_verdict", "lineup_id", "n_on", "lineup_hash", "game_year")


def on_court_members(lookup: DataFrame) -> DataFrame:
    """Distinct (lineup, team, player, season) of players on court."""
    return lookup.where("is_on_verdict = 1 and lineup_hash is not null").select("lineup_hash", "team_id", "player_id", "game_year").distinct()


def new_members(lookup: DataFrame, loaded: DataFrame) -> DataFrame:
    """What on_court_members() has and the loaded table doesn't."""
    return unseen(on_court_members(lookup), loaded, ["lineup_hash", "team_id", "player_id", "game_year"])


def sub_lineups(members: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """All groups of the given sizes of each lineup's players, ids ascending.

    Each size joins the members once more, in rising order of ids, so groups of size k reuse those of k - 1.
    """
    keys = ["team_id", "lineup_hash", "game_year"]
    one = members.select(*keys, F.col("player_id").alias("p")).distinct()
    groups, found = one.select(*keys, F.array("p").alias("player_ids"), F.col("p").alias("top")), []
    for size in range(2, max(sizes) + 1):
        groups = groups.join(one, keys).where("p > top").select(*keys, F.concat("player_ids", F.array("p")).alias("player_ids"), F.col("p").alias("top"))
        if size in sizes:
            found.append(groups.select(*keys, "player_ids", F.lit(size).cast("short").alias("num_lineup")))
    out = reduce(DataFrame.unionByName, found).withColumn("lineup_id", F.array_join("player_ids", "_"))
    return out.withColumn("sub_lineup_hash", F.md5("lineup_id"))


def full_lineups(members: DataFrame, size: int = 5) -> DataFrame:
    """Lineups of exactly so many players, in the shape of sub_lineups()."""
    arrays = members.groupBy("team_id", "lineup_hash", "game_year").agg(F.sort_array(F.collect_set("player_id")).alias("player_ids")).where(F.size("player_ids") == size)
    return arrays.select("*", F.lit(size).cast("short").alias("num_lineup"), F.array_join("player_ids", "_").alias("lineup_id"), F.col("lineup_hash").alias("sub_lineup_hash"))
