"""What is shown: pick lists, lineup tables with totals and percentiles, on/off tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import average_rank_percentile

TOTAL, ALL_LINEUPS = "TOTAL", "— All Lineups —"

#: Column titles of the on/off table.
TITLES = {
    "team_name": "Team", "player": "Player", "net_rtg_diff": "Net RTG Diff", "off_on_diff": "Off ON Diff", "def_on_diff": "Def ON Diff", "off_on_ppp": "Off ON PPP", "def_on_ppp": "Def ON PPP", "on_net_rtg": "On Net RTG",
    "off_off_ppp": "Off OFF PPP", "def_off_ppp": "Def OFF PPP", "off_net_rtg": "Off Net RTG", "on_poss": "ON Poss", "off_poss": "OFF Poss",
}


def season_teams(rosters: DataFrame, game_year: int | None = None) -> DataFrame:
    """Teams of a season (or of each), by name."""
    rows = rosters if game_year is None else rosters.where(F.col("game_year") == game_year)
    return rows.select("game_year", "team_id", "team_name").distinct().orderBy("game_year", "team_name", "team_id")


def season_players(rosters: DataFrame, game_year: int | None = None, team_ids: Sequence[int] | None = None) -> DataFrame:
    """One name for each player of a team and season, by name."""
    rows = rosters if game_year is None else rosters.where(F.col("game_year") == game_year)
    rows = rows if team_ids is None else rows.where(F.col("team_id").isin(list(team_ids)))
    name = F.min(F.concat(F.trim("firstname"), F.lit(" "), F.trim("lastname")))
    return rows.groupBy("game_year", "team_id", "player_id").agg(name.alias("player_name")).orderBy("game_year", "player_name", "player_id")


def opponent_ids(rosters: DataFrame, names: DataFrame, game_year: int) -> DataFrame:
    """(team_name, team_id) for names (column team_name) in a season; unknown names are left out."""
    return names.select("team_name").distinct().join(season_teams(rosters, game_year).select("team_name", "team_id"), "team_name")


def lineup_report(lineups: DataFrame, rosters: DataFrame) -> DataFrame:
    """Lineups with team names, all possessions and plus-minus, most possessions first."""
    names = rosters.select("game_year", "team_id", "team_name").distinct()
    rows = lineups.join(names, ["game_year", "team_id"], "left").withColumnsRenamed({"team_name": "team", "player_names_str": "players"})
    zero = F.lit(0)
    rows = rows.withColumns({"total_poss": F.coalesce("off_poss", zero) + F.coalesce("def_poss", zero), "plus_minus": F.coalesce("off_pts", zero) - F.coalesce("def_pts", zero)})
    return rows.select("team", "players", "total_poss", "plus_minus", "off_poss", "def_poss", "off_pts", "def_pts", "off_ppp", "def_ppp", "net_rtg", "num_lineup", "sub_lineup_hash").orderBy(F.desc("total_poss"), "sub_lineup_hash")


def with_total(report: DataFrame) -> DataFrame:
    """is_total 0 for the total row, which comes first; its ratings are of the sums, 0 without possessions. None for an empty report."""
    sums = report.agg(*(F.sum(c).alias(c) for c in ("off_poss", "def_poss", "off_pts", "def_pts")), F.count("*").alias("rows")).where("rows > 0")

    def rating(pts: str, poss: str):
        return F.when(F.col(poss) > 0, F.col(pts) / F.col(poss) * 100).otherwise(F.lit(0.0))

    total = sums.withColumns({"off_ppp": rating("off_pts", "off_poss"), "def_ppp": rating("def_pts", "def_poss")})
    total = total.withColumns({"is_total": F.lit(0), "team": F.lit(TOTAL), "players": F.lit(ALL_LINEUPS), "total_poss": F.coalesce("off_poss", F.lit(0)) + F.coalesce("def_poss", F.lit(0)), "plus_minus": F.coalesce("off_pts", F.lit(0)) - F.coalesce("def_pts", F.lit(0)), "net_rtg": F.col("off_ppp") - F.col("def_ppp"), "num_lineup": F.lit(None).cast("short"), "sub_lineup_hash": F.lit(TOTAL)})
    columns = ["is_total", *report.columns]
    return total.select(columns).unionByName(report.withColumn("is_total", F.lit(1)).select(columns)).orderBy("is_total", F.desc("total_poss"), "sub_lineup_hash")


def with_percentiles(report: DataFrame, by: Sequence[str] = ("is_total",)) -> DataFrame:
    """Percentiles of the ratings among lineups, fewer points allowed being better; none for the total row."""
    data = F.col("is_total") == 1
    pr = {c: F.when(data, average_rank_percentile(F.when(data, F.col(c)), list(by))) for c in ("net_rtg", "off_ppp", "def_ppp")}
    return report.withColumns({"pr_ld_net": pr["net_rtg"], "pr_ld_off_ppp": pr["off_ppp"], "pr_ld_def_ppp_i": 1 - pr["def_ppp"]})


def onoff_report(rows: DataFrame) -> DataFrame:
    """The on/off table under its titles, best net difference first."""
    named = rows.withColumn("player", F.concat_ws(" ", "firstname", "lastname")).orderBy(F.col("net_rtg_diff").desc_nulls_first(), "team_name", "lastname", "firstname")
    return named.select(*(F.col(c).alias(t) for c, t in TITLES.items()))
