"""On/off impact: a team's points per 100 possessions with each player on and off court."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded_ratio, tenths
from ..functions.windows import percent_rank
from .filters import GameFilter, filter_games, season_bounds

#: Possessions that a player needs in all four sums, and on court.
MIN_ALL, MIN_ON = 100, 300

COLUMNS = (
    "team_name", "firstname", "lastname", "net_rtg_diff", "off_on_diff", "def_on_diff", "off_on_ppp", "def_on_ppp", "on_net_rtg", "off_off_ppp", "def_off_ppp", "off_net_rtg", "on_poss", "off_poss",
    "pr_net", "pr_off_on", "pr_off_off", "pr_def_on_inv", "pr_def_off_inv", "pr_off_on_d", "pr_def_on_d", "pr_def_on_d_inv", "pr_on_net", "pr_off_net", "player_id", "team_id", "game_year",
)


@dataclass(frozen=True)
class OnOffParams:
    """games: which games count. Players need min_all possessions on each side and state, min_on on court, and min_net of net difference."""

    games: GameFilter = GameFilter()
    min_all: int = 0
    min_on: int = MIN_ON
    min_net: float | None = None


def _states(lookup: DataFrame) -> DataFrame:
    return lookup.select("player_id", "team_id", "lineup_hash", F.coalesce("is_on_verdict", F.lit(0)).alias("is_on")).where("lineup_hash is not null").distinct()


def player_sums(cube: DataFrame, lookup: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """Points and possessions of (player, team, on/off, side, season); with games, of those (game_id, team_id).

    Sums are additive: whole seasons are added up by lineup before about twelve players join each lineup.
    """
    if games is None:
        by_season = cube.groupBy("lineup_hash", "type_lineup", "game_year").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))
        rows = _states(lookup).join(by_season, "lineup_hash")
    else:
        # The players' team is the one whose game it is.
        kept = games.select("game_id", F.col("team_id").alias("of"), "game_year").distinct()
        by_season = cube.drop("game_year").join(kept, "game_id").groupBy("lineup_hash", "type_lineup", "of", "game_year").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))
        states = _states(lookup)
        rows = states.join(by_season, (states["lineup_hash"] == by_season["lineup_hash"]) & (states["team_id"] == by_season["of"]))
    return rows.groupBy("player_id", "team_id", "is_on", "type_lineup", "game_year").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))


def player_names(rosters: DataFrame, games: DataFrame) -> DataFrame:
    season = games.select("game_id", "team_id", "game_year").distinct()
    return rosters.drop("game_year").join(season, ["game_id", "team_id"]).select("player_id", "team_id", "firstname", "lastname", "team_name", "game_year").distinct()


def _core(sums: DataFrame, names: DataFrame, min_all: int | None, min_on: int | None) -> DataFrame:
    """One row per (player, team, season), from rounded values; tenths are whole numbers until the end."""
    who = ["player_id", "team_id", "game_year"]
    ppp = sums.withColumn("ppp", tenths(F.col("pts"), F.col("poss")))
    raw = percent_rank(F.col("ppp"), ["type_lineup", "game_year"])
    rows = ppp.withColumn("pr", F.when(F.col("type_lineup") == "defense", 1 - raw).otherwise(raw)).join(names, who)

    def pick(kind: str, on: int, column: str):
        return F.max(F.when((F.col("type_lineup") == kind) & (F.col("is_on") == on), F.col(column)))

    cells = {f"{k[:3]}_{s}_{c}": pick(k, on, c) for k in ("offense", "defense") for s, on in (("on", 1), ("off", 0)) for c in ("ppp", "pr")}
    wide = rows.groupBy(*who, "firstname", "lastname", "team_name").agg(
        *(v.alias(k) for k, v in cells.items()), F.min("poss").alias("min_poss_all"),
        F.max(F.when(F.col("is_on") == 1, F.col("poss"))).alias("on_poss"), F.max(F.when(F.col("is_on") == 0, F.col("poss"))).alias("off_poss"),
    )
    if min_all is not None:
        wide = wide.where((F.col("min_poss_all") >= min_all) & (F.coalesce("on_poss", F.lit(0)) >= (min_on or 0)))
    wide = wide.withColumns({"o": F.col("off_on_ppp") - F.col("off_off_ppp"), "d": F.col("def_on_ppp") - F.col("def_off_ppp"), "on_net": F.col("off_on_ppp") - F.col("def_on_ppp"), "off_net": F.col("off_off_ppp") - F.col("def_off_ppp")})
    wide = wide.withColumn("total", F.col("o") - F.col("d"))

    def among(column: str):
        """Percentile among the rows that have a value."""
        return F.when(F.col(column).isNotNull(), percent_rank(F.col(column), ["game_year", F.col(column).isNotNull()]))

    wide = wide.withColumns({"pr_off_on_d": among("o"), "pr_def_on_d": among("d"), "pr_net": among("total"), "pr_on_net": percent_rank(F.col("on_net"), ["game_year"]), "pr_off_net": percent_rank(F.col("off_net"), ["game_year"])})
    shown = {"net_rtg_diff": "total", "off_on_diff": "o", "def_on_diff": "d", "off_on_ppp": "off_on_ppp", "def_on_ppp": "def_on_ppp", "on_net_rtg": "on_net", "off_off_ppp": "off_off_ppp", "def_off_ppp": "def_off_ppp", "off_net_rtg": "off_net"}
    prs = {"pr_off_on": "off_on_pr", "pr_off_off": "off_off_pr", "pr_def_on_inv": "def_on_pr", "pr_def_off_inv": "def_off_pr"}
    out = wide.select("team_name", "firstname", "lastname", *((F.col(v) / 10).alias(k) for k, v in shown.items()), "on_poss", "off_poss", "pr_net", *(F.col(v).alias(k) for k, v in prs.items()), "pr_off_on_d", "pr_def_on_d", (1 - F.col("pr_def_on_d")).alias("pr_def_on_d_inv"), "pr_on_net", "pr_off_net", *who)
    return out.select(*COLUMNS)


def onoff_default(cube: DataFrame, lookup: DataFrame, rosters: DataFrame, games: DataFrame, min_on: int = MIN_ON) -> DataFrame:
    """Whole seasons, players with min_on possessions on court; percentiles are among all players."""
    rows = _core(player_sums(cube, lookup), player_names(rosters, games), None, None)
    return rows.where(F.col("on_poss") >= min_on)


def opponent_top_bottom(cube: DataFrame, games: DataFrame, f: GameFilter) -> DataFrame:
    """team_id of the top or bottom teams by their average of per-game ratings within the dates, season and game types.

    Ties at the cut go to the smaller team_id.
    """
    window = filter_games(games, GameFilter(game_year=f.game_year, start=f.start, end=f.end, game_types=f.game_types)).select("game_id").distinct()
    sums = cube.join(window, "game_id", "left_semi").groupBy("game_id", "team_id", "type_lineup").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))
    ppp = sums.withColumn("ppp", rounded_ratio(F.col("pts"), F.col("poss"), 10000))
    by_game = ppp.groupBy("game_id", "team_id").agg(*(F.max(F.when(F.col("type_lineup") == k, F.col("ppp"))).alias(k) for k in ("offense", "defense")))
    by_game = by_game.withColumn("net", F.col("offense") - F.col("defense"))
    mean = by_game.groupBy("team_id").agg(*(rounded_ratio(F.sum(c), F.count(c), 1).alias(c) for c in ("offense", "defense", "net")))
    metric = {"off": F.col("offense"), "def": -F.col("defense")}.get(f.opp_rank_metric or "", F.col("net"))
    n = max(0, f.opp_rank_n or 0)
    order = metric.asc_nulls_last() if f.opp_rank_side == "bottom" else metric.desc_nulls_last()
    return mean.orderBy(order, "team_id").limit(n).select("team_id")


def onoff_compute(cube: DataFrame, lookup: DataFrame, rosters: DataFrame, games: DataFrame, p: OnOffParams) -> DataFrame:
    """On/off impact over the games that pass. Both dates are needed: without one there is no game."""
    f = p.games
    kept = filter_games(games, f) if f.start and f.end else games.where(F.lit(False))
    if f.opp_rank_side is not None and f.opp_rank_n is not None and f.opp_rank_metric is not None:
        kept = kept.join(opponent_top_bottom(cube, games, f).withColumnRenamed("team_id", "opp_team_id"), "opp_team_id", "left_semi")
    rows = _core(player_sums(cube, lookup, kept), player_names(rosters, games), p.min_all, p.min_on)
    rows = rows.where(F.col("net_rtg_diff").isNotNull())
    return rows if p.min_net is None else rows.where(F.col("net_rtg_diff") >= p.min_net)


def onoff(default: DataFrame, compute, p: OnOffParams, bounds=season_bounds, min_all: int = MIN_ALL, min_on: int = MIN_ON) -> DataFrame:
    """The precomputed season if nothing but the season is chosen, else what the given function computes.

    Chosen is a team, a threshold other than the defaults, a date other than the season's bounds (or none), or any
    other filter: percentiles are among the rows of an answer, so a precomputed one can't be cut down to such a choice.
    """
    f = p.games
    whole = f.game_year is not None and (f.start, f.end) == tuple(bounds(f.game_year))
    plain = replace(f, start=None, end=None, team_ids=None).is_default and not f.team_ids and f.opp_rank_side is None and f.opp_rank_n is None
    if whole and plain and p.min_all == min_all and p.min_on == min_on and p.min_net is None:
        return default.where(F.col("game_year") == f.game_year)
    return compute(p)
