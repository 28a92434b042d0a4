"""Which of a team's games count: filters on the team-long schedule, and opponents by strength."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month and day of a season's first and last day, in the year before and in the year that it is named by.
SEASON_MONTHS = ((10, 1), (7, 1))


def season_bounds(game_year: int) -> tuple[date, date]:
    """First and last day of a season."""
    (m1, d1), (m2, d2) = SEASON_MONTHS
    return date(game_year - 1, m1, d1), date(game_year, m2, d2)


@dataclass(frozen=True)
class GameFilter:
    """None or "all" means: no filter. opp_rank_side is "top" or "bottom", with opp_rank_n; opp_rank_metric "off", "def" or "net"."""

    game_year: int | None = None
    start: date | None = None
    end: date | None = None
    team_ids: Sequence[int] | None = None
    game_types: Sequence[int] | None = None
    opponents: Sequence[int] | None = None
    home_away: str = "all"
    outcome: str = "all"
    opp_rank_side: str | None = None
    opp_rank_n: int | None = None
    opp_rank_metric: str | None = "net"

    @property
    def ranks_opponents(self) -> bool:
        return self.opp_rank_side in ("top", "bottom") and self.opp_rank_n is not None

    @property
    def is_default(self) -> bool:
        """Nothing is filtered but the season and the team."""
        return not (self.start or self.end or self.game_types or self.opponents or self.ranks_opponents) and (self.home_away or "all") == "all" and (self.outcome or "all") == "all"


def _in(column: str, values: Sequence[int] | None) -> Column | None:
    return F.col(column).isin(list(values)) if values is not None else None


def filter_games(games: DataFrame, f: GameFilter) -> DataFrame:
    """The final schedule's rows that pass; only the given filters become predicates, so they reach the scan."""
    tests = [
        F.col("game_year") == int(f.game_year) if f.game_year is not None else None,
        F.col("game_date") >= f.start if f.start else None,
        F.col("game_date") <= f.end if f.end else None,
        _in("team_id", f.team_ids),
        _in("game_type", f.game_types),
        _in("opp_team_id", f.opponents),
        {"home": F.col("is_home").eqNullSafe(F.lit(True)), "away": F.col("is_home").eqNullSafe(F.lit(False))}.get(f.home_away),
        {"win": F.col("has_won").eqNullSafe(F.lit(True)), "loss": F.col("has_won").eqNullSafe(F.lit(False))}.get(f.outcome),
    ]
    for test in tests:
        if test is not None:
            games = games.where(test)
    return games


def filter_by_opponent_rank(games: DataFrame, ratings: DataFrame, f: GameFilter) -> DataFrame:
    """Games against the season's top or bottom opponents; the bottom is counted from the worst rank among the games' opponents."""
    if not f.ranks_opponents:
        return games
    rank = {"off": "rank_off_ppp", "def": "rank_def_ppp"}.get(f.opp_rank_metric or "net", "rank_net_rtg")
    ranked = games.join(ratings.select("game_year", F.col("team_id").alias("opp_team_id"), F.col(rank).alias("opp_rank")), ["game_year", "opp_team_id"], "left")
    if f.opp_rank_side == "top":
        return ranked.where(F.col("opp_rank") <= f.opp_rank_n).select(games.columns)
    worst = F.max("opp_rank").over(Window.partitionBy("game_year"))
    return ranked.withColumn("worst", worst).where(F.col("opp_rank") >= F.col("worst") - f.opp_rank_n + 1).select(games.columns)
