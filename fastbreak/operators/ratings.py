"""Team ratings with ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded_ratio
from ..functions.windows import dense_rank
from .filters import GameFilter, filter_by_opponent_rank, filter_games


def _rated(sums: DataFrame, rosters: DataFrame) -> DataFrame:
    """Ratings and ranks from points and possessions of (game_year, team_id, type_lineup)."""

    def side(kind: str, column: str):
        return F.max(F.when(F.col("type_lineup") == kind, F.col(column)))

    wide = sums.groupBy("game_year", "team_id").agg(*(side(k, c).alias(f"{k[:3]}_{c}") for k in ("offense", "defense") for c in ("pts", "poss")))
    op, oq, dp, dq = (F.col(c).cast("bigint") for c in ("off_pts", "off_poss", "def_pts", "def_poss"))
    scores = wide.withColumns({"o": rounded_ratio(op, oq, 1000), "d": rounded_ratio(dp, dq, 1000), "n": rounded_ratio(op * dq - dp * oq, oq * dq, 1000)})
    names = rosters.select("game_year", "team_id", "team_name").distinct()
    named = scores.join(names, ["game_year", "team_id"]).select("game_year", "team_id", "team_name", (F.col("o") / 10).alias("off_ppp"), (F.col("d") / 10).alias("def_ppp"), (F.col("n") / 10).alias("net_rtg"))
    return named.withColumns({
        "rank_net_rtg": dense_rank(["game_year"], F.col("net_rtg").desc_nulls_last()).cast("long"),
        "rank_off_ppp": dense_rank(["game_year"], F.col("off_ppp").desc_nulls_last()).cast("long"),
        "rank_def_ppp": dense_rank(["game_year"], F.col("def_ppp").asc_nulls_last()).cast("long"),
    })


def _sums(cube: DataFrame) -> DataFrame:
    return cube.groupBy("game_year", "team_id", "type_lineup").agg(F.sum("pts").alias("pts"), F.sum("poss").alias("poss"))


def team_ppp_ratings(cube: DataFrame, rosters: DataFrame) -> DataFrame:
    """Season ratings: points per 100 possessions scored and allowed, their difference, and ranks."""
    return _rated(_sums(cube), rosters)


def team_ratings_dynamic(cube: DataFrame, games: DataFrame, ratings: DataFrame, rosters: DataFrame, f: GameFilter) -> DataFrame:
    """The same over the games that pass the filter. games: the final schedule; ratings: the season's."""
    kept = filter_by_opponent_rank(filter_games(games, f), ratings, f).select("game_id", "team_id").distinct()
    return _rated(_sums(cube.join(kept, ["game_id", "team_id"], "left_semi")), rosters)
