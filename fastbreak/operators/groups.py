"""Results of groups of two to five players."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import contains_all, overlaps, parse_csv_ids, same_set, settle_choice
from ..functions.rounding import rounded_ratio, tenths
from .facts import ended
from .filters import GameFilter, filter_by_opponent_rank, filter_games
from .lineups import full_lineups

COLUMNS = ("team_id", "sub_lineup_hash", "num_lineup", "player_ids", "player_names", "player_names_str", "off_poss", "off_pts", "off_ppp", "def_poss", "def_pts", "def_ppp", "net_rtg", "game_year")


@dataclass(frozen=True)
class LineupParams:
    """players: in the group (exactly those, or with exact=False at least those); without: not in it."""

    size: int = 5
    players: Sequence[int] | None = None
    without: Sequence[int] | None = None
    exact: bool = False
    min_poss: int = 0
    games: GameFilter = GameFilter()

    @classmethod
    def chosen(cls, size: int, on: Sequence[int], off: Sequence[int], changed: str, **more) -> LineupParams:
        """From the lists of players on and off court of which the one named was changed last: it keeps who is in both."""
        on, off = settle_choice(list(on), list(off), changed)
        return cls(size, on or None, off or None, **more)

    @classmethod
    def from_csv(cls, size: int, teams: str | None = None, players: str | None = None, without: str | None = None, exact: bool = False, min_poss: int = 0, game_types: str | None = None, opponents: str | None = None, **games) -> LineupParams:
        """The same from comma-separated ids."""
        return cls(size, parse_csv_ids(players), parse_csv_ids(without), exact, min_poss, GameFilter(team_ids=parse_csv_ids(teams), game_types=parse_csv_ids(game_types), opponents=parse_csv_ids(opponents), **games))


def season_names(rosters: DataFrame) -> DataFrame:
    """One name for each player of a team and season."""
    name = F.min(F.concat(F.trim("firstname"), F.lit(" "), F.trim("lastname")))
    return rosters.groupBy("team_id", "player_id", "game_year").agg(name.alias("name"))


def group_names(groups: DataFrame, rosters: DataFrame) -> DataFrame:
    """Names of each group's players in the order of their ids; '#' and the id where there is none."""
    return _named(groups, season_names(rosters))


def _named(groups: DataFrame, names: DataFrame) -> DataFrame:
    keys = ["team_id", "sub_lineup_hash", "game_year"]
    each = groups.select(*keys, F.posexplode("player_ids").alias("ord", "player_id")).join(names, ["team_id", "player_id", "game_year"], "left")
    shown = F.coalesce("name", F.concat(F.lit("#"), F.col("player_id").cast("string")))
    listed = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", shown.alias("name")))).alias("l"))
    return listed.select(*keys, F.transform("l", lambda x: x["name"]).alias("player_names")).withColumn("player_names_str", F.array_join("player_names", ", "))


_IDENTITY = ("team_id", "sub_lineup_hash", "game_year")
_SUMS = ("off_poss", "off_pts", "def_poss", "def_pts")


def group_sums(mapped: DataFrame, cube: DataFrame) -> DataFrame:
    """Sums of groups (team_id, game_year, sub_lineup_hash, player_ids, num_lineup) over the lineups that contain them.

    Lineups are added up to a row each, both sides beside each other, before the groups meet them; a group whose
    lineups have no sums has zeros.
    """
    wide = cube.groupBy("lineup_hash", "game_year").agg(*_sides("poss", "pts"))
    rows = mapped.join(wide, ["lineup_hash", "game_year"], "left")
    return rows.groupBy(*_IDENTITY).agg(F.first("player_ids").alias("player_ids"), F.first("num_lineup").alias("num_lineup"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS))


def add_sums(old: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' groups with their sums added."""
    columns = [*_IDENTITY, "player_ids", "num_lineup", *_SUMS]
    both = old.select(*columns).unionByName(more.select(*columns))
    return both.groupBy(*_IDENTITY).agg(F.first("player_ids").alias("player_ids"), F.first("num_lineup").alias("num_lineup"), *(F.sum(c).alias(c) for c in _SUMS))


def rated_groups(sums: DataFrame, names: DataFrame) -> DataFrame:
    """Groups with names and points per 100 possessions; no points make a rating null."""
    out = sums.join(_named(sums, names), list(_IDENTITY))
    return out.withColumns({f"{k}_ppp": tenths(F.nullif(f"{k}_pts", F.lit(0)), F.col(f"{k}_poss")) / 10 for k in ("off", "def")})


def sub_lineups_stats(cube: DataFrame, subs: DataFrame, members: DataFrame, rosters: DataFrame) -> DataFrame:
    """Season totals of every group that any lineup contains."""
    columns = ["team_id", "lineup_hash", "game_year", "sub_lineup_hash", "player_ids", "num_lineup"]
    mapped = subs.select(*columns).unionByName(full_lineups(members).select(*columns))
    return rated_groups(group_sums(mapped, cube), season_names(rosters))


def _sides(poss: str, pts: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("type_lineup") == kind, F.col(c))), F.lit(0)).alias(f"{kind[:3]}_{name}") for kind in ("offense", "defense") for name, c in (("poss", poss), ("pts", pts))]


def _players_match(p: LineupParams) -> Column | None:
    if p.players is None:
        return None
    ids = sorted(set(p.players))
    # Sizes 2-4 count the ids as given, size 5 the distinct ones.
    given = len(ids) if p.size == 5 else len(p.players)
    if not p.exact or given < p.size:
        return contains_all(F.col("player_ids"), ids)
    return same_set(F.col("player_ids"), ids) if given == p.size else F.lit(False)


def _chosen(groups: DataFrame, p: LineupParams) -> DataFrame:
    groups = groups.where(F.col("num_lineup") == p.size)
    if p.games.team_ids is not None:
        groups = groups.where(F.col("team_id").isin(list(p.games.team_ids)))
    if p.games.game_year is not None:
        groups = groups.where(F.col("game_year") == p.games.game_year)
    if (match := _players_match(p)) is not None:
        groups = groups.where(match)
    return groups.where(~overlaps(F.col("player_ids"), p.without)) if p.without else groups


def precomputed_lineups(stats: DataFrame, p: LineupParams) -> DataFrame:
    """From season totals; the net rating is of rounded values."""
    rows = _chosen(stats, p).where(F.coalesce("off_poss", F.lit(0)) + F.coalesce("def_poss", F.lit(0)) >= p.min_poss)
    net = (F.rint(F.col("off_ppp") * 10) - F.rint(F.col("def_ppp") * 10)) / 10
    return rows.withColumn("net_rtg", net).select(*COLUMNS)


def filtered_lineups(totals: DataFrame, subs: DataFrame, members: DataFrame, stats: DataFrame, games: DataFrame, ratings: DataFrame, p: LineupParams) -> DataFrame:
    """From totals by game of the games that pass; the net rating is rounded once. No points make a rating null."""
    f = p.games
    kept = filter_by_opponent_rank(filter_games(games, GameFilter(**{**f.__dict__, "team_ids": None})), ratings, f).select("game_id", "team_id").distinct()
    groups = _chosen(full_lineups(members) if p.size == 5 else subs, p).select("team_id", "game_year", "sub_lineup_hash", "player_ids", "num_lineup", "lineup_hash")
    sums = totals.join(kept, ["game_id", "team_id"])
    if f.game_year is not None:
        sums = sums.where(F.col("game_year") == f.game_year)
    sums = sums.groupBy("team_id", "game_year", "lineup_hash", "type_lineup").agg(F.sum("total_poss").alias("poss"), F.sum("total_pts").alias("pts"))
    rows = groups.join(sums, ["team_id", "game_year", "lineup_hash"]).groupBy("team_id", "sub_lineup_hash", "num_lineup", "player_ids", "game_year").agg(*_sides("poss", "pts"))
    rows = rows.where(F.col("off_poss") + F.col("def_poss") >= p.min_poss)
    op, oq, dp, dq = F.nullif("off_pts", F.lit(0)), F.col("off_poss"), F.nullif("def_pts", F.lit(0)), F.col("def_poss")
    rows = rows.withColumns({"off_ppp": tenths(op, oq) / 10, "def_ppp": tenths(dp, dq) / 10, "net_rtg": rounded_ratio(op * dq - dp * oq, oq * dq, 1000) / 10})
    names = stats.select("team_id", "sub_lineup_hash", "game_year", "player_names", "player_names_str")
    return rows.join(names, ["team_id", "sub_lineup_hash", "game_year"], "left").select(*COLUMNS)


def fetch_lineups(totals: DataFrame, subs: DataFrame, members: DataFrame, stats: DataFrame, games: DataFrame, ratings: DataFrame, p: LineupParams) -> DataFrame:
    """From the precomputed totals unless games are filtered."""
    return precomputed_lineups(stats, p) if p.games.is_default else filtered_lineups(totals, subs, members, stats, games, ratings, p)
