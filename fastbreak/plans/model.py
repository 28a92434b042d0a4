"""The tables in the order of their dependencies. Each is built once, lazily; a materialised model reads them from Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import advanced, clean, facts, groups, lineups, onoff, possessions, ratings, stints
from ..operators.filters import GameFilter, season_bounds
from ..operators.groups import LineupParams
from ..operators.onoff import OnOffParams
from ..sources import fixture

#: In dependency order.
TABLES = ("actions", "rosters", "schedule", "team_dict", "possessions", "lookup", "stints", "stamped", "long", "games", "cube", "totals", "ratings", "members", "subs", "stats", "onoff_default", "advanced")

#: What each table is made from.
PARENTS = {
    "subs_events": ("actions",), "possessions": ("actions",), "lookup": ("rosters", "subs_events"), "stints": ("possessions", "lookup"), "stamped": ("possessions", "stints"), "long": ("stamped",),
    "sched_long": ("schedule", "team_dict"), "games": ("schedule", "team_dict"), "cube": ("long", "schedule"), "totals": ("cube",), "ratings": ("cube", "rosters"), "members": ("lookup",), "subs": ("members",),
    "stats": ("cube", "subs", "members", "rosters"), "onoff_default": ("cube", "lookup", "rosters", "games"), "advanced": ("long", "lookup", "rosters", "schedule"),
}


class Model:
    """Every table as an attribute, from base tables that a source gives."""

    def __init__(self, spark: SparkSession, excluded: Iterable[int] = (), min_on: int = onoff.MIN_ON, min_all: int = onoff.MIN_ALL) -> None:
        self.spark, self.excluded, self.min_on, self.min_all = spark, list(excluded), min_on, min_all

    def season(self, game_year: int) -> tuple[date, date]:
        """First and last day."""
        return season_bounds(game_year)

    def view(self, name: str) -> None:
        """Register a table as a temporary view."""
        getattr(self, name).createOrReplaceTempView(name)

    @cached_property
    def subs_events(self) -> DataFrame:
        return clean.substitutions(self.actions)

    @cached_property
    def possessions(self) -> DataFrame:
        return possessions.possession_ends(self.actions)

    @cached_property
    def lookup(self) -> DataFrame:
        return lineups.lineups_lookup(self.rosters, self.subs_events)

    @cached_property
    def stints(self) -> DataFrame:
        return stints.stints(self.possessions, self.lookup)

    @cached_property
    def stamped(self) -> DataFrame:
        return stints.stamp(self.possessions, self.stints)

    @cached_property
    def long(self) -> DataFrame:
        return facts.events_long(self.stamped, self.excluded)

    @cached_property
    def sched_long(self) -> DataFrame:
        return facts.sched_long(self.schedule, self.team_dict)

    @cached_property
    def games(self) -> DataFrame:
        return facts.final_schedule(self.sched_long)

    @cached_property
    def cube(self) -> DataFrame:
        return facts.lineup_cube(self.long, self.schedule)

    @cached_property
    def totals(self) -> DataFrame:
        return facts.lineup_totals_by_day(self.cube)

    @cached_property
    def ratings(self) -> DataFrame:
        return ratings.team_ppp_ratings(self.cube, self.rosters)

    @cached_property
    def members(self) -> DataFrame:
        return lineups.on_court_members(self.lookup)

    @cached_property
    def subs(self) -> DataFrame:
        return lineups.sub_lineups(self.members)

    @cached_property
    def stats(self) -> DataFrame:
        return groups.sub_lineups_stats(self.cube, self.subs, self.members, self.rosters)

    @cached_property
    def onoff_default(self) -> DataFrame:
        return onoff.onoff_default(self.cube, self.lookup, self.rosters, self.games, self.min_on)

    @cached_property
    def advanced(self) -> DataFrame:
        return advanced.player_advanced_stats(self.long, self.lookup, self.rosters, self.schedule)

    def onoff(self, p: OnOffParams) -> DataFrame:
        return onoff.onoff(self.onoff_default, self.onoff_computed, p, self.season, self.min_all, self.min_on)

    def onoff_computed(self, p: OnOffParams) -> DataFrame:
        return onoff.onoff_compute(self.cube, self.lookup, self.rosters, self.games, p)

    def team_ratings(self, f: GameFilter) -> DataFrame:
        """The season's ratings if only season and teams are given."""
        if not f.is_default:
            return ratings.team_ratings_dynamic(self.cube, self.games, self.ratings, self.rosters, f)
        rows = self.ratings if f.game_year is None else self.ratings.where(self.ratings["game_year"] == f.game_year)
        return rows if f.team_ids is None else rows.where(rows["team_id"].isin(list(f.team_ids)))

    def lineups(self, p: LineupParams) -> DataFrame:
        return groups.fetch_lineups(self.totals, self.subs, self.members, self.stats, self.games, self.ratings, p)

    def materialise(self, path: str, names: Iterable[str] = TABLES) -> Model:
        """Write the tables in order and read each from its file from then on."""
        for name in names:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
            self.__dict__[name] = self.spark.read.parquet(f"{path}/{name}")
        return self

    def keep(self, names: Iterable[str]) -> Model:
        """Cache tables; nothing is computed before they are read. A lost executor's part is computed again."""
        for name in names:
            self.__dict__[name] = getattr(self, name).cache()
        return self

    def forget(self) -> None:
        """Free what keep() holds, if its session is still there."""
        for name in TABLES:
            table = self.__dict__.get(name)
            if table is not None and table.sparkSession.sparkContext._jsc is not None:
                table.unpersist()

    def load(self, path: str, names: Iterable[str] = TABLES) -> Model:
        """Read tables that materialise() has written."""
        for name in names:
            self.__dict__[name] = self.spark.read.parquet(f"{path}/{name}")
        return self


class FixtureModel(Model):
    """From the driver's events."""

    def __init__(self, spark: SparkSession, sf_dir: str, min_on: int = onoff.MIN_ON, min_all: int = onoff.MIN_ALL) -> None:
        super().__init__(spark, fixture.EXCLUDED, min_on, min_all)
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")

    def season(self, game_year: int) -> tuple[date, date]:
        return fixture.season(game_year)

    @cached_property
    def actions(self) -> DataFrame:
        return clean.clean_actions(fixture.raw_actions(self.events))

    @cached_property
    def rosters(self) -> DataFrame:
        return fixture.rosters(self.events)

    @cached_property
    def schedule(self) -> DataFrame:
        return fixture.schedule(self.events, self.actions)

    @cached_property
    def team_dict(self) -> DataFrame:
        return fixture.team_dict(self.spark)
