"""Loading of games into versioned tables, and what follows from the games that are new.

A load commits everything that it changes as one version of a store. Tables of games get the rows of the new ones;
members, groups, names and group totals are kept by season and team, and only the parts that the new games touch are
read and written again. What can't be added up (ratings, on/off, advanced rates) is computed again from the tables if
one of those that it is made from has changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, facts, groups, lineups
from ..sources.feeds import games_to_load
from ..sources.store import Change, Store
from .model import PARENTS, Model

#: Tables that have rows of single games only, in the order in which they are made.
GAME_TABLES = ("schedule", "actions", "rosters", "subs_events", "possessions", "lookup", "stints", "stamped", "long", "cube")
#: Tables that are kept by season and team.
TEAM_TABLES = ("members", "subs", "names", "stats")
BY = ("game_year", "team_id")
#: Tables that are computed again, from those above, when one of their parents has changed.
SNAPSHOTS = ("games", "ratings", "onoff_default", "advanced")


class Games(Model):
    """The tables of some games only, from another model's base tables."""

    def __init__(self, source: Model, games: DataFrame) -> None:
        super().__init__(source.spark, source.excluded, source.min_on, source.min_all)
        self._source, self._games = source, games.select("game_id")
        self.team_dict = source.team_dict

    def _of(self, table: DataFrame) -> DataFrame:
        return table.join(F.broadcast(self._games) if self._few else self._games, "game_id", "left_semi")

    @cached_property
    def _few(self) -> bool:
        """Whether the games' ids are few enough to be sent to every task; a season has hundreds."""
        return self._games.limit(100_001).count() <= 100_000

    @cached_property
    def actions(self) -> DataFrame:
        return self._of(self._source.actions)

    @cached_property
    def rosters(self) -> DataFrame:
        return self._of(self._source.rosters)

    @cached_property
    def schedule(self) -> DataFrame:
        return self._of(self._source.schedule)


class Stored(Model):
    """The tables of one version of a store (of the latest one, unless it is given)."""

    def __init__(self, store: Store, excluded: Iterable[int] = (), version: int | None = None, **limits: int) -> None:
        super().__init__(store.spark, excluded, **limits)
        manifest = store.manifest(version)
        self.version = manifest["version"]
        self.__dict__ |= {name: store._read(entry) for name, entry in manifest["tables"].items()}


def load_games(store: Store, source: Model, game_ids: Iterable[int] | None = None, made: Iterable[str] = SNAPSHOTS) -> int | None:
    """Load the games of the source's schedule that the store doesn't have, or the given ones, those that it has anew.

    Everything is one version, which is returned; without a game to load it is the one that there was. made: the snapshots that are kept in it.
    """
    change = store.change()
    loaded = change.read("schedule") if change.has("schedule") else source.schedule.limit(0)
    batch = change.replace("batch", games_to_load(source.schedule, loaded, game_ids).select("game_id").distinct())
    if batch.isEmpty():
        return change.base
    again = None
    if game_ids is not None and change.has("schedule"):
        known = loaded.join(batch, "game_id", "left_semi").select("game_id", "game_year")
        if not known.isEmpty():
            # What the games had before counts as touched too.
            again = _parts(change.read("rosters").join(batch, "game_id", "left_semi"))
            for name in GAME_TABLES:
                change.without(name, batch, ["game_id"])
    new = Games(source, batch)
    for name in GAME_TABLES:
        new.__dict__[name] = change.append(name, getattr(new, name))
    rows = fingerprint(source.team_dict)
    if not change.has("team_dict") or change.tables["team_dict"].get("rows") != rows:
        change.replace("team_dict", source.team_dict, rows=rows)
    if again is None:
        add_to_groups(change, new)
    else:
        rebuild_groups(change, sorted(set(again) | set(_parts(new.rosters))))
    snapshots(change, source, made)
    for name in (*GAME_TABLES, *TEAM_TABLES):
        change.compact(name)
    return change.commit()


def _parts(rows: DataFrame) -> list[tuple]:
    """Seasons and teams: as many as the store's folders at most."""
    return [tuple(r) for r in rows.select(*BY).distinct().collect()]


def add_to_groups(change: Change, new: Model) -> None:
    """Members, groups, names and group totals after games that were not there before.

    Sums of the new games are added to those that are there, in the parts that the new games touch.
    """
    touched = _parts(new.rosters)
    found = lineups.on_court_members(new.lookup)
    members = lineups.new_members(new.lookup, change.read("members", touched)) if change.has("members") else found
    added = change.append("members", members, BY)
    # A lineup's hash is of its players: one that is new has all of its members among those added.
    change.append("subs", lineups.sub_lineups(added), BY)
    _merge_names(change, new.rosters, touched)
    _add_totals(change, new, added, touched)


def _merge_names(change: Change, rosters: DataFrame, parts: Sequence[tuple]) -> None:
    names = groups.season_names(rosters)
    if change.has("names"):
        names = change.read("names", parts).unionByName(names).groupBy("team_id", "player_id", "game_year").agg(F.min("name").alias("name"))
    change.replace("names", names, BY, parts)


def _mapped(change: Change, parts: Sequence[tuple], lineups_of: DataFrame | None) -> DataFrame:
    """Each group with the lineups that contain it, of the touched parts; of some lineups only, if given."""
    subs, members = change.read("subs", parts), change.read("members", parts)
    if lineups_of is not None:
        keys = ["lineup_hash", "game_year"]
        subs, members = subs.join(lineups_of, keys, "left_semi"), members.join(lineups_of, keys, "left_semi")
    columns = ["team_id", "lineup_hash", "game_year", "sub_lineup_hash", "player_ids", "num_lineup"]
    return subs.select(*columns).unionByName(lineups.full_lineups(members).select(*columns))


def _add_totals(change: Change, new: Model, added: DataFrame, parts: Sequence[tuple]) -> None:
    """The new games' sums by lineup reach the groups in these lineups and are added to their totals."""
    played = new.cube.select("lineup_hash", "game_year").distinct()
    parts = _sharing(change, played, parts)
    mapped = _mapped(change, parts, added.select("lineup_hash", "game_year").union(played).distinct())
    delta = groups.group_sums(mapped, new.cube)
    old = change.read("stats", parts) if change.has("stats") else None
    whole = delta if old is None else groups.add_sums(old, delta)
    change.replace("stats", groups.rated_groups(whole, change.read("names", parts)), BY, parts)


def _sharing(change: Change, played: DataFrame, parts: Sequence[tuple]) -> list[tuple]:
    """The parts, and those of other teams that have one of these lineups: players may have changed their team."""
    return sorted(set(parts) | set(_parts(change.read("members").join(played, ["lineup_hash", "game_year"], "left_semi"))))


def rebuild_groups(change: Change, parts: Sequence[tuple]) -> None:
    """The same parts, from the tables of games as they are now; a part without games goes."""
    chosen = reduce(lambda a, b: a | b, ((F.col("game_year") == y) & (F.col("team_id") == t) for y, t in parts))
    members = change.replace("members", lineups.on_court_members(change.read("lookup").where(chosen)), BY, parts)
    change.replace("subs", lineups.sub_lineups(members), BY, parts)
    change.replace("names", groups.season_names(change.read("rosters").where(chosen)), BY, parts)
    parts = _sharing(change, members.select("lineup_hash", "game_year").distinct(), parts)
    years = sorted({y for y, _ in parts})
    whole = groups.group_sums(_mapped(change, parts, None), change.read("cube").where(F.col("game_year").isin(years)))
    change.replace("stats", groups.rated_groups(whole, change.read("names", parts)), BY, parts)


def snapshots(change: Change, source: Model, names: Iterable[str] = SNAPSHOTS) -> list[str]:
    """Compute the tables whose parents have changed since they were made, in order; returns their names."""
    model = Model(source.spark, source.excluded, source.min_on, source.min_all)
    model.__dict__ |= {name: change.read(name) for name in change.tables}
    done = []
    for name in names:
        made_from = {p: change.changed(p) for p in PARENTS[name]}
        if change.has(name) and change.tables[name].get("made_from") == made_from:
            continue
        model.__dict__.pop(name, None)
        model.__dict__[name] = change.replace(name, getattr(model, name), made_from=made_from)
        done.append(name)
    return done


def fingerprint(rows: DataFrame) -> list[str]:
    """Number of rows and sum of their hashes, which tell whether a table is the same in any order."""
    count, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return [str(count), str(total)]


def refresh(store: Store, model: Model, names: Iterable[str]) -> list[str]:
    """Materialise a model's tables as one version, in order; only those that are new or whose parents have changed.

    Tables without parents are base tables: they are written if their rows are others than before. Returns the names
    of the tables that were written.
    """
    change, done = store.change(), []
    for name in names:
        if name in PARENTS:
            notes = {"made_from": {p: change.changed(p) for p in PARENTS[name]}}
            model.__dict__.pop(name, None)
        else:
            notes = {"rows": fingerprint(getattr(model, name))}
        if change.has(name) and all(change.tables[name].get(k) == v for k, v in notes.items()):
            model.__dict__[name] = change.read(name)
            continue
        model.__dict__[name] = change.replace(name, getattr(model, name), **notes)
        done.append(name)
    change.commit()
    return done
