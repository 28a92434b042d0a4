"""Jobs that keep written tables up to date: each merges or appends what is new and can be run again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineups
from ..schemas import KEYS
from ..sources.feeds import append, exists, latest_version, unseen, write_merged
from .model import Model


def refresh_group_stats(model: Model, path: str, seasons: Iterable[int] | None = None) -> DataFrame:
    """Compute the season totals of all groups (of some seasons only, if given) and merge them into the versioned
    table under path: totals that are there are replaced by their keys, others are added or stay. Returns the table."""
    stats = model.stats if seasons is None else model.stats.where(F.col("game_year").isin(list(seasons)))
    return model.spark.read.parquet(write_merged(model.spark, path, stats, KEYS["sub_lineups_stats"]))


def append_members(model: Model, path: str) -> DataFrame:
    """Append the players on court that the table under path does not have, and return the table.

    Run again after nothing was loaded, it appends nothing.
    """
    found = lineups.on_court_members(model.lookup)
    if exists(model.spark, path):
        found = unseen(found, model.spark.read.parquet(path), KEYS["lineups_lookup_on"])
    append(found, path)
    return model.spark.read.parquet(path)


def append_sub_lineups(model: Model, path: str) -> DataFrame:
    """Append the groups of lineups that the table under path does not have, with the time of the run; returns the table."""
    keys = ["team_id", "lineup_hash", "game_year"]
    found = model.subs
    if exists(model.spark, path):
        found = unseen(found, model.spark.read.parquet(path), keys)
    append(found.withColumn("created_at", F.current_timestamp()), path)
    return model.spark.read.parquet(path)


def latest(model: Model, path: str) -> DataFrame:
    """The newest version of a table that write_merged() keeps."""
    return model.spark.read.parquet(f"{path}/v={latest_version(model.spark, path)}")
