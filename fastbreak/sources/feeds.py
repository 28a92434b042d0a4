"""Landed JSON feeds, CSV export, and merging into tables that are written as Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from ..schemas import PLAY_BY_PLAY, SCHEDULE_FEED


#: Why a landed document can't be loaded.
BROKEN, NO_GAME, NO_TEAMS, NO_ACTIONS, TWICE = "not JSON of the feed", "no game id", "not two teams", "no actions", "another document has the game"


def read_checked(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Landed game documents (result) with file, text of those that can't be parsed, and reason: null for good ones.

    A document is damaged too if a value isn't of its type. Of several documents of one game the first by file and
    content is good.
    """
    reader = spark.read.schema(f"{PLAY_BY_PLAY}, damaged string").option("columnNameOfCorruptRecord", "damaged")
    rows = reader.json(paths, multiLine=not lines).withColumn("file", F.input_file_name())
    info = "result.gameInfo"
    fault = (
        F.when(F.col("damaged").isNotNull(), BROKEN).when(F.col(f"{info}.gameId").isNull(), NO_GAME)
        .when(F.col(f"{info}.homeTeam.id").isNull() | F.col(f"{info}.awayTeam.id").isNull(), NO_TEAMS)
        .when(F.coalesce(F.size("result.actions"), F.lit(0)) <= 0, NO_ACTIONS)
    )
    rows = rows.withColumn("fault", fault)
    nth = F.row_number().over(Window.partitionBy(F.col(f"{info}.gameId")).orderBy("file", F.xxhash64("result")))
    good = rows.where("fault is null").withColumn("fault", F.when(nth > 1, TWICE))
    return good.unionByName(rows.where("fault is not null")).withColumnRenamed("fault", "reason")


def quarantine(checked: DataFrame, path: str) -> DataFrame:
    """Append the documents that have a reason to the table under path, with the time; returns the good ones (result)."""
    bad = checked.where("reason is not null").select("file", "reason", F.coalesce("damaged", F.to_json("result")).alias("document"), F.current_timestamp().alias("at"))
    append(bad, path)
    return checked.where("reason is null").select("result")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """(reason, n) of what lies in quarantine."""
    return spark.read.parquet(path).groupBy("reason").agg(F.count("*").alias("n"))


def read_play_by_play(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """One row per landed game document: a file each, or with lines a line each, so that large files are split."""
    return spark.read.schema(PLAY_BY_PLAY).json(paths, multiLine=not lines)


def play_by_play_actions(documents: DataFrame) -> DataFrame:
    """One row per action, columns named as in the tables."""
    a = documents.select(F.col("result.gameInfo.gameId").alias("game_id"), F.explode("result.actions").alias("a"))
    plain = {"id": "id", "parentActionId": "parent_action_id", "teamId": "team_id", "playerId": "player_id", "type": "type", "quarter": "quarter", "quarterTime": "quarter_time", "userTime": "user_time"}
    nested = {"made": "made", "type": "type", "points": "points", "freeThrowNumber": "free_throw_number", "freeThrowsAwarded": "free_throws_awarded", "playerIn": "player_in", "playerOut": "player_out"}
    return a.select("game_id", *(F.col(f"a.{k}").alias(v) for k, v in plain.items()), *(F.col(f"a.parameters.{k}").alias(f"parameters_{v}") for k, v in nested.items()))


def read_schedule(spark: SparkSession, paths: str | list[str], season: str | None = None, competition: str | None = None, game_url: str = "", box_url: str = "", lines: bool = False) -> DataFrame:
    """Games that have been played (the first team has points), with typed ids and dates.

    game_url and box_url are put before the game's id. A date that is none is null.
    """
    g = spark.read.schema(SCHEDULE_FEED).json(paths, multiLine=not lines).select(F.explode("games").alias("g")).select("g.*").where("score_team1 > 0")
    out = g.withColumn("game_id", F.expr("try_cast(ExternalID as int)")).withColumn("game_date", F.expr("to_date(try_to_timestamp(game_date_txt, 'd/M/yyyy'))"))
    out = out.withColumn("pbp_url", F.concat(F.lit(game_url), "ExternalID")).withColumn("box_url", F.concat(F.lit(box_url), "ExternalID"))
    for name, value in (("season", season), ("competition", competition)):
        if value is not None:
            out = out.withColumn(name, F.lit(value))
    return out.drop("ExternalID", "game_date_txt")


def align(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The schema's columns in its order: missing ones null, others dropped."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def unseen(candidates: DataFrame, loaded: DataFrame, keys: list[str] | str = "game_id") -> DataFrame:
    """Rows whose keys are not loaded yet."""
    keys = [keys] if isinstance(keys, str) else keys
    return candidates.join(loaded.select(*keys).distinct(), keys, "left_anti")


def games_to_load(schedule: DataFrame, loaded: DataFrame, game_ids: Iterable[int] | None = None) -> DataFrame:
    """Schedule rows whose games are to be loaded: the given ones, loaded or not; without ids, those not loaded yet."""
    if game_ids is None:
        return unseen(schedule, loaded)
    return schedule.where(F.col("game_id").isin(sorted(set(game_ids))))


def merge_by_key(target: DataFrame, source: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The target with the source's rows in place of those with the same keys.

    With order, the first source row of each key counts; without, source keys must be unique (see duplicate_keys).
    """
    source = align(source, target.schema)
    if order is not None:
        source = source.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__row = 1").drop("__row")
    same = reduce(lambda a, b: a & b, (target[k].eqNullSafe(source[k]) for k in keys))
    return target.join(source, same, "left_anti").unionByName(source)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def write_merged(spark: SparkSession, path: str, source: DataFrame, keys: list[str], order: list | None = None) -> str:
    """Merge into the latest version under path, written as a new version; returns its path. Readers keep the old one.

    A version is there when its folder has the writer's success mark, so a failed job leaves the table as it was.
    """
    latest = latest_version(spark, path)
    target = spark.read.parquet(f"{path}/v={latest}") if latest is not None else source.limit(0)
    if order is None and duplicate_keys(source, keys).limit(1).count():
        raise ValueError(f"source keys {keys} are not unique")
    new = f"{path}/v={0 if latest is None else latest + 1}"
    merge_by_key(target, source, keys, order).write.parquet(new)
    return new


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished a table at path."""
    where, files = _folder(spark, path)
    return files.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS"))


def latest_version(spark: SparkSession, path: str) -> int | None:
    jvm = spark._jvm
    where, files = _folder(spark, path)
    if not files.exists(where):
        return None
    names = [s.getPath() for s in files.listStatus(where)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """With a header; nulls are empty fields."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
