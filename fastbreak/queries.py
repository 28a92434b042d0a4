"""Registered queries: one or more for each operator, over the whole of the driver's tables, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.ids import csv_ids_column
from .functions.windows import percent_rank, with_percent_rank
from .operators import clean, groups, lineups, onoff, possessions, report
from .operators.filters import GameFilter, filter_by_opponent_rank, filter_games, season_bounds
from .operators.groups import LineupParams
from .operators.onoff import OnOffParams
from .oracles import ENDED, STATES, core, half_up, lineup_filter, query, rated, sums
from .plans import jobs, sql
from .plans.load import Games, load_games, refresh
from .plans.model import FixtureModel
from .schemas import KEYS
from .sources import fixture
from .sources.feeds import BROKEN, NO_ACTIONS, NO_GAME, NO_TEAMS, TWICE, append, export_csv, quarantine, quarantined, read_checked, games_to_load, merge_by_key, play_by_play_actions, read_play_by_play, read_schedule, unseen, write_merged
from .sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = date(2024, 1, 3), date(2024, 1, 26)
WINDOW_SQL = f"game_date BETWEEN DATE '{START}' AND DATE '{END}'"


def register(name: str, text: str | None = None, last: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            ORACLE_SQL[name] = query(text, last) if last != "" else text
        return f

    return add


#: Tables that many others are made from; they are kept, as materialised views would be.
KEPT = ("actions", "rosters", "schedule", "possessions", "lookup", "stints", "stamped", "cube", "members", "subs", "stats")
_models: dict[tuple[str, str], FixtureModel] = {}


def model(spark: SparkSession, sf_dir: str) -> FixtureModel:
    """The tables of one folder. Those KEPT are cached until another folder or session is asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        for old in _models.values():
            old.forget()
        _models.clear()
        _models[key] = FixtureModel(spark, sf_dir, min_on=100, min_all=50).keep(KEPT)
    return _models[key]


def joined(column: str = "player_ids"):
    return F.array_join(column, "_").alias(column)


# ---------------------------------------------------------------- cleaning, possessions, lineups, stints

ACTION_COLUMNS = "game_id, id, parent_action_id, team_id, player_id, type, quarter, quarter_time, end_quarter_seconds_remaining, end_game_seconds_remaining, team_score"


@register("k02_actions_clean", f"SELECT {ACTION_COLUMNS}, made AS parameters_made, ptype AS parameters_type, points AS parameters_points FROM actions", "actions")
def _(spark, sf):
    return model(spark, sf).actions.select(*ACTION_COLUMNS.split(", "), "parameters_made", "parameters_type", "parameters_points")


@register("k03_rosters", "SELECT game_id, team_id, player_id, firstname, lastname, team_name, game_year FROM rosters")
def _(spark, sf):
    return model(spark, sf).rosters.drop("team_name_local")


def landed(spark: SparkSession, documents: DataFrame) -> str:
    """Documents as lines of JSON in a new folder."""
    path = scratch(spark, "landed")
    documents.write.json(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder: where checkpoints go if the session names a place, else (on one machine) a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='tables-')}/{name}"


@register("k01_schedule_feed", "SELECT game_id, game_date, gn, game_type, team1, team2, score_team1, score_team2, 'https://box/' || game_id AS box_url, '2024' AS season FROM schedule WHERE score_team1 > 0")
def _(spark, sf):
    """The schedule, landed as JSON and read again."""
    path = landed(spark, fixture.schedule_documents(model(spark, sf).schedule))
    return read_schedule(spark, path, season="2024", box_url="https://box/", lines=True).select("game_id", "game_date", "gn", "game_type", "team1", "team2", "score_team1", "score_team2", "box_url", "season")


@register("k02_landed_actions", f"SELECT {ACTION_COLUMNS}, made AS parameters_made, ptype AS parameters_type, points AS parameters_points FROM actions", "actions")
def _(spark, sf):
    """Play-by-play documents, landed as JSON, read and cleaned."""
    path = landed(spark, fixture.documents(model(spark, sf).events))
    return clean.clean_actions(play_by_play_actions(read_play_by_play(spark, path, lines=True))).select(*ACTION_COLUMNS.split(", "), "parameters_made", "parameters_type", "parameters_points")


def _damaged(spark: SparkSession, sf_dir: str) -> str:
    """All documents landed as lines: some cut off, some without a game's id, teams or actions, some twice, one no object."""
    documents = fixture.documents(model(spark, sf_dir).events).select("result", F.col("result.gameInfo.gameId").alias("g"))
    info = F.col("result.gameInfo")
    plain = F.to_json(F.struct("result"))
    text = (
        F.when(F.col("g") % 6 == 0, F.substring(plain, 1, 200))
        .when(F.col("g") % 6 == 1, F.to_json(F.struct(F.struct(info.dropFields("gameId").alias("gameInfo"), "result.actions").alias("result"))))
        .when(F.col("g") % 6 == 2, F.to_json(F.struct(F.struct(info.dropFields("awayTeam").alias("gameInfo"), "result.actions").alias("result"))))
        .when(F.col("g") % 6 == 3, F.to_json(F.struct(F.struct(info.alias("gameInfo"), F.slice("result.actions", 1, 0).alias("actions")).alias("result"))))
        .otherwise(plain)
    )
    rows = documents.select(F.explode(F.when(F.col("g") % 6 == 4, F.array(text, text)).otherwise(F.array(text))).alias("value"))
    path = scratch(spark, "damaged")
    rows.write.text(path)
    spark.createDataFrame([('{"result": {"gameInfo": {"gameId": "x"}}}',)], "value string").write.mode("append").text(path)
    return path


_KINDS = [(0, BROKEN), (1, NO_GAME), (2, NO_TEAMS), (3, NO_ACTIONS), (4, TWICE)]


@register("a02_quarantined", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{reason}' AS reason, count(*) + {int(k == 0)} AS n FROM schedule WHERE game_id % 6 = {k}" for k, reason in _KINDS) + ") WHERE n > 0", "schedule")
def _(spark, sf):
    """Damaged documents by reason."""
    path = scratch(spark, "quarantine")
    quarantine(read_checked(spark, _damaged(spark, sf), lines=True), path)
    return quarantined(spark, path)


@register("a02_good_documents", f"SELECT {ACTION_COLUMNS} FROM actions WHERE game_id % 6 >= 4", "actions")
def _(spark, sf):
    """Actions of the documents that are not damaged, each game once."""
    good = quarantine(read_checked(spark, _damaged(spark, sf), lines=True), scratch(spark, "quarantine"))
    return clean.clean_actions(play_by_play_actions(good)).select(*ACTION_COLUMNS.split(", "))


@register("k02_first_of_repeated", f"SELECT {ACTION_COLUMNS} FROM actions", "actions")
def _(spark, sf):
    """Every action comes again later with other points; the first one counts."""
    raw = fixture.raw_actions(model(spark, sf).events)
    later = raw.withColumns({"user_time": F.concat("user_time", F.lit("z")), "parameters_points": F.lit(9), "parameters_made": F.lit("made")})
    return clean.clean_actions(later.unionByName(raw)).select(*ACTION_COLUMNS.split(", "))


@register("k03_extract_rosters", "SELECT game_id, team_id, player_id, firstname, lastname, team_name, 2026 AS game_year FROM rosters WHERE game_year = 2026")
def _(spark, sf):
    """Rosters out of landed documents of one season."""
    path = landed(spark, fixture.documents(model(spark, sf).events))
    rows = clean.extract_rosters(read_play_by_play(spark, path, lines=True), 2026)
    return rows.join(model(spark, sf).schedule.where("game_year = 2026").select("game_id"), "game_id", "left_semi").drop("team_name_local")


@register("k04_substitutions", "SELECT game_id, id, team_id, player_in AS parameters_player_in, player_out AS parameters_player_out FROM actions WHERE type = 'substitution'", "actions")
def _(spark, sf):
    return clean.substitutions(model(spark, sf).actions).select("game_id", "id", "team_id", "parameters_player_in", "parameters_player_out")


@register("k05_possessions", "SELECT game_id, id, team_id, q_bucket, end_poss, sum_poss_poss, sum_block, sum_tech, final_end_poss FROM possessions")
def _(spark, sf):
    return model(spark, sf).possessions.select("game_id", "id", "team_id", "q_bucket", "end_poss", "sum_poss_poss", "sum_block", "sum_tech", "final_end_poss")


@register("k06_end_of_quarter_targets", "SELECT game_id, id FROM marks")
def _(spark, sf):
    return possessions.end_of_quarter_targets(model(spark, sf).actions)


@register("k07_lineups_lookup", "SELECT * FROM lookup")
def _(spark, sf):
    return model(spark, sf).lookup


@register("k08_stints", "SELECT * FROM stints")
def _(spark, sf):
    return model(spark, sf).stints


@register("k09_possessions_with_stints", "SELECT game_id, id, team_id, team_id_defense, segment_id, lineup_hash_offense, lineup_hash_defense, final_start_id, final_end_id FROM stamped")
def _(spark, sf):
    return model(spark, sf).stamped.select("game_id", "id", "team_id", "team_id_defense", "segment_id", "lineup_hash_offense", "lineup_hash_defense", "final_start_id", "final_end_id")


@register("k10_incremental_load", "SELECT game_id, id FROM actions WHERE game_id NOT IN (SELECT game_id FROM schedule WHERE game_date < DATE '2024-01-16')", "schedule")
def _(spark, sf):
    m = model(spark, sf)
    return unseen(m.actions, m.schedule.where("game_date < date'2024-01-16'")).select("game_id", "id")


@register("k10_given_games", "SELECT game_id, game_year, gn FROM schedule WHERE game_id IN (3, 5, 8, 13, 21)")
def _(spark, sf):
    m = model(spark, sf)
    return games_to_load(m.schedule, m.actions, [21, 3, 5, 8, 13, 3]).select("game_id", "game_year", "gn")


@register("k11_merge_by_key", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1 AND l_shipdate >= DATE '1996-01-01'
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_shipdate < DATE '1996-01-01' AND (l_orderkey, l_linenumber) NOT IN (
      SELECT (l_orderkey, l_linenumber) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1 AND l_shipdate >= DATE '1996-01-01')""", "")
def _(spark, sf):
    """Line items before 1996, with those of later years merged in, the latest of each key."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_partkey", "l_extendedprice")
    latest = [F.desc("l_shipdate"), "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    out = merge_by_key(items.where("l_shipdate < date'1996-01-01'"), items.where("l_shipdate >= date'1996-01-01'"), ["l_orderkey", "l_linenumber"], latest)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@register("k12_lineup_members", "SELECT * FROM members")
def _(spark, sf):
    return model(spark, sf).members


@register("k12_new_members", "SELECT * FROM members m WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.lineup_hash = m.lineup_hash AND o.team_id = m.team_id AND o.player_id = m.player_id AND o.game_year = 2025 AND m.game_year = 2025)")
def _(spark, sf):
    m = model(spark, sf)
    return lineups.new_members(m.lookup, m.members.where("game_year = 2025"))


@register("k13_sub_lineups", "SELECT team_id, lineup_hash, game_year, array_to_string(player_ids, '_') AS lineup_id, len(player_ids) AS num_lineup, md5(array_to_string(player_ids, '_')) AS sub_lineup_hash FROM subs")
def _(spark, sf):
    return model(spark, sf).subs.drop("player_ids")


# ---------------------------------------------------------------- facts and ratings


@register("k14_events_long", "SELECT game_id, id, type_lineup, team_id, lineup_hash, segment_id, team_score, final_end_poss FROM long")
def _(spark, sf):
    return model(spark, sf).long.select("game_id", "id", "type_lineup", "team_id", "lineup_hash", "segment_id", "team_score", "final_end_poss")


@register("k15_sched_long", "SELECT game_id, game_year, game_date, gn, game_type, CASE WHEN is_home THEN 'team1' ELSE 'team2' END AS team_slot, team_id, team_name, team_score, opp_team_id, opp_team_name, opp_score FROM games")
def _(spark, sf):
    return model(spark, sf).sched_long


@register("k16_final_schedule", "SELECT * FROM games")
def _(spark, sf):
    return model(spark, sf).games


@register("k17_lineup_totals_by_day", "SELECT * FROM totals")
def _(spark, sf):
    return model(spark, sf).totals


@register("k18_team_ppp_ratings", "SELECT * FROM ratings")
def team_ratings(spark, sf):
    return model(spark, sf).ratings


@register("k19_onoff_default", "SELECT * FROM onoff_season WHERE on_poss >= 100")
def _(spark, sf):
    return model(spark, sf).onoff_default


_RATE = {"ts": ("pts", "2 * (fga + coalesce(trips, 0))"), "oreb": ("oreb", "chances"), "tov": ("tov", "poss"), "ftr": ("fta", "fga")}
_CELLS = ", ".join(f"max(CASE WHEN type_lineup = '{k}' AND is_on = {on} THEN {c} END)::BIGINT AS {k[:3]}_{s}_{c}" for k in ("offense", "defense") for s, on in (("on", 1), ("off", 0)) for c in ("ts_n", "ts_d", "oreb_n", "oreb_d", "tov_n", "tov_d", "ftr_n", "ftr_d", "poss"))
_RATES = ", ".join(f"{k}_{s}_{r}_n / nullif({k}_{s}_{r}_d, 0) AS {k}_{s}_{r}" for k in ("off", "def") for s in ("on", "off") for r in _RATE)
_CHANGES = ", ".join(half_up(f"({k}_on_{r}_n * {k}_off_{r}_d - {k}_off_{r}_n * {k}_on_{r}_d)", f"({k}_on_{r}_d * {k}_off_{r}_d)", 1000) + f" / 10 AS {k}_{r}_diff" for k in ("off", "def") for r in _RATE)
_FLAGGED = "SELECT l.*, s.game_year, f.personal FROM long l JOIN schedule s ON s.game_id = l.game_id LEFT JOIN (SELECT game_id, id, ptype = 'personal' AS personal FROM long WHERE type = 'foul' GROUP BY ALL) f ON f.game_id = l.game_id AND f.id = l.parent_action_id"


@register("k20_player_advanced_stats", f"""
    SELECT player_id, team_id, firstname, lastname, team_name, game_year, {", ".join(f"{k}_{s}_{r}" for k in ("off", "def") for s in ("on", "off") for r in _RATE)}, {", ".join(f"{k}_{s}_poss" for k in ("off", "def") for s in ("on", "off"))}, {_CHANGES},
      percent_rank() OVER (PARTITION BY game_year ORDER BY off_on_ts - off_off_ts NULLS LAST) AS pr_diff_off_ts, percent_rank() OVER (PARTITION BY game_year ORDER BY off_on_oreb - off_off_oreb NULLS LAST) AS pr_diff_off_oreb,
      percent_rank() OVER (PARTITION BY game_year ORDER BY def_on_ts - def_off_ts DESC NULLS FIRST) AS pr_diff_def_ts
    FROM (SELECT *, {_RATES} FROM (SELECT player_id, team_id, game_year, {_CELLS} FROM (
        SELECT *, pts AS ts_n, 2 * (fga + trips) AS ts_d, oreb AS oreb_n, chances AS oreb_d, tov AS tov_n, poss AS tov_d, fta AS ftr_n, fga AS ftr_d FROM (
          SELECT player_id, b.team_id, game_year, is_on, type_lineup, sum(team_score) AS pts, sum({ENDED}) AS poss, count(*) FILTER (WHERE type = 'shot') AS fga, count(DISTINCT CASE WHEN type = 'freeThrow' AND personal THEN parent_action_id END) AS trips,
            count(*) FILTER (WHERE type = 'rebound' AND ptype = 'offensive') AS oreb, count(*) FILTER (WHERE (type = 'shot' AND made = 'missed') OR (type = 'freeThrow' AND made = 'missed' AND pct_ft = 1 AND personal)) AS chances,
            count(*) FILTER (WHERE type = 'turnover') AS tov, count(*) FILTER (WHERE type = 'freeThrow') AS fta
          FROM ({STATES}) b JOIN ({_FLAGGED}) x ON x.lineup_hash = b.lineup_hash GROUP BY ALL)) GROUP BY ALL))
    JOIN (SELECT DISTINCT player_id, team_id, firstname, lastname, team_name FROM rosters) USING (player_id, team_id)""", "members")
def _(spark, sf):
    return model(spark, sf).advanced


@register("k21_sub_lineups_stats", "SELECT team_id, sub_lineup_hash, game_year, array_to_string(player_ids, '_') AS player_ids, num_lineup, off_poss, off_pts, off_ppp, def_poss, def_pts, def_ppp, player_names_str FROM stats")
def _(spark, sf):
    return model(spark, sf).stats.select("team_id", "sub_lineup_hash", "game_year", joined(), "num_lineup", "off_poss", "off_pts", "off_ppp", "def_poss", "def_pts", "def_ppp", "player_names_str")


# ---------------------------------------------------------------- loads into versioned tables

#: What the store of loaded() holds by versions; a reader of version 0 is opened before version 1 is there.
_loaded: dict[tuple[str, str], tuple[Store, DataFrame]] = {}


def loaded(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """Games in two batches: the first season's, then all that are not there yet. Also the first version's ratings."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        _loaded.clear()
        m, store = model(spark, sf_dir), Store(spark, scratch(spark, "store"))
        load_games(store, Games(m, m.schedule.where("game_date < date'2024-01-16'")))
        first = store.read("ratings")
        store.follow(["ratings"], "current_")
        load_games(store, m)
        _loaded[key] = store, first
    return _loaded[key]


@register("k10_loaded_in_batches", "SELECT game_id, id, team_id, team_id_defense, segment_id, lineup_hash_offense, lineup_hash_defense, final_start_id, final_end_id FROM stamped")
def _(spark, sf):
    return loaded(spark, sf)[0].read("stamped").select("game_id", "id", "team_id", "team_id_defense", "segment_id", "lineup_hash_offense", "lineup_hash_defense", "final_start_id", "final_end_id")


_LOADED = ("actions", "rosters", "schedule", "possessions", "lookup", "stints", "stamped", "long", "members", "subs", "stats", "games", "ratings")


_WITH_YEARS = ("rosters", "schedule", "lookup", "members", "subs", "stats", "games", "ratings")


@register("k10_loaded_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, sum({'game_id' if t == 'schedule' else 'team_id'})::BIGINT AS ids, {'min(game_year)' if t in _WITH_YEARS else 'NULL::INT'} AS first_year FROM {t}" for t in _LOADED), "stats")
def _(spark, sf):
    """Rows and sums of ids of every table that the two batches have filled."""
    store = loaded(spark, sf)[0]

    def summed(name: str) -> DataFrame:
        t = store.read(name)
        return t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("game_id" if name == "schedule" else "team_id").alias("ids"), (F.min("game_year") if name in _WITH_YEARS else F.lit(None).cast("int")).alias("first_year"))

    return reduce(DataFrame.unionByName, map(summed, _LOADED))


@register("k12_members_loaded", "SELECT * FROM members")
def _(spark, sf):
    return loaded(spark, sf)[0].read("members")


@register("k13_sub_lineups_loaded", "SELECT team_id, lineup_hash, game_year, array_to_string(player_ids, '_') AS lineup_id, len(player_ids) AS num_lineup, md5(array_to_string(player_ids, '_')) AS sub_lineup_hash FROM subs")
def _(spark, sf):
    return loaded(spark, sf)[0].read("subs").drop("player_ids")


_STATS = "SELECT team_id, sub_lineup_hash, game_year, array_to_string(player_ids, '_') AS player_ids, num_lineup, off_poss, off_pts, off_ppp, def_poss, def_pts, def_ppp, player_names_str FROM stats"


def _stats(stats: DataFrame) -> DataFrame:
    return stats.select("team_id", "sub_lineup_hash", "game_year", joined(), "num_lineup", "off_poss", "off_pts", "off_ppp", "def_poss", "def_pts", "def_ppp", "player_names_str")


@register("k21_stats_loaded", _STATS, "stats")
def _(spark, sf):
    """Group totals to which the second batch was added."""
    return _stats(loaded(spark, sf)[0].read("stats"))


@register("k21_stats_of_games_loaded_again", _STATS, "stats")
def _(spark, sf):
    """Group totals after games with wrong points, one of them without its last actions, were loaded again by their ids."""
    m, store = model(spark, sf), Store(spark, scratch(spark, "again"))
    stale = Games(m, m.schedule)
    odd = F.col("game_id").isin(3, 5, 13)
    stale.__dict__["actions"] = m.actions.withColumn("parameters_points", F.when(odd, F.col("parameters_points") + 1).otherwise(F.col("parameters_points"))).where("game_id != 5 or id % 3 = 0")
    load_games(store, stale)
    load_games(store, m, [5, 3, 13, 21])
    return _stats(store.read("stats"))


@register("k19_onoff_loaded", "SELECT * FROM onoff_season WHERE on_poss >= 100")
def _(spark, sf):
    """Made again with the second batch, as its parents had changed."""
    return loaded(spark, sf)[0].read("onoff_default")


@register("a07_versions", "SELECT v AS version, ratings.* FROM ratings JOIN (VALUES (0), (1)) x(v) ON v = 1 OR game_year = 2025")
def _(spark, sf):
    """Ratings by a reader of version 0, opened before version 1 was committed, and by the view that followed."""
    store, first = loaded(spark, sf)
    store.sync()
    return first.select(F.lit(0).alias("version"), "*").unionByName(spark.table("current_ratings").select(F.lit(1).alias("version"), "*"))


@register("a08_refreshed_snapshot", "SELECT * FROM ratings")
def _(spark, sf):
    """Tables materialised twice as versions: the second time nothing has changed and none is written."""
    store = Store(spark, scratch(spark, "snapshot"))
    for again in (False, True):
        m = FixtureModel(spark, sf, min_on=100, min_all=50)
        m.__dict__["actions"] = model(spark, sf).actions
        written = refresh(store, m, ("actions", "rosters", "schedule", "team_dict", "subs_events", "possessions", "lookup", "stints", "stamped", "long", "cube", "ratings"))
        if bool(written) == again:
            raise ValueError(f"written: {written}")
    store.follow(["ratings"], "snapshot_")
    return spark.table("snapshot_ratings")


# ---------------------------------------------------------------- filters


@register("k12_members_appended", "SELECT * FROM members")
def _(spark, sf):
    """The table of members after one season was loaded, then all, then nothing new."""
    m, path = model(spark, sf), scratch(spark, "members")
    append(m.members.where("game_year = 2025"), path)
    jobs.append_members(m, path)
    return jobs.append_members(m, path)


@register("k13_sub_lineups_appended", "SELECT team_id, lineup_hash, game_year, array_to_string(player_ids, '_') AS lineup_id, true AS dated FROM subs")
def _(spark, sf):
    """The table of groups after one season was loaded, then all; rows carry the time of their run."""
    m, path = model(spark, sf), scratch(spark, "subs")
    append(m.subs.where("game_year = 2025").withColumn("created_at", F.current_timestamp()), path)
    return jobs.append_sub_lineups(m, path).select("team_id", "lineup_hash", "game_year", "lineup_id", F.col("created_at").isNotNull().alias("dated"))


@register("k21_refreshed_stats", "SELECT team_id, sub_lineup_hash, num_lineup, array_to_string(player_ids, '_') AS player_ids, player_names_str, off_poss, off_pts, off_ppp, def_poss, def_pts, def_ppp, game_year FROM stats", "stats")
def _(spark, sf):
    """Group totals merged into a table that has stale ones, and ones of a season that is gone by then."""
    m, path = model(spark, sf), scratch(spark, "stats")
    write_merged(spark, path, m.stats.where("game_year = 2025").withColumns({"off_pts": F.col("off_pts") + 7, "player_names_str": F.lit("?")}), KEYS["sub_lineups_stats"])
    jobs.refresh_group_stats(m, path, [2025])
    return jobs.refresh_group_stats(m, path).select("team_id", "sub_lineup_hash", "num_lineup", joined(), "player_names_str", "off_poss", "off_pts", "off_ppp", "def_poss", "def_pts", "def_ppp", "game_year")


@register("k22_filter_games", f"SELECT * FROM games WHERE game_year = 2025 AND {WINDOW_SQL} AND game_type IN (5, 34) AND opp_team_id IN (1, 2, 3) AND is_home AND has_won IS NOT DISTINCT FROM false")
def _(spark, sf):
    return filter_games(model(spark, sf).games, GameFilter(game_year=2025, start=START, end=END, game_types=[5, 34], opponents=[1, 2, 3], home_away="home", outcome="loss"))


_BOTTOM = "JOIN (SELECT *, max(rank_net_rtg) OVER (PARTITION BY game_year) AS worst FROM (SELECT g.game_id, g.team_id AS t, g.game_year, r.rank_net_rtg FROM games g LEFT JOIN ratings r ON r.game_year = g.game_year AND r.team_id = g.opp_team_id)) b ON b.game_id = g.game_id AND b.t = g.team_id"


@register("k23_opponent_rank_top", "SELECT g.* FROM games g JOIN ratings r ON r.game_year = g.game_year AND r.team_id = g.opp_team_id WHERE rank_off_ppp <= 2")
def _(spark, sf):
    m = model(spark, sf)
    return filter_by_opponent_rank(m.games, m.ratings, GameFilter(opp_rank_side="top", opp_rank_n=2, opp_rank_metric="off"))


@register("k23_opponent_rank_bottom", f"SELECT g.* FROM games g {_BOTTOM} WHERE b.rank_net_rtg >= worst - 1")
def _(spark, sf):
    m = model(spark, sf)
    return filter_by_opponent_rank(m.games, m.ratings, GameFilter(opp_rank_side="bottom", opp_rank_n=2))


_TOP_BY_GAME = f"""SELECT team_id FROM (SELECT team_id, {half_up("sum(o - d)", "count(o - d)", 1)} AS net FROM (
    SELECT game_id, team_id, max(CASE WHEN type_lineup = 'offense' THEN p END) AS o, max(CASE WHEN type_lineup = 'defense' THEN p END) AS d FROM (
      SELECT l.game_id, l.team_id, type_lineup, {half_up("sum(team_score)", f"sum({ENDED})", 10000)} AS p FROM long l JOIN (SELECT DISTINCT game_id FROM games WHERE {WINDOW_SQL}) w ON w.game_id = l.game_id GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) ORDER BY net DESC NULLS LAST, team_id LIMIT 2"""


@register("k24_opponent_top_bottom", _TOP_BY_GAME, "long")
def _(spark, sf):
    m = model(spark, sf)
    return onoff.opponent_top_bottom(m.cube, m.games, GameFilter(start=START, end=END, opp_rank_side="top", opp_rank_n=2))


def _filtered_core(where: str, elig: str) -> str:
    kept = f"(SELECT * FROM games WHERE {where})"
    return core(f"SELECT player_id, b.team_id, is_on, type_lineup, game_year, sum(l.team_score) AS pts, sum({ENDED}) AS poss FROM ({STATES}) b JOIN long l ON l.lineup_hash = b.lineup_hash JOIN {kept} s ON s.game_id = l.game_id AND s.team_id = b.team_id GROUP BY ALL", "games", elig)


@register("k25_onoff_compute", f"SELECT * FROM ({_filtered_core(f'{WINDOW_SQL} AND game_type IN (5, 16)', 'WHERE min_poss_all >= 20 AND coalesce(on_poss, 0) >= 40')}) WHERE net_rtg_diff >= -50", "members")
def _(spark, sf):
    return model(spark, sf).onoff_computed(OnOffParams(GameFilter(start=START, end=END, game_types=[5, 16]), min_all=20, min_on=40, min_net=-50))


@register("k25_onoff_compute_top_opponents", f"SELECT * FROM ({_filtered_core(f'{WINDOW_SQL} AND opp_team_id IN ({_TOP_BY_GAME})', 'WHERE min_poss_all >= 0 AND coalesce(on_poss, 0) >= 40')}) WHERE net_rtg_diff IS NOT NULL", "members")
def _(spark, sf):
    return model(spark, sf).onoff_computed(OnOffParams(GameFilter(start=START, end=END, opp_rank_side="top", opp_rank_n=2), min_on=40))


# ---------------------------------------------------------------- groups of players


def _lineups(spark, sf, p: LineupParams) -> DataFrame:
    return model(spark, sf).lineups(p).drop("player_names").withColumn("player_ids", joined())


_PRECOMPUTED = "SELECT team_id, sub_lineup_hash, num_lineup, array_to_string(player_ids, '_') AS player_ids, player_names_str, off_poss, off_pts, off_ppp, def_poss, def_pts, def_ppp, (round(off_ppp * 10) - round(def_ppp * 10)) / 10 AS net_rtg, game_year FROM stats"


@register("k26_lineups_precomputed", f"{_PRECOMPUTED} WHERE num_lineup = 3 AND list_contains(player_ids, 102) AND NOT list_contains(player_ids, 104) AND game_year = 2025 AND off_poss + def_poss >= 10")
def _(spark, sf):
    return _lineups(spark, sf, LineupParams(3, players=[102], without=[104], exact=True, min_poss=10, games=GameFilter(game_year=2025)))


@register("k26_lineups_exact", f"{_PRECOMPUTED} WHERE num_lineup = 3 AND player_ids = [101, 103, 106]")
def _(spark, sf):
    """As many players as the group has: exactly those."""
    return _lineups(spark, sf, LineupParams(3, players=[106, 101, 103], exact=True))


@register("k26_lineups_filtered", lineup_filter(f"{WINDOW_SQL} AND NOT is_home", "SELECT * FROM every WHERE num_lineup = 2", 10))
def _(spark, sf):
    return _lineups(spark, sf, LineupParams(2, min_poss=10, games=GameFilter(start=START, end=END, home_away="away")))


@register("k26_five_players_filtered", lineup_filter("b.rank_net_rtg >= worst - 1", "SELECT * FROM every WHERE num_lineup = 5", 5, _BOTTOM))
def _(spark, sf):
    return _lineups(spark, sf, LineupParams(5, min_poss=5, games=GameFilter(opp_rank_side="bottom", opp_rank_n=2)))


@register("k27_csv_ids", """SELECT doc_id, array_to_string(list_sort(list_distinct([x::INT for x in string_split(regexp_replace(csv, '\\s+', '', 'g'), ',') if x <> ''])), '_') AS ids
    FROM (SELECT o_orderkey AS doc_id, ' ' || (o_custkey % 50) || ',, ' || (o_orderkey % 7) || ' ,' || (o_custkey % 7) || ',' AS csv FROM orders)""", "")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.expr("' ' || (o_custkey % 50) || ',, ' || (o_orderkey % 7) || ' ,' || (o_custkey % 7) || ','").alias("csv"))
    return rows.select("doc_id", F.array_join(csv_ids_column(F.col("csv")), "_").alias("ids"))


@register("k27_lineups_csv", f"{_PRECOMPUTED} WHERE num_lineup = 2 AND team_id IN (1, 3) AND off_poss + def_poss >= 20")
def _(spark, sf):
    return _lineups(spark, sf, LineupParams.from_csv(2, teams=" 3, 1,,1 ", players=" ", min_poss=20))


@register("k28_team_ratings_dynamic", rated(sums(f"(SELECT * FROM games WHERE {WINDOW_SQL} AND has_won IS NOT DISTINCT FROM true)", "g.game_id = l.game_id AND g.team_id = l.team_id")), "long")
def _(spark, sf):
    return model(spark, sf).team_ratings(GameFilter(start=START, end=END, outcome="win"))


# ---------------------------------------------------------------- the same questions as SQL table functions


def _asked(spark, sf, question: str) -> DataFrame:
    sql.register(model(spark, sf))
    return spark.sql(f"SELECT * FROM {question}")


@register("j1_sql_onoff_compute", ORACLE_SQL["k25_onoff_compute"], "")
def _(spark, sf):
    return _asked(spark, sf, f"onoff_compute(DATE '{START}', DATE '{END}', NULL, 20, 40, -50D, NULL, p_game_type_csv => ' 16, 5,')")


@register("j1_sql_onoff_top_opponents", ORACLE_SQL["k25_onoff_compute_top_opponents"], "")
def _(spark, sf):
    return _asked(spark, sf, f"onoff_compute(DATE '{START}', DATE '{END}', '', 0, 40, NULL, NULL, p_opp_rank_side => 'top', p_opp_rank_n => 2, p_opp_rank_metric => 'net')")


@register("j2_sql_lineups_precomputed", ORACLE_SQL["k26_lineups_precomputed"], "")
def _(spark, sf):
    return _asked(spark, sf, "fetch_lineups_all(3, p_player_ids => array(102), p_player_off_ids => array(104), p_min_poss => 10, p_game_year => 2025)").drop("player_names").withColumn("player_ids", joined())


@register("j2_sql_lineups_filtered", ORACLE_SQL["k26_lineups_filtered"], "")
def _(spark, sf):
    return _asked(spark, sf, f"fetch_lineups_all(2, p_start_date => DATE '{START}', p_end_date => DATE '{END}', p_min_poss => 10, p_home_away => 'away')").drop("player_names").withColumn("player_ids", joined())


@register("j2_sql_five_players_filtered", ORACLE_SQL["k26_five_players_filtered"], "")
def _(spark, sf):
    return _asked(spark, sf, "fetch_lineups_all(5, p_min_poss => 5, p_opp_rank_side => 'bottom', p_opp_rank_n => 2)").drop("player_names").withColumn("player_ids", joined())


@register("j3_sql_lineups_csv", ORACLE_SQL["k27_lineups_csv"], "")
def _(spark, sf):
    return _asked(spark, sf, "fetch_lineups_csv(2, ' 3, 1,,1 ', ' ', NULL, true, NULL, NULL, 20)").drop("player_names").withColumn("player_ids", joined())


@register("j4_sql_team_ratings", rated(sums(f"(SELECT * FROM games WHERE {WINDOW_SQL} AND game_year = 2025 AND has_won IS NOT DISTINCT FROM true)", "g.game_id = l.game_id AND g.team_id = l.team_id")), "long")
def _(spark, sf):
    return _asked(spark, sf, f"get_team_ratings_dynamic(2025, DATE '{START}', DATE '{END}', p_outcome => 'win')")


# ---------------------------------------------------------------- reports


@register("k29_season_teams", "SELECT DISTINCT game_year, team_id, team_name FROM rosters WHERE game_year = 2026")
def _(spark, sf):
    return report.season_teams(model(spark, sf).rosters, 2026)


@register("k29_season_players", "SELECT game_year, team_id, player_id, name AS player_name FROM names WHERE game_year = 2025 AND team_id IN (1, 2)")
def _(spark, sf):
    return report.season_players(model(spark, sf).rosters, 2025, [1, 2])


@register("k30_opponent_ids", "SELECT DISTINCT team_name, team_id FROM rosters WHERE game_year = 2025 AND team_name IN (SELECT opp_team_name FROM games WHERE has_won AND game_year = 2025)")
def _(spark, sf):
    m = model(spark, sf)
    return report.opponent_ids(m.rosters, m.games.where("has_won and game_year = 2025").select(F.col("opp_team_name").alias("team_name")), 2025)


_REPORT = "SELECT 'T' || team_id AS team, player_names_str AS players, off_poss + def_poss AS total_poss, off_pts - def_pts AS plus_minus, off_poss, def_poss, off_pts, def_pts, off_ppp, def_ppp, (round(off_ppp * 10) - round(def_ppp * 10)) / 10 AS net_rtg, num_lineup, sub_lineup_hash FROM stats WHERE num_lineup = 3 AND game_year = 2025 AND off_poss + def_poss >= 20"


def _report(spark, sf) -> DataFrame:
    m = model(spark, sf)
    return report.lineup_report(m.lineups(LineupParams(3, min_poss=20, games=GameFilter(game_year=2025))), m.rosters)


@register("k31_lineup_report", _REPORT)
def _(spark, sf):
    return _report(spark, sf)


_TOTAL = f"""SELECT 0 AS is_total, '{report.TOTAL}' AS team, '{report.ALL_LINEUPS}' AS players, sum(off_poss) + sum(def_poss) AS total_poss, sum(off_pts) - sum(def_pts) AS plus_minus, sum(off_poss) AS off_poss, sum(def_poss) AS def_poss, sum(off_pts) AS off_pts, sum(def_pts) AS def_pts,
    sum(off_pts) / sum(off_poss) * 100 AS off_ppp, sum(def_pts) / sum(def_poss) * 100 AS def_ppp, sum(off_pts) / sum(off_poss) * 100 - sum(def_pts) / sum(def_poss) * 100 AS net_rtg, NULL::INT AS num_lineup, '{report.TOTAL}' AS sub_lineup_hash FROM ({_REPORT}) HAVING count(*) > 0
    UNION ALL SELECT 1, * FROM ({_REPORT})"""


@register("k32_lineup_report_total", _TOTAL, "stats")
def _(spark, sf):
    return report.with_total(_report(spark, sf))


def _average_rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER () > 1 THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 - 1) / (count({x}) OVER () - 1) END"


@register("k33_lineup_percentiles", f"SELECT sub_lineup_hash, is_total, CASE WHEN is_total = 1 THEN a END AS pr_ld_net, CASE WHEN is_total = 1 THEN b END AS pr_ld_off_ppp, CASE WHEN is_total = 1 THEN 1 - c END AS pr_ld_def_ppp_i FROM (SELECT *, {_average_rank('net_rtg')} AS a, {_average_rank('off_ppp')} AS b, {_average_rank('def_ppp')} AS c FROM (SELECT 1 AS is_total, * FROM ({_REPORT}))) UNION ALL SELECT '{report.TOTAL}', 0, NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM ({_REPORT}))", "stats")
def _(spark, sf):
    return report.with_percentiles(report.with_total(_report(spark, sf))).select("sub_lineup_hash", "is_total", "pr_ld_net", "pr_ld_off_ppp", "pr_ld_def_ppp_i")


@register("k34_onoff_report", "SELECT " + ", ".join(f"firstname || ' ' || lastname AS \"{t}\"" if c == "player" else f'{c} AS "{t}"' for c, t in report.TITLES.items()) + " FROM onoff_season WHERE on_poss >= 100")
def _(spark, sf):
    return report.onoff_report(model(spark, sf).onoff_default)


@register("k35_answer_routing", "SELECT * FROM onoff_season WHERE on_poss >= 100 AND game_year = 2026")
def _(spark, sf):
    """Nothing but the season is chosen: the precomputed rows, with percentiles among all players."""
    m = model(spark, sf)
    return m.onoff(OnOffParams(GameFilter(2026, *m.season(2026)), min_all=50, min_on=100))


_SEASON = "game_year = 2026 AND game_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'"


@register("k35_routing_teams", f"SELECT * FROM ({_filtered_core(f'{_SEASON} AND team_id IN (2, 4)', 'WHERE min_poss_all >= 50 AND coalesce(on_poss, 0) >= 100')}) WHERE net_rtg_diff IS NOT NULL", "members")
def _(spark, sf):
    """Teams are chosen: computed, with percentiles among their players."""
    m = model(spark, sf)
    return m.onoff(OnOffParams(GameFilter(2026, *m.season(2026), team_ids=[2, 4]), min_all=50, min_on=100))


@register("k35_routing_thresholds", f"SELECT * FROM ({_filtered_core(_SEASON, 'WHERE min_poss_all >= 50 AND coalesce(on_poss, 0) >= 120')}) WHERE net_rtg_diff IS NOT NULL", "members")
def _(spark, sf):
    """Another threshold is chosen: computed, with percentiles among those who pass it."""
    m = model(spark, sf)
    return m.onoff(OnOffParams(GameFilter(2026, *m.season(2026)), min_all=50, min_on=120))


_LATER = "game_year = 2026 AND game_date BETWEEN DATE '2024-01-18' AND DATE '2024-01-30'"


@register("k35_routing_dates", f"SELECT * FROM ({_filtered_core(_LATER, 'WHERE min_poss_all >= 50 AND coalesce(on_poss, 0) >= 100')}) WHERE net_rtg_diff IS NOT NULL", "members")
def _(spark, sf):
    """Another first day is chosen: computed from the games since then."""
    m = model(spark, sf)
    return m.onoff(OnOffParams(GameFilter(2026, date(2024, 1, 18), m.season(2026)[1]), min_all=50, min_on=100))


@register("k35_routing_ratings", "SELECT * FROM ratings WHERE game_year = 2026")
def _(spark, sf):
    """Nothing but the season is chosen: the precomputed ratings."""
    return model(spark, sf).team_ratings(GameFilter(game_year=2026))


@register("a09_report_csv", "SELECT team, players, total_poss, plus_minus, off_ppp, def_ppp, net_rtg, sub_lineup_hash FROM (" + _REPORT + ")", "stats")
def _(spark, sf):
    """The lineup report, written as CSV in its order and read again."""
    path = f"{scratch(spark, 'report')}/csv"
    export_csv(_report(spark, sf), path, [F.desc("total_poss"), "sub_lineup_hash"])
    rows = spark.read.schema("team string, players string, total_poss long, plus_minus long, off_poss long, def_poss long, off_pts long, def_pts long, off_ppp double, def_ppp double, net_rtg double, num_lineup short, sub_lineup_hash string").option("header", True).csv(path)
    return rows.select("team", "players", "total_poss", "plus_minus", "off_ppp", "def_ppp", "net_rtg", "sub_lineup_hash")


@register("g06_lineups_settled", f"{_PRECOMPUTED} WHERE num_lineup = 3 AND list_contains(player_ids, 101) AND NOT list_contains(player_ids, 103) AND NOT list_contains(player_ids, 104) AND off_poss + def_poss >= 10", "stats")
def _(spark, sf):
    """Player 103 was put into the list of those off court last, and so leaves the other one."""
    return _lineups(spark, sf, LineupParams.chosen(3, [101, 103], [104, 103], "off", min_poss=10))


@register("h21_season_of_orders", "SELECT o_orderkey, y AS game_year FROM orders JOIN (SELECT unnest(range(1990, 2000)) AS y) ON o_orderdate BETWEEN make_date(y - 1, 10, 1) AND make_date(y, 7, 1)", "")
def _(spark, sf):
    """Orders of each season, by the bounds that seasons have unless a source says otherwise."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    season = F.coalesce(*(F.when(F.col("day").between(*season_bounds(y)), y) for y in range(1990, 2000)))
    return orders.select("o_orderkey", season.alias("game_year")).where("game_year is not null")


# ---------------------------------------------------------------- primitives on the base tables


@register("c03_role_playing_joins", "SELECT o.o_orderkey, c.c_nationkey AS customer_nation, n.n_name AS customer_name, s.n_name AS region_peer FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN nation s ON s.n_nationkey = (c.c_nationkey + 1) % 25", "")
def _(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    nation = read("nation").select("n_nationkey", "n_name")
    rows = read("orders").select("o_orderkey", "o_custkey").join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    own = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_name"))
    peer = nation.select(F.col("n_nationkey").alias("peer"), F.col("n_name").alias("region_peer"))
    return rows.join(own, "c_nationkey").withColumn("peer", (F.col("c_nationkey") + 1) % 25).join(peer, "peer").select("o_orderkey", F.col("c_nationkey").alias("customer_nation"), "customer_name", "region_peer")


@register("e03_percent_rank_nulls_last", "SELECT s_suppkey, percent_rank() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END NULLS LAST) AS pr FROM supplier", "")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select("s_suppkey", percent_rank(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")), ["s_nationkey"]).alias("pr"))


@register("e03_percent_rank_of_line_items", "SELECT l_linenumber, l_extendedprice, count(*) AS n, max(pr) AS pr FROM (SELECT *, percent_rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice NULLS LAST) AS pr FROM lineitem) GROUP BY ALL", "")
def _(spark, sf):
    """Among all line items of a number: groups that are a large part of the table."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_linenumber", "l_extendedprice")
    return with_percent_rank(items, F.col("l_extendedprice"), ["l_linenumber"], "pr").groupBy("l_linenumber", "l_extendedprice").agg(F.count("*").alias("n"), F.max("pr").alias("pr"))


@register("e12_latest_row_per_key", "SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL", "")
def _(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate")))
    return items.withColumn("nth", nth).where("nth = 1").drop("nth")


@register("h18_json_field", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events", "")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("k13_groups_by_lineup", "SELECT team_id, lineup_hash, game_year, count(*) AS n FROM subs GROUP BY ALL")
def _(spark, sf):
    return model(spark, sf).subs.groupBy("team_id", "lineup_hash", "game_year").agg(F.count("*").alias("n"))


@register("k21_group_names", "SELECT team_id, sub_lineup_hash, game_year, player_names_str FROM group_names")
def _(spark, sf):
    m = model(spark, sf)
    every = m.subs.select("team_id", "sub_lineup_hash", "game_year", "player_ids").unionByName(lineups.full_lineups(m.members).select("team_id", "sub_lineup_hash", "game_year", "player_ids")).distinct()
    return groups.group_names(every, m.rosters).select("team_id", "sub_lineup_hash", "game_year", "player_names_str")
