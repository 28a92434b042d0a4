"""The questions as SQL table functions, over views of the tables.

    register(model)
    SELECT * FROM get_team_ratings_dynamic(2025, p_outcome => 'win')

Parameters and defaults are those of the functions that they stand for; a null parameter is no filter. Arguments are
constants in the plan, so conditions on parameters that are not given are folded away and the others reach the scans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import Model

#: Tables that the functions read, as views of these names.
VIEWS = ("cube", "games", "ratings", "rosters", "lookup", "subs", "members", "stats")

_GAMES = """p_game_type_csv STRING DEFAULT NULL, p_opp_team_ids_csv STRING DEFAULT NULL, p_home_away STRING DEFAULT 'all', p_outcome STRING DEFAULT 'all',
  p_opp_rank_side STRING DEFAULT 'all', p_opp_rank_n INT DEFAULT NULL, p_opp_rank_metric STRING DEFAULT 'net'"""


def _text(name: str, default: str) -> str:
    """A text parameter, null and blank being the default."""
    return f"coalesce(nullif(trim({name}), ''), '{default}')"


def _ids(name: str) -> str:
    """Sorted distinct ids of a comma-separated parameter, null without any."""
    spaceless = rf"regexp_replace({name}, '\\s+', '')"
    return f"(CASE WHEN length(replace({spaceless}, ',', '')) > 0 THEN array_sort(array_distinct(transform(filter(split({spaceless}, ','), x -> x <> ''), x -> cast(x AS INT)))) END)"


def _rounded(n: str, d: str, scale: int) -> str:
    """As functions.rounding.rounded_ratio()."""
    return f"(((abs({n}) * {2 * scale} + nullif({d}, 0)) div (nullif({d}, 0) * 2)) * cast(sign({n}) as bigint))"


def _game_tests(year: str | None) -> str:
    tests = [f"({year} IS NULL OR g.game_year = {year})"] if year else []
    tests += ["(p_start_date IS NULL OR g.game_date >= p_start_date)", "(p_end_date IS NULL OR g.game_date <= p_end_date)"]
    tests += [f"({_ids('p_game_type_csv')} IS NULL OR array_contains({_ids('p_game_type_csv')}, g.game_type))", f"({_ids('p_opp_team_ids_csv')} IS NULL OR array_contains({_ids('p_opp_team_ids_csv')}, g.opp_team_id))"]
    home, outcome = _text("p_home_away", "all"), _text("p_outcome", "all")
    tests += [f"({home} = 'all' OR ({home} = 'home' AND g.is_home) OR ({home} = 'away' AND NOT g.is_home))", f"({outcome} = 'all' OR ({outcome} = 'win' AND g.has_won) OR ({outcome} = 'loss' AND NOT g.has_won))"]
    return " AND ".join(tests)


#: Games against the season's top or bottom opponents, if they are asked for.
_SIDE, _METRIC = _text("p_opp_rank_side", "all"), _text("p_opp_rank_metric", "net")
_RANK = f"CASE {_METRIC} WHEN 'off' THEN r.rank_off_ppp WHEN 'def' THEN r.rank_def_ppp ELSE r.rank_net_rtg END"
_RANKED = f"p_opp_rank_n IS NULL OR {_SIDE} NOT IN ('top', 'bottom') OR ({_SIDE} = 'top' AND opp_rank <= p_opp_rank_n) OR ({_SIDE} = 'bottom' AND opp_rank >= worst - p_opp_rank_n + 1)"


def _kept(year: str | None) -> str:
    """(game_id, team_id, game_year) of the games that pass."""
    return f"""SELECT DISTINCT game_id, team_id, game_year FROM (
      SELECT game_id, team_id, game_year, opp_rank, max(opp_rank) OVER (PARTITION BY game_year) AS worst FROM (
        SELECT g.game_id, g.team_id, g.game_year, {_RANK} AS opp_rank FROM games g LEFT JOIN ratings r ON r.game_year = g.game_year AND r.team_id = g.opp_team_id
        WHERE {_game_tests(year)})) WHERE {_RANKED}"""


RATINGS = f"""CREATE OR REPLACE TEMPORARY FUNCTION get_team_ratings_dynamic(p_game_year INT, p_start_date DATE DEFAULT NULL, p_end_date DATE DEFAULT NULL, {_GAMES})
RETURNS TABLE(game_year INT, team_id INT, team_name STRING, off_ppp DOUBLE, def_ppp DOUBLE, net_rtg DOUBLE, rank_net_rtg BIGINT, rank_off_ppp BIGINT, rank_def_ppp BIGINT)
RETURN WITH kept AS ({_kept("p_game_year")}),
sums AS (
  SELECT c.game_year, c.team_id, max(CASE WHEN type_lineup = 'offense' THEN pts END) AS op, max(CASE WHEN type_lineup = 'offense' THEN poss END) AS oq, max(CASE WHEN type_lineup = 'defense' THEN pts END) AS dp, max(CASE WHEN type_lineup = 'defense' THEN poss END) AS dq
  FROM (SELECT c.game_year, c.team_id, type_lineup, sum(pts) AS pts, sum(poss) AS poss FROM cube c LEFT SEMI JOIN kept k ON k.game_id = c.game_id AND k.team_id = c.team_id GROUP BY ALL) c GROUP BY ALL),
rated AS (
  SELECT s.game_year, s.team_id, n.team_name, {_rounded("op", "oq", 1000)} AS o, {_rounded("dp", "dq", 1000)} AS d, {_rounded("(op * dq - dp * oq)", "(oq * dq)", 1000)} AS net
  FROM sums s JOIN (SELECT DISTINCT game_year, team_id, team_name FROM rosters) n ON n.game_year = s.game_year AND n.team_id = s.team_id)
SELECT game_year, team_id, team_name, o / 10, d / 10, net / 10,
  cast(dense_rank() OVER (PARTITION BY game_year ORDER BY net DESC NULLS LAST) AS BIGINT), cast(dense_rank() OVER (PARTITION BY game_year ORDER BY o DESC NULLS LAST) AS BIGINT), cast(dense_rank() OVER (PARTITION BY game_year ORDER BY d ASC NULLS LAST) AS BIGINT)
FROM rated"""

_GROUP_COLUMNS = "team_id INT, sub_lineup_hash STRING, num_lineup SMALLINT, player_ids ARRAY<INT>, player_names ARRAY<STRING>, player_names_str STRING, off_poss BIGINT, off_pts BIGINT, off_ppp DOUBLE, def_poss BIGINT, def_pts BIGINT, def_ppp DOUBLE, net_rtg DOUBLE, game_year INT"
def _chosen(teams: str, players: str, without: str) -> str:
    """Sizes two to four count the ids as given, size five the distinct ones."""
    count = f"CASE WHEN p_num_lineup = 5 THEN size(array_distinct({players})) ELSE size({players}) END"
    return f"""g.num_lineup = p_num_lineup AND ({teams} IS NULL OR array_contains({teams}, g.team_id)) AND (p_game_year IS NULL OR g.game_year = p_game_year)
    AND ({players} IS NULL OR CASE WHEN NOT p_exact OR {count} < p_num_lineup THEN size(array_except({players}, g.player_ids)) = 0
      WHEN {count} = p_num_lineup THEN size(array_except({players}, g.player_ids)) = 0 AND size(array_except(g.player_ids, {players})) = 0 ELSE false END)
    AND ({without} IS NULL OR NOT coalesce(arrays_overlap(g.player_ids, {without}), false))"""


_FAST = f"(p_start_date IS NULL AND p_end_date IS NULL AND {_ids('p_game_type_csv')} IS NULL AND {_ids('p_opp_team_ids_csv')} IS NULL AND {_text('p_home_away', 'all')} = 'all' AND {_text('p_outcome', 'all')} = 'all' AND ({_SIDE} = 'all' OR p_opp_rank_n IS NULL))"


def _side(kind: str, column: str) -> str:
    return f"coalesce(sum(CASE WHEN type_lineup = '{kind}' THEN {column} END), 0)"


def _lineups(chosen: str) -> str:
    return f"""WITH kept AS ({_kept("p_game_year")}),
fives AS (SELECT team_id, game_year, lineup_hash AS sub_lineup_hash, sort_array(collect_set(player_id)) AS player_ids, cast(5 AS SMALLINT) AS num_lineup, lineup_hash FROM members GROUP BY team_id, game_year, lineup_hash HAVING size(collect_set(player_id)) = 5),
every AS (SELECT team_id, game_year, sub_lineup_hash, player_ids, num_lineup, lineup_hash FROM subs UNION ALL SELECT * FROM fives),
sums AS (SELECT c.team_id, c.game_year, c.lineup_hash, type_lineup, sum(poss) AS poss, sum(pts) AS pts FROM cube c LEFT SEMI JOIN kept k ON k.game_id = c.game_id AND k.team_id = c.team_id WHERE NOT {_FAST} GROUP BY ALL),
filtered AS (
  SELECT g.team_id, g.sub_lineup_hash, g.num_lineup, g.player_ids, g.game_year, {_side("offense", "poss")} AS oq, {_side("offense", "pts")} AS op, {_side("defense", "poss")} AS dq, {_side("defense", "pts")} AS dp
  FROM every g JOIN sums s ON s.team_id = g.team_id AND s.game_year = g.game_year AND s.lineup_hash = g.lineup_hash WHERE NOT {_FAST} AND {chosen} GROUP BY ALL)
SELECT g.team_id, g.sub_lineup_hash, g.num_lineup, g.player_ids, g.player_names, g.player_names_str, g.off_poss, g.off_pts, g.off_ppp, g.def_poss, g.def_pts, g.def_ppp, (rint(g.off_ppp * 10) - rint(g.def_ppp * 10)) / 10, g.game_year
FROM stats g WHERE {_FAST} AND {chosen} AND coalesce(g.off_poss, 0) + coalesce(g.def_poss, 0) >= p_min_poss
UNION ALL
SELECT f.team_id, f.sub_lineup_hash, f.num_lineup, f.player_ids, n.player_names, n.player_names_str, oq, op, {_rounded("nullif(op, 0)", "oq", 1000)} / 10, dq, dp, {_rounded("nullif(dp, 0)", "dq", 1000)} / 10, {_rounded("(nullif(op, 0) * dq - nullif(dp, 0) * oq)", "(oq * dq)", 1000)} / 10, f.game_year
FROM filtered f LEFT JOIN stats n ON n.team_id = f.team_id AND n.sub_lineup_hash = f.sub_lineup_hash AND n.game_year = f.game_year WHERE oq + dq >= p_min_poss"""


LINEUPS = f"""CREATE OR REPLACE TEMPORARY FUNCTION fetch_lineups_all(p_num_lineup INT, p_team_ids ARRAY<INT> DEFAULT NULL, p_player_ids ARRAY<INT> DEFAULT NULL, p_player_off_ids ARRAY<INT> DEFAULT NULL, p_exact BOOLEAN DEFAULT true,
  p_start_date DATE DEFAULT NULL, p_end_date DATE DEFAULT NULL, p_min_poss INT DEFAULT 20, p_game_year INT DEFAULT NULL, {_GAMES})
RETURNS TABLE({_GROUP_COLUMNS})
RETURN {_lineups(_chosen("p_team_ids", "p_player_ids", "p_player_off_ids"))}"""

#: The same with ids in text; a function can't hand its parameters on to another one.
LINEUPS_CSV = f"""CREATE OR REPLACE TEMPORARY FUNCTION fetch_lineups_csv(p_num_lineup INT, p_team_ids_csv STRING, p_player_ids_csv STRING, p_player_off_csv STRING, p_exact BOOLEAN, p_start_date DATE, p_end_date DATE, p_min_poss INT, p_game_year INT DEFAULT NULL, {_GAMES})
RETURNS TABLE({_GROUP_COLUMNS})
RETURN {_lineups(_chosen(_ids("p_team_ids_csv"), _ids("p_player_ids_csv"), _ids("p_player_off_csv")))}"""


def _percent(order: str, by: str) -> str:
    return f"percent_rank() OVER (PARTITION BY {by} ORDER BY {order})"


def _among(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN {_percent(f'{column} NULLS LAST', f'game_year, {column} IS NOT NULL')} END"


_CELLS = ", ".join(f"max(CASE WHEN type_lineup = '{k}' AND is_on = {on} THEN {c} END) AS {k[:3]}_{s}_{c}" for k in ("offense", "defense") for s, on in (("on", 1), ("off", 0)) for c in ("ppp", "pr"))
#: Teams by their average of per-game ratings within the dates, season and game types; ties go to the smaller id.
_STRENGTH = f"""SELECT team_id, row_number() OVER (ORDER BY CASE WHEN p_opp_rank_side = 'bottom' THEN metric ELSE -metric END ASC NULLS LAST, team_id) AS place FROM (
    SELECT team_id, CASE p_opp_rank_metric WHEN 'off' THEN {_rounded("sum(o)", "count(o)", 1)} WHEN 'def' THEN -{_rounded("sum(d)", "count(d)", 1)} ELSE {_rounded("sum(o - d)", "count(o - d)", 1)} END AS metric FROM (
      SELECT game_id, team_id, max(CASE WHEN type_lineup = 'offense' THEN ppp END) AS o, max(CASE WHEN type_lineup = 'defense' THEN ppp END) AS d FROM (
        SELECT c.game_id, c.team_id, type_lineup, {_rounded("sum(pts)", "sum(poss)", 10000)} AS ppp FROM cube c LEFT SEMI JOIN (SELECT g.game_id FROM games g WHERE g.game_date BETWEEN p_start_date AND p_end_date AND (p_game_year IS NULL OR cast(g.game_year AS STRING) = p_game_year)
          AND ({_ids('p_game_type_csv')} IS NULL OR array_contains({_ids('p_game_type_csv')}, g.game_type))) w ON w.game_id = c.game_id GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""
_ASKED = "p_opp_rank_side IS NOT NULL AND p_opp_rank_n IS NOT NULL AND p_opp_rank_metric IS NOT NULL"

ONOFF = f"""CREATE OR REPLACE TEMPORARY FUNCTION onoff_compute(p_start_date DATE, p_end_date DATE, p_team_ids STRING, p_min_all INT, p_min_on INT, p_min_net DOUBLE, p_game_year STRING, p_game_type_csv STRING DEFAULT NULL, p_opp_ids_csv STRING DEFAULT NULL,
  p_home_away STRING DEFAULT 'all', p_outcome STRING DEFAULT 'all', p_opp_rank_side STRING DEFAULT NULL, p_opp_rank_n INT DEFAULT NULL, p_opp_rank_metric STRING DEFAULT NULL)
RETURNS TABLE(team_name STRING, firstname STRING, lastname STRING, net_rtg_diff DOUBLE, off_on_diff DOUBLE, def_on_diff DOUBLE, off_on_ppp DOUBLE, def_on_ppp DOUBLE, on_net_rtg DOUBLE, off_off_ppp DOUBLE, def_off_ppp DOUBLE, off_net_rtg DOUBLE, on_poss BIGINT, off_poss BIGINT,
  pr_net DOUBLE, pr_off_on DOUBLE, pr_off_off DOUBLE, pr_def_on_inv DOUBLE, pr_def_off_inv DOUBLE, pr_off_on_d DOUBLE, pr_def_on_d DOUBLE, pr_def_on_d_inv DOUBLE, pr_on_net DOUBLE, pr_off_net DOUBLE, player_id INT, team_id INT, game_year INT)
RETURN WITH strongest AS ({_STRENGTH}),
kept AS (
  SELECT DISTINCT g.game_id, g.team_id, g.game_year FROM games g LEFT JOIN (SELECT team_id, place FROM strongest) x ON {_ASKED} AND x.team_id = g.opp_team_id
  WHERE g.game_date BETWEEN p_start_date AND p_end_date AND (p_game_year IS NULL OR cast(g.game_year AS STRING) = p_game_year)
    AND ({_ids('p_team_ids')} IS NULL OR array_contains({_ids('p_team_ids')}, g.team_id)) AND ({_ids('p_game_type_csv')} IS NULL OR array_contains({_ids('p_game_type_csv')}, g.game_type)) AND ({_ids('p_opp_ids_csv')} IS NULL OR array_contains({_ids('p_opp_ids_csv')}, g.opp_team_id))
    AND (coalesce(p_home_away, 'all') = 'all' OR (p_home_away = 'home' AND g.is_home) OR (p_home_away = 'away' AND NOT g.is_home)) AND (coalesce(p_outcome, 'all') = 'all' OR (p_outcome = 'win' AND g.has_won) OR (p_outcome = 'loss' AND NOT g.has_won))
    AND (NOT ({_ASKED}) OR x.place <= p_opp_rank_n)),
states AS (SELECT DISTINCT player_id, team_id, lineup_hash, coalesce(is_on_verdict, 0) AS is_on FROM lookup WHERE lineup_hash IS NOT NULL),
by_lineup AS (SELECT c.lineup_hash, c.type_lineup, k.team_id, k.game_year, sum(c.pts) AS pts, sum(c.poss) AS poss FROM cube c JOIN kept k ON k.game_id = c.game_id GROUP BY ALL),
sums AS (SELECT player_id, s.team_id, is_on, type_lineup, game_year, sum(pts) AS pts, sum(poss) AS poss FROM states s JOIN by_lineup b ON b.lineup_hash = s.lineup_hash AND b.team_id = s.team_id GROUP BY ALL),
ppp AS (SELECT *, {_rounded("pts", "poss", 1000)} AS ppp FROM sums),
ranked AS (SELECT *, CASE WHEN type_lineup = 'defense' THEN 1 - raw ELSE raw END AS pr FROM (SELECT *, {_percent("ppp NULLS LAST", "type_lineup, game_year")} AS raw FROM ppp)),
who AS (SELECT DISTINCT r.player_id, r.team_id, r.firstname, r.lastname, r.team_name, k.game_year FROM rosters r JOIN kept k ON k.game_id = r.game_id AND k.team_id = r.team_id),
wide AS (
  SELECT p.player_id, p.team_id, p.game_year, firstname, lastname, team_name, {_CELLS}, min(poss) AS least, max(CASE WHEN is_on = 1 THEN poss END) AS on_poss, max(CASE WHEN is_on = 0 THEN poss END) AS off_poss
  FROM ranked p JOIN who w ON w.player_id = p.player_id AND w.team_id = p.team_id AND w.game_year = p.game_year GROUP BY ALL),
compared AS (SELECT *, o - d AS total FROM (SELECT *, off_on_ppp - off_off_ppp AS o, def_on_ppp - def_off_ppp AS d, off_on_ppp - def_on_ppp AS on_net, off_off_ppp - def_off_ppp AS off_net FROM wide WHERE least >= p_min_all AND coalesce(on_poss, 0) >= coalesce(p_min_on, 0))),
placed AS (SELECT *, {_among("total")} AS pr_net, {_among("o")} AS pr_o, {_among("d")} AS pr_d, {_percent("on_net NULLS LAST", "game_year")} AS pr_on_net, {_percent("off_net NULLS LAST", "game_year")} AS pr_off_net FROM compared)
SELECT team_name, firstname, lastname, total / 10, o / 10, d / 10, off_on_ppp / 10, def_on_ppp / 10, on_net / 10, off_off_ppp / 10, def_off_ppp / 10, off_net / 10, on_poss, off_poss,
  pr_net, off_on_pr, off_off_pr, def_on_pr, def_off_pr, pr_o, pr_d, 1 - pr_d, pr_on_net, pr_off_net, player_id, team_id, game_year
FROM placed WHERE total IS NOT NULL AND (p_min_net IS NULL OR total / 10 >= p_min_net)"""

FUNCTIONS = {"get_team_ratings_dynamic": RATINGS, "fetch_lineups_all": LINEUPS, "fetch_lineups_csv": LINEUPS_CSV, "onoff_compute": ONOFF}


def register_functions(spark: SparkSession) -> None:
    """Create the functions in a session that has the views."""
    for statement in FUNCTIONS.values():
        spark.sql(statement)


def register(model: Model) -> None:
    """Views of a model's tables, and the functions over them."""
    for name in VIEWS:
        model.view(name)
    register_functions(model.spark)
