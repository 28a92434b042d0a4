"""SQL for DuckDB that gives the rows of the registered queries, from the driver's tables alone."""

from __future__ import annotations


def half_up(n: str, d: str, scale: int) -> str:
    """round(n / d * scale), half away from zero, in whole numbers; null where d is 0."""
    return f"(sign({n})::BIGINT * ((abs({n})::BIGINT * {2 * scale} + ({d})::BIGINT) // nullif(2 * ({d})::BIGINT, 0)))"


def side(kind: str, column: str) -> str:
    return f"max(CASE WHEN type_lineup = '{kind}' THEN {column} END)"


def pr(order: str, by: str) -> str:
    return f"percent_rank() OVER (PARTITION BY {by} ORDER BY {order})"


ENDED = "CASE WHEN coalesce(final_end_poss, false) THEN 1 ELSE 0 END"
#: Which of the actions with one key and time counts.
_AT_ONE_TIME = ", ".join(f"{c} NULLS FIRST" for c in "parent_action_id player_id type quarter quarter_time made ptype points ft_number ft_awarded player_in player_out".split())
_SOD = "hour(ts) * 3600 + minute(ts) * 60 + second(ts)"


def rated(sums: str) -> str:
    return f"""SELECT game_year, team_id, team_name, o / 10 AS off_ppp, d / 10 AS def_ppp, n / 10 AS net_rtg,
      dense_rank() OVER (PARTITION BY game_year ORDER BY n DESC NULLS LAST) AS rank_net_rtg,
      dense_rank() OVER (PARTITION BY game_year ORDER BY o DESC NULLS LAST) AS rank_off_ppp,
      dense_rank() OVER (PARTITION BY game_year ORDER BY d ASC NULLS LAST) AS rank_def_ppp
    FROM (SELECT w.game_year, w.team_id, r.team_name, {half_up("op", "oq", 1000)} AS o, {half_up("dp", "dq", 1000)} AS d, {half_up("(op * dq - dp * oq)", "(oq * dq)", 1000)} AS n
          FROM (SELECT game_year, team_id, {side("offense", "pts")}::BIGINT AS op, {side("offense", "poss")}::BIGINT AS oq, {side("defense", "pts")}::BIGINT AS dp, {side("defense", "poss")}::BIGINT AS dq
                FROM ({sums}) GROUP BY ALL) w JOIN (SELECT DISTINCT game_year, team_id, team_name FROM rosters) r ON r.game_year = w.game_year AND r.team_id = w.team_id)"""


def sums(games: str, on: str) -> str:
    return f"SELECT g.game_year, l.team_id, type_lineup, sum(l.team_score) AS pts, sum({ENDED}) AS poss FROM long l JOIN {games} g ON {on} GROUP BY ALL"


def core(sums_cte: str, games: str, elig: str) -> str:
    """On/off rows from sums of (player, team, on/off, side, season)."""
    cells = ", ".join(f"max(CASE WHEN type_lineup = '{k}' AND is_on = {on} THEN {c} END) AS {k[:3]}_{s}_{c}" for k in ("offense", "defense") for s, on in (("on", 1), ("off", 0)) for c in ("ppp", "pr"))

    def among(x: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN percent_rank() OVER (PARTITION BY game_year, {x} IS NOT NULL ORDER BY {x} NULLS LAST) END"

    return f"""SELECT team_name, firstname, lastname, total / 10 AS net_rtg_diff, o / 10 AS off_on_diff, d / 10 AS def_on_diff, off_on_ppp / 10 AS off_on_ppp, def_on_ppp / 10 AS def_on_ppp, on_net / 10 AS on_net_rtg,
      off_off_ppp / 10 AS off_off_ppp, def_off_ppp / 10 AS def_off_ppp, off_net / 10 AS off_net_rtg, on_poss, off_poss, {among("total")} AS pr_net,
      off_on_pr AS pr_off_on, off_off_pr AS pr_off_off, def_on_pr AS pr_def_on_inv, def_off_pr AS pr_def_off_inv, {among("o")} AS pr_off_on_d, {among("d")} AS pr_def_on_d, 1 - ({among("d")}) AS pr_def_on_d_inv,
      {pr("on_net NULLS LAST", "game_year")} AS pr_on_net, {pr("off_net NULLS LAST", "game_year")} AS pr_off_net, player_id, team_id, game_year
    FROM (SELECT *, off_on_ppp - off_off_ppp AS o, def_on_ppp - def_off_ppp AS d, (off_on_ppp - off_off_ppp) - (def_on_ppp - def_off_ppp) AS total, off_on_ppp - def_on_ppp AS on_net, off_off_ppp - def_off_ppp AS off_net
      FROM (SELECT player_id, team_id, game_year, firstname, lastname, team_name, {cells}, min(poss) AS min_poss_all, max(CASE WHEN is_on = 1 THEN poss END) AS on_poss, max(CASE WHEN is_on = 0 THEN poss END) AS off_poss
        FROM (SELECT *, CASE WHEN type_lineup = 'defense' THEN 1 - raw ELSE raw END AS pr
              FROM (SELECT *, {pr("ppp NULLS LAST", "type_lineup, game_year")} AS raw FROM (SELECT *, {half_up("pts", "poss", 1000)} AS ppp FROM ({sums_cte}))))
        JOIN (SELECT DISTINCT r.player_id, r.team_id, r.firstname, r.lastname, r.team_name, g.game_year FROM rosters r JOIN {games} g ON g.game_id = r.game_id AND g.team_id = r.team_id) USING (player_id, team_id, game_year)
        GROUP BY player_id, team_id, game_year, firstname, lastname, team_name) {elig})"""


STATES = "SELECT DISTINCT player_id, team_id, lineup_hash, coalesce(is_on_verdict, 0) AS is_on FROM lookup WHERE lineup_hash IS NOT NULL"

#: The tables, each from those before it.
TABLES: dict[str, str] = {
    "keyed": f"SELECT *, d * 4 + least(t, opp) AS game_id FROM (SELECT *, xor(t, 1 + d % 3) AS opp FROM (SELECT event_id::INT AS id, ts, user_id, event_type, {_SOD} AS sod, hour(ts) AS h, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS d, json_extract_string(props, '$.k')::INT AS k, (user_id % 4)::INT AS t FROM events))",
    "typed": """SELECT *, CASE WHEN h < 23 THEN (21600 - (sod - (h // 6) * 21600)) // 36 ELSE (3600 - (sod - 82800)) // 12 END AS clock, CASE WHEN h < 23 THEN 1 + h // 6 ELSE 5 END AS qtr,
      CASE event_type WHEN 'view' THEN 'shot' WHEN 'click' THEN 'rebound' WHEN 'purchase' THEN 'freeThrow' WHEN 'signup' THEN 'substitution'
        ELSE CASE WHEN k < 40 THEN 'turnover' WHEN k < 75 THEN 'foul' WHEN k < 90 THEN 'block' ELSE 'quarter' END END AS type FROM keyed""",
    "raw": """SELECT game_id, id, coalesce(last_value(CASE WHEN type NOT IN ('rebound', 'freeThrow', 'block') THEN id END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY id RANGE UNBOUNDED PRECEDING), id) AS parent_action_id,
      t + 1 AS team_id, (t + 1) * 100 + (user_id // 4) % 8 AS player_id, type, qtr AS quarter, ts, lpad((clock // 60)::VARCHAR, 2, '0') || ':' || lpad((clock % 60)::VARCHAR, 2, '0') AS quarter_time, clock AS end_quarter_seconds_remaining,
      CASE WHEN qtr < 5 THEN clock + (4 - qtr) * 600 ELSE clock END::DOUBLE AS end_game_seconds_remaining,
      CASE type WHEN 'shot' THEN CASE WHEN k < 45 THEN 'made' WHEN k < 90 THEN 'missed' ELSE 'blocked' END WHEN 'freeThrow' THEN CASE WHEN k < 75 THEN 'made' ELSE 'missed' END END AS made,
      CASE type WHEN 'rebound' THEN CASE WHEN k < 30 THEN 'offensive' ELSE 'defensive' END WHEN 'foul' THEN CASE WHEN k < 70 THEN 'personal' ELSE 'technical' END WHEN 'quarter' THEN 'end-of-quarter' END AS ptype,
      CASE type WHEN 'shot' THEN CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END WHEN 'freeThrow' THEN 1 END AS points, CASE WHEN type = 'freeThrow' THEN 1 + k % 2 END AS ft_number, CASE WHEN type = 'freeThrow' THEN 2 END AS ft_awarded,
      CASE WHEN type = 'substitution' AND k % 10 < 7 THEN (t + 1) * 100 + (user_id // 4) % 8 END AS player_in, CASE WHEN type = 'substitution' AND k % 10 >= 7 THEN (t + 1) * 100 + (user_id // 4) % 8 END AS player_out FROM typed""",
    "actions": f"""SELECT * EXCLUDE (ts) FROM (SELECT * REPLACE (CASE WHEN parent_action_id = 0 THEN id ELSE parent_action_id END AS parent_action_id), CASE WHEN made = 'made' THEN points END AS team_score FROM raw WHERE ts IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY game_id, team_id, id ORDER BY ts, {_AT_ONE_TIME}) = 1""",
    "two": "SELECT game_id, min(d) AS d, min(least(t, opp)) AS low, max(greatest(t, opp)) AS high FROM keyed GROUP BY game_id",
    "rosters": "SELECT game_id, t + 1 AS team_id, (t + 1) * 100 + slot AS player_id, 'P' AS firstname, slot::VARCHAR AS lastname, 'T' || (t + 1) AS team_name, CASE WHEN d < 15 THEN 2025 ELSE 2026 END AS game_year FROM (SELECT game_id, d, unnest([low, high]) AS t FROM two), (SELECT unnest(range(8)) AS slot)",
    "points_by": "SELECT game_id, team_id - 1 AS t, sum(team_score) AS p FROM actions GROUP BY ALL",
    "schedule": """SELECT g.game_id, CASE WHEN d < 15 THEN 2025 ELSE 2026 END AS game_year, DATE '2024-01-01' + d AS game_date, d + 1 AS gn, [5, 16, 34][g.game_id % 3 + 1] AS game_type, 11 + CASE WHEN d % 2 = 0 THEN low ELSE high END AS team1, 11 + CASE WHEN d % 2 = 0 THEN high ELSE low END AS team2,
      coalesce(CASE WHEN d % 2 = 0 THEN a.p ELSE b.p END, 0) AS score_team1, coalesce(CASE WHEN d % 2 = 0 THEN b.p ELSE a.p END, 0) AS score_team2
      FROM two g LEFT JOIN points_by a ON a.game_id = g.game_id AND a.t = g.low LEFT JOIN points_by b ON b.game_id = g.game_id AND b.t = g.high""",
    "games": """SELECT game_id, game_year, game_date, gn, game_type, team_id, 'T' || team_id AS team_name, opp_team_id, 'T' || opp_team_id AS opp_team_name, team_score, opp_score, team_score - opp_score AS margin, team_score > opp_score AS has_won, is_home
      FROM (SELECT *, team1 - 10 AS team_id, team2 - 10 AS opp_team_id, score_team1 AS team_score, score_team2 AS opp_score, true AS is_home FROM schedule UNION ALL SELECT *, team2 - 10, team1 - 10, score_team2, score_team1, false FROM schedule)""",
    "grouped": """SELECT *, lead(type) OVER w AS nt, lead(ptype) OVER w AS np, round(ft_number / ft_awarded, 2) AS pct_ft, CASE WHEN quarter < 5 THEN 0 ELSE quarter END AS q_bucket FROM actions WINDOW w AS (PARTITION BY game_id, parent_action_id ORDER BY id)""",
    "ends": "SELECT *, CASE WHEN type = 'shot' AND made = 'made' THEN true WHEN np = 'defensive' AND nt = 'rebound' THEN true WHEN type = 'freeThrow' AND made = 'made' AND pct_ft = 1 THEN true WHEN type = 'turnover' THEN true ELSE false END AS end_poss FROM grouped",
    "counted": "SELECT *, count(*) FILTER (WHERE end_poss) OVER g AS sum_poss_poss, count(*) FILTER (WHERE made = 'blocked') OVER g AS sum_block, count(*) FILTER (WHERE ptype = 'technical') OVER g AS sum_tech, lead(end_poss) OVER (PARTITION BY game_id, parent_action_id ORDER BY id) AS next_end FROM ends WINDOW g AS (PARTITION BY game_id, parent_action_id)",
    "marks": """SELECT DISTINCT game_id, target AS id FROM (SELECT game_id, CASE WHEN np <> 'end-of-quarter' OR np IS NULL THEN NULL WHEN type = 'shot' AND made = 'missed' THEN id WHEN type = 'rebound' AND ptype = 'offensive' THEN id WHEN type = 'block' AND pp = parent_action_id THEN pid END AS target
      FROM (SELECT *, lead(ptype) OVER w AS np, lag(id) OVER w AS pid, lag(parent_action_id) OVER w AS pp FROM actions WINDOW w AS (PARTITION BY game_id, quarter ORDER BY id))) WHERE target IS NOT NULL""",
    "possessions": """SELECT c.*, CASE WHEN m.id IS NOT NULL THEN true WHEN sum_poss_poss >= 2 AND c.id = parent_action_id THEN NULL WHEN sum_block >= 1 THEN next_end WHEN sum_tech >= 1 THEN NULL ELSE end_poss END AS final_end_poss
      FROM counted c LEFT JOIN marks m ON m.game_id = c.game_id AND m.id = c.id""",
    "filled": """SELECT *, last_value(is_on IGNORE NULLS) OVER (PARTITION BY game_id, player_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS verdict
      FROM (SELECT r.player_id, r.game_id, r.team_id, r.game_year, a.id, a.quarter, a.quarter_time, a.end_game_seconds_remaining, CASE WHEN r.player_id = a.player_in THEN 1 WHEN r.player_id = a.player_out THEN 0 END AS is_on
            FROM rosters r JOIN actions a ON a.game_id = r.game_id AND a.team_id = r.team_id AND a.type = 'substitution')""",
    "last_of_clock": "SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY game_id, quarter, quarter_time, end_game_seconds_remaining, player_id, team_id ORDER BY id DESC) = 1",
    "lineup_at": "SELECT game_id, team_id, quarter, end_game_seconds_remaining, string_agg(player_id::VARCHAR, '_' ORDER BY player_id) AS lineup_id FROM last_of_clock WHERE verdict = 1 GROUP BY ALL",
    "lookup": """SELECT l.game_id, l.team_id, player_id, l.id, l.quarter, quarter_time, l.end_game_seconds_remaining, verdict AS is_on_verdict, lineup_id, count(*) FILTER (WHERE verdict = 1) OVER (PARTITION BY l.game_id, l.team_id, l.quarter, l.id) AS n_on, md5(lineup_id) AS lineup_hash, game_year
      FROM last_of_clock l LEFT JOIN lineup_at a USING (game_id, team_id, quarter, end_game_seconds_remaining)""",
    "segments": """SELECT game_id, team_id, quarter, lineup_hash, end_game_seconds_remaining AS s0, CASE WHEN nq > quarter AND nq >= 5 THEN 0 ELSE coalesce(ns, 0) END AS s1, id AS i0, coalesce(ni, last_id) AS i1
      FROM (SELECT u.*, last_id, lead(u.quarter) OVER w AS nq, lead(end_game_seconds_remaining) OVER w AS ns, lead(id) OVER w AS ni
            FROM (SELECT DISTINCT id, game_id, team_id, quarter, quarter_time, end_game_seconds_remaining, lineup_id, lineup_hash FROM lookup) u
            LEFT JOIN (SELECT game_id, quarter, max(id) AS last_id FROM actions WHERE quarter >= 4 GROUP BY ALL) x ON x.game_id = u.game_id AND x.quarter = u.quarter
            WINDOW w AS (PARTITION BY u.game_id, u.team_id ORDER BY u.quarter, end_game_seconds_remaining DESC, id))""",
    "stints": """SELECT o.team_id, f.team_id AS team_id_defense, o.game_id, CASE WHEN least(o.quarter, f.quarter) < 5 THEN 0 ELSE least(o.quarter, f.quarter) END AS q_bucket, least(o.s0, f.s0) AS final_start_seg, greatest(o.s1, f.s1) AS final_end_seg,
      dense_rank() OVER (PARTITION BY o.game_id ORDER BY greatest(o.i0, f.i0), least(o.i1, f.i1)) AS segment_id, o.lineup_hash AS lineup_hash_offense, f.lineup_hash AS lineup_hash_defense, greatest(o.i0, f.i0) AS final_start_id, least(o.i1, f.i1) AS final_end_id
      FROM segments o JOIN segments f ON f.game_id = o.game_id AND f.team_id <> o.team_id AND ((o.quarter < 5 AND f.quarter < 5) OR (o.quarter >= 5 AND f.quarter = o.quarter)) AND least(o.i1, f.i1) > greatest(o.i0, f.i0)""",
    "stamped": "SELECT p.*, s.team_id_defense, segment_id, final_start_seg, final_end_seg, lineup_hash_offense, lineup_hash_defense, final_start_id, final_end_id FROM possessions p LEFT JOIN stints s ON s.team_id = p.team_id AND s.game_id = p.game_id AND s.q_bucket = p.q_bucket AND p.id >= final_start_id AND p.id < final_end_id",
    "long": """SELECT id, game_id, type, made, ptype, pct_ft, parent_action_id, team_score, final_end_poss, segment_id, 'offense' AS type_lineup, team_id, lineup_hash_offense AS lineup_hash FROM stamped WHERE game_id <> 14 AND lineup_hash_offense IS NOT NULL
      UNION ALL SELECT id, game_id, type, made, ptype, pct_ft, parent_action_id, team_score, final_end_poss, segment_id, 'defense', team_id_defense, lineup_hash_defense FROM stamped WHERE game_id <> 14 AND lineup_hash_defense IS NOT NULL""",
    "totals": f"SELECT l.team_id, lineup_hash, type_lineup, l.game_id, sum({ENDED}) AS total_poss, coalesce(sum(team_score), 0) AS total_pts, game_date AS g_date, game_year FROM long l JOIN schedule s ON s.game_id = l.game_id GROUP BY ALL",
    "ratings": rated(sums("schedule", "g.game_id = l.game_id")),
    "members": "SELECT DISTINCT lineup_hash, team_id, player_id, game_year FROM lookup WHERE is_on_verdict = 1 AND lineup_hash IS NOT NULL",
    "subs": """SELECT team_id, lineup_hash, game_year, unnest(ids) AS player_ids FROM (
        SELECT a.team_id, a.lineup_hash, a.game_year, [[a.player_id, b.player_id]] AS ids FROM members a JOIN members b ON (b.team_id, b.lineup_hash, b.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND b.player_id > a.player_id
        UNION ALL SELECT a.team_id, a.lineup_hash, a.game_year, [[a.player_id, b.player_id, c.player_id]] FROM members a JOIN members b ON (b.team_id, b.lineup_hash, b.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND b.player_id > a.player_id JOIN members c ON (c.team_id, c.lineup_hash, c.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND c.player_id > b.player_id
        UNION ALL SELECT a.team_id, a.lineup_hash, a.game_year, [[a.player_id, b.player_id, c.player_id, e.player_id]] FROM members a JOIN members b ON (b.team_id, b.lineup_hash, b.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND b.player_id > a.player_id JOIN members c ON (c.team_id, c.lineup_hash, c.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND c.player_id > b.player_id JOIN members e ON (e.team_id, e.lineup_hash, e.game_year) = (a.team_id, a.lineup_hash, a.game_year) AND e.player_id > c.player_id)""",
    "fives": "SELECT team_id, lineup_hash, game_year, list(DISTINCT player_id ORDER BY player_id) AS player_ids FROM members GROUP BY ALL HAVING count(DISTINCT player_id) = 5",
    "every": "SELECT *, md5(array_to_string(player_ids, '_')) AS sub_lineup_hash, len(player_ids) AS num_lineup FROM subs UNION ALL SELECT *, lineup_hash, 5 FROM fives",
    "names": "SELECT team_id, player_id, game_year, min(trim(firstname) || ' ' || trim(lastname)) AS name FROM rosters GROUP BY ALL",
    "group_names": "SELECT team_id, sub_lineup_hash, game_year, string_agg(coalesce(name, '#' || player_id), ', ' ORDER BY player_id) AS player_names_str FROM (SELECT DISTINCT team_id, sub_lineup_hash, game_year, unnest(player_ids) AS player_id FROM every) LEFT JOIN names USING (team_id, player_id, game_year) GROUP BY ALL",
    "stats": f"""SELECT *, {half_up("nullif(off_pts, 0)", "off_poss", 1000)} / 10 AS off_ppp, {half_up("nullif(def_pts, 0)", "def_poss", 1000)} / 10 AS def_ppp FROM (
        SELECT i.team_id, i.sub_lineup_hash, i.game_year, i.player_ids, i.num_lineup, coalesce(sum(poss) FILTER (WHERE type_lineup = 'offense'), 0) AS off_poss, coalesce(sum(pts) FILTER (WHERE type_lineup = 'offense'), 0) AS off_pts,
          coalesce(sum(poss) FILTER (WHERE type_lineup = 'defense'), 0) AS def_poss, coalesce(sum(pts) FILTER (WHERE type_lineup = 'defense'), 0) AS def_pts
        FROM every i LEFT JOIN (SELECT lineup_hash, type_lineup, game_year, sum(total_poss) AS poss, sum(total_pts) AS pts FROM totals GROUP BY ALL) t ON t.lineup_hash = i.lineup_hash AND t.game_year = i.game_year GROUP BY ALL) JOIN group_names USING (team_id, sub_lineup_hash, game_year)""",
    "onoff_season": core(f"SELECT player_id, b.team_id, is_on, type_lineup, game_year, sum(team_score) AS pts, sum({ENDED}) AS poss FROM ({STATES}) b JOIN long l ON l.lineup_hash = b.lineup_hash JOIN schedule s ON s.game_id = l.game_id GROUP BY ALL", "games", ""),
}


def query(final: str, last: str | None = None) -> str:
    """A query over the tables up to the last one that it needs."""
    names = list(TABLES)
    if last is None:
        last = max((n for n in names if n in final.replace("(", " ").replace(")", " ").replace(",", " ").split()), key=names.index)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names[: names.index(last) + 1]) + "\n" + final


def lineup_filter(games_where: str, groups: str, min_poss: int, join: str = "") -> str:
    """Filtered lineups. groups: rows of every; games_where: a condition on games g."""
    kept = f"SELECT g.game_id, g.team_id FROM games g {join} WHERE {games_where}"
    o, d = "nullif(off_pts, 0)", "nullif(def_pts, 0)"
    return f"""SELECT a.team_id, a.sub_lineup_hash, a.num_lineup, array_to_string(a.player_ids, '_') AS player_ids, player_names_str, off_poss, off_pts, {half_up(o, "off_poss", 1000)} / 10 AS off_ppp, def_poss, def_pts, {half_up(d, "def_poss", 1000)} / 10 AS def_ppp,
      {half_up(f"({o} * def_poss - {d} * off_poss)", "(off_poss * def_poss)", 1000)} / 10 AS net_rtg, a.game_year
    FROM (SELECT e.team_id, e.sub_lineup_hash, e.num_lineup, e.player_ids, e.game_year, coalesce(sum(total_poss) FILTER (WHERE type_lineup = 'offense'), 0)::BIGINT AS off_poss, coalesce(sum(total_pts) FILTER (WHERE type_lineup = 'offense'), 0)::BIGINT AS off_pts,
        coalesce(sum(total_poss) FILTER (WHERE type_lineup = 'defense'), 0)::BIGINT AS def_poss, coalesce(sum(total_pts) FILTER (WHERE type_lineup = 'defense'), 0)::BIGINT AS def_pts
      FROM ({groups}) e JOIN totals t ON t.team_id = e.team_id AND t.game_year = e.game_year AND t.lineup_hash = e.lineup_hash JOIN ({kept}) k ON k.game_id = t.game_id AND k.team_id = t.team_id GROUP BY ALL HAVING sum(total_poss) >= {min_poss}) a
    LEFT JOIN group_names n ON n.team_id = a.team_id AND n.sub_lineup_hash = a.sub_lineup_hash AND n.game_year = a.game_year"""
