"""Rules by hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fastbreak.functions.ids import contains_all, csv_ids_column, overlaps, parse_csv_ids, same_set, settle_choice
from fastbreak.functions.rounding import rounded_ratio
from fastbreak.functions.windows import average_rank_percentile, percent_rank
from fastbreak.operators import clean, facts, groups, lineups, onoff, possessions, report, stints
from fastbreak.operators.filters import GameFilter, filter_games, season_bounds
from fastbreak.operators.groups import LineupParams
from fastbreak.plans.model import FixtureModel
from fastbreak.schemas import ACTIONS, KEYS
from fastbreak.sources import feeds

FIELDS = [c.split()[0] for c in ACTIONS.split(", ")]


def actions(spark, rows):
    base = dict.fromkeys(FIELDS) | {"game_id": 1, "team_id": 1, "player_id": 100, "quarter": 1, "quarter_time": "05:00", "user_time": "x", "end_game_seconds_remaining": 2100.0}
    full = [base | {"id": i + 1, "parent_action_id": i + 1} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in full], ACTIONS)


def ends(spark, rows):
    return {r.id: r.final_end_poss for r in possessions.possession_ends(actions(spark, rows)).collect()}


MADE = {"type": "shot", "parameters_made": "made", "parameters_points": 2}
MISSED = {"type": "shot", "parameters_made": "missed"}
LAST_FT = {"type": "freeThrow", "parameters_made": "made", "parameters_free_throw_number": 1, "parameters_free_throws_awarded": 1}


def test_made_shot_and_turnover_end(spark):
    assert ends(spark, [MADE, {"type": "turnover"}, MISSED]) == {1: True, 2: True, 3: False}


def test_and_one_counts_the_free_throw(spark):
    assert ends(spark, [MADE, LAST_FT | {"parent_action_id": 1}]) == {1: None, 2: True}


def test_defensive_rebound_ends_the_missed_shot(spark):
    assert ends(spark, [MISSED, {"type": "rebound", "parameters_type": "defensive", "parent_action_id": 1}]) == {1: True, 2: False}


def test_technical_group_counts_nothing(spark):
    assert ends(spark, [{"type": "foul", "parameters_type": "technical"}, LAST_FT | {"parent_action_id": 1}]) == {1: None, 2: None}


def test_block_takes_the_next_end(spark):
    got = ends(spark, [{"type": "shot", "parameters_made": "blocked"}, {"type": "block", "parent_action_id": 1}, {"type": "rebound", "parameters_type": "defensive", "parent_action_id": 1}])
    assert got == {1: True, 2: False, 3: None}


@pytest.mark.parametrize(("rows", "marked"), [
    ([MISSED, {"type": "quarter", "parameters_type": "end-of-quarter"}], 1),
    ([MISSED, {"type": "rebound", "parameters_type": "offensive"}, {"type": "quarter", "parameters_type": "end-of-quarter"}], 2),
    ([MISSED, {"type": "block", "parent_action_id": 1}, {"type": "quarter", "parameters_type": "end-of-quarter"}], 1),
])
def test_end_of_quarter(spark, rows, marked):
    assert [r.id for r in possessions.end_of_quarter_targets(actions(spark, rows)).collect()] == [marked]
    assert ends(spark, rows)[marked] is True


def lookup_of(spark, subs):
    rosters = spark.createDataFrame([(1, t, 100 * t + k, 2025) for t in (1, 2) for k in range(3)], "game_id int, team_id int, player_id int, game_year int")
    rows = actions(spark, [{"type": "substitution"} | s for s in subs])
    return rows, lineups.lineups_lookup(rosters, clean.substitutions(rows))


def test_lineups_carry_forward_and_last_of_a_clock_counts(spark):
    subs = [
        {"player_id": 100, "parameters_player_in": 1, "quarter_time": "10:00", "end_game_seconds_remaining": 2400.0}, {"player_id": 101, "parameters_player_in": 1, "quarter_time": "09:00", "end_game_seconds_remaining": 2340.0},
        {"player_id": 100, "parameters_player_out": 1, "quarter_time": "09:00", "end_game_seconds_remaining": 2340.0},
    ]
    _, lookup = lookup_of(spark, subs)
    got = {(r.id, r.lineup_id, r.n_on) for r in lookup.collect()}
    assert got == {(1, "100", 1), (3, "101", 1)}


def test_nobody_on_is_null(spark):
    _, lookup = lookup_of(spark, [{"player_id": 100, "parameters_player_out": 1}])
    assert {(r.lineup_id, r.lineup_hash) for r in lookup.collect()} == {(None, None)}


def test_stints_are_half_open_and_two_sided(spark):
    subs = [{"player_id": 100, "parameters_player_in": 1}, {"team_id": 2, "player_id": 200, "parameters_player_in": 1, "end_game_seconds_remaining": 2000.0}, {"player_id": 101, "parameters_player_in": 1, "end_game_seconds_remaining": 1900.0}, {"quarter": 4, "end_game_seconds_remaining": 100.0, "type": "shot"}]
    rows, lookup = lookup_of(spark, subs[:3])
    rows = actions(spark, [{"type": "substitution"} | s for s in subs])
    poss = possessions.possession_ends(rows)
    found = stints.stints(poss, lookup)
    assert {(r.team_id, r.final_start_id, r.final_end_id) for r in found.collect()} <= {(1, 2, 3), (2, 2, 3)}
    stamped = {r.id: r.final_start_id for r in stints.stamp(poss, found).collect()}
    assert stamped[3] is None or stamped[3] >= 3


def test_sub_lineups_of_five(spark):
    members = spark.createDataFrame([("h", 1, p, 2025) for p in range(5)], "lineup_hash string, team_id int, player_id int, game_year int")
    sizes = {r.num_lineup: r["count"] for r in lineups.sub_lineups(members).groupBy("num_lineup").count().collect()}
    assert sizes == {2: 10, 3: 10, 4: 5}
    assert lineups.full_lineups(members).count() == 1


def test_clean_keeps_first_user_time_and_scores(spark):
    raw = actions(spark, [{"id": 7, "user_time": "b", "type": "shot"} | MADE, {"id": 7, "user_time": "a", "type": "freeThrow", "parameters_made": "made", "parent_action_id": 0}, {"id": 8, "user_time": None, "type": "shot"}, {"id": 9, "type": "clock"}, {"id": 10, "type": "freeThrow", "parameters_points": 5}])
    got = {r.id: r for r in clean.clean_actions(raw).collect()}
    assert set(got) == {7, 10}
    assert (got[7].user_time, got[7].team_score, got[7].parent_action_id, got[7].end_quarter_seconds_remaining, got[7].end_game_seconds_remaining) == ("a", 1, 7, 300, 2100.0)
    assert got[10].parameters_points is None


def test_rounding_is_exact(spark):
    cases = [(9, 4, 10, 23), (-9, 4, 10, -23), (1005, 1000, 100, 101), (1, 0, 10, None), (None, 5, 10, None), (0, 5, 10, 0)]
    df = spark.createDataFrame([(n, d, s) for n, d, s, _ in cases], "n long, d long, s int")
    for (n, d, s, want), row in zip(cases, df.collect(), strict=True):
        got = df.where(F.col("n").eqNullSafe(F.lit(n)) & (F.col("d") == d)).select(rounded_ratio(F.col("n"), F.col("d"), s).alias("x")).first().x
        assert got == want, row


def test_percentiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "i int, x double").withColumn("g", F.lit(0))
    got = {r.i: (r.p, r.a) for r in df.select("i", percent_rank(F.col("x"), ["g"]).alias("p"), average_rank_percentile(F.col("x"), ["g"]).alias("a")).collect()}
    assert got == {1: (0.0, 0.25), 2: (0.0, 0.25), 3: (2 / 3, 1.0), 4: (1.0, None)}


def test_ids(spark):
    assert parse_csv_ids(" 3, 1,,1 ") == [1, 3] and parse_csv_ids(" , ") is None and parse_csv_ids(None) is None
    row = spark.createDataFrame([([1, 2, 3], " 2,1, ,2", " ")], "a array<int>, c string, e string").select(contains_all(F.col("a"), [1, 3]), contains_all(F.col("a"), [4]), same_set(F.col("a"), [3, 2, 1]), same_set(F.col("a"), [1, 2]), overlaps(F.col("a"), [3, 9]), csv_ids_column(F.col("c")), csv_ids_column(F.col("e"))).first()
    assert tuple(row) == (True, False, True, False, True, [1, 2], None)


def test_exact_and_contains(spark):
    stats = spark.createDataFrame([(1, "a", 2025, [1, 2], 2), (1, "b", 2025, [1, 3], 2)], "team_id int, sub_lineup_hash string, game_year int, player_ids array<int>, num_lineup int")

    def found(**p):
        return sorted(r.sub_lineup_hash for r in groups._chosen(stats, LineupParams(2, **p)).collect())

    assert found(players=[1]) == ["a", "b"] and found(players=[1, 2], exact=True) == ["a"] and found(players=[1], exact=True) == ["a", "b"]
    assert found(players=[1, 1, 2], exact=True) == [] and found(without=[3]) == ["a"] and found(players=[1, 2, 3]) == []


def test_game_filter_routing():
    assert GameFilter(game_year=2025, team_ids=[1]).is_default and GameFilter(opp_rank_side="top").is_default
    assert not GameFilter(start=date(2024, 1, 1)).is_default and not GameFilter(opp_rank_side="top", opp_rank_n=1).is_default


def test_filter_games_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1, 2025, date(2024, 1, 2), 5, 1, 2, True, None)], "game_id int, game_year int, game_date date, game_type int, team_id int, opp_team_id int, is_home boolean, has_won boolean").write.parquet(str(tmp_path / "g"))
    df = filter_games(spark.read.parquet(str(tmp_path / "g")), GameFilter(game_year=2025, game_types=[5]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(game_year,2025)" in plan and "EqualTo(game_type,5)" in plan
    assert df.count() == 1 and filter_games(df, GameFilter(outcome="loss")).count() == 0


def test_merge_is_idempotent_and_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k int, v string, extra int")
    feeds.write_merged(spark, path, one, ["k"])
    for _ in range(2):
        last = feeds.write_merged(spark, path, two, ["k"])
    assert sorted(map(tuple, spark.read.parquet(last).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert feeds.latest_version(spark, path) == 2
    with pytest.raises(ValueError):
        feeds.write_merged(spark, path, two.unionByName(two), ["k"])
    assert feeds.latest_version(spark, path) == 2


def test_feeds(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"games": [{"ExternalID": "7", "game_date_txt": "3/1/2024", "score_team1": 80, "score_team2": 70, "team1": 11, "team2": 12, "gn": 1, "game_type": 5}, {"ExternalID": "8", "game_date_txt": "x", "score_team1": 0}]}]')
    s = feeds.read_schedule(spark, str(tmp_path / "s.json"), season="24", game_url="u/").collect()
    assert [(r.game_id, r.game_date, r.pbp_url, r.season, r.competition) for r in s] == [(7, date(2024, 1, 3), "u/7", "24", None)]
    player = '{"id": %d, "firstName": " A ", "lastName": "B"}'
    doc = '{"result": {"gameInfo": {"gameId": 7, "homeTeam": {"id": 1, "name": "H", "nameLocal": "h", "players": [%s, %s]}, "awayTeam": {"id": 2, "name": "W", "nameLocal": "w", "players": [%s]}}, "actions": [{"id": 1, "parentActionId": 0, "type": "shot", "quarter": 5, "quarterTime": "04:10", "userTime": "t", "teamId": 1, "playerId": 3, "parameters": {"made": "made", "points": 3}}]}}'
    (tmp_path / "g.json").write_text(doc % (player % 3, player % 3, player % 4))
    docs = feeds.read_play_by_play(spark, str(tmp_path / "g.json"))
    a = clean.clean_actions(feeds.play_by_play_actions(docs)).first()
    assert (a.parent_action_id, a.end_game_seconds_remaining, a.team_score) == (1, 250.0, 3)
    assert sorted((r.team_id, r.player_id, r.team_name) for r in clean.extract_rosters(docs).collect()) == [(1, 3, "H"), (2, 4, "W")]
    report.season_players(clean.extract_rosters(docs, 2025)).count()
    feeds.export_csv(docs.selectExpr("cast(null as int) as a", "1 as b"), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).collect()[1].value == ",1"


def test_invariants(spark):
    m = FixtureModel(spark, "/root/testdata/sf0.001")
    long = m.long
    assert m.stamped.groupBy("game_id", "id").count().where("count > 1").count() == 0
    assert long.groupBy("game_id", "id", "type_lineup").count().where("count > 1").count() == 0
    assert long.where("game_id = 14").count() == 0
    assert m.actions.groupBy(*KEYS["actions_clean"]).count().where("count > 1").count() == 0
    both = facts.lineup_totals_by_day(facts.lineup_cube(long, m.schedule))
    assert both.where("total_poss < 0").count() == 0
    plan = m.stamped._jdf.queryExecution().executedPlan().toString() + m.stints._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_materialise_and_load(spark, tmp_path):
    m = FixtureModel(spark, "/root/testdata/sf0.001").materialise(str(tmp_path), ["actions", "possessions"])
    n = FixtureModel(spark, "/root/testdata/sf0.001").load(str(tmp_path), ["possessions"])
    assert m.possessions.count() == n.possessions.count() == 1000


def test_a_player_is_on_or_off():
    assert settle_choice([1, 2, 3], [3, 4], "on") == ([1, 2, 3], [4])
    assert settle_choice([1, 2, 3], [3, 4], "off") == ([1, 2], [3, 4])
    assert settle_choice([], [3], "off") == ([], [3])


def test_season_bounds_decide_the_route():
    assert season_bounds(2026) == (date(2025, 10, 1), date(2026, 7, 1))
    asked = []

    class Rows:
        def where(self, condition):
            return "precomputed"

    def route(**choice):
        choice = {"start": date(2025, 10, 1), "end": date(2026, 7, 1)} | choice
        thresholds = {k: choice.pop(k) for k in ("min_all", "min_on") if k in choice}
        return onoff.onoff(Rows(), lambda p: asked.append(p) or "computed", onoff.OnOffParams(GameFilter(2026, **choice), **({"min_all": 100} | thresholds)))

    assert route() == "precomputed"
    for choice in ({"team_ids": [1]}, {"min_all": 0}, {"min_on": 299}, {"end": date(2026, 6, 30)}, {"start": None}, {"outcome": "win"}, {"opp_rank_n": 3}, {"game_types": [5]}):
        assert route(**choice) == "computed"
    assert len(asked) == 8


def test_one_shuffle_serves_all_windows_of_possessions(spark):
    plan = possessions.possession_ends(actions(spark, [MADE]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
