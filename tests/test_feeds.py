"""Damaged feeds, SQL table functions, ranks of large groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fastbreak.functions.windows import ranked, with_percent_rank
from fastbreak.operators.filters import GameFilter
from fastbreak.operators.groups import LineupParams
from fastbreak.operators.onoff import OnOffParams
from fastbreak.plans import sql
from fastbreak.plans.model import FixtureModel
from fastbreak.sources import feeds


def test_damaged_documents_are_kept_with_reasons(spark, tmp_path):
    good = '{"result":{"gameInfo":{"gameId":%d,"homeTeam":{"id":1},"awayTeam":{"id":2}},"actions":[{"id":1,"type":"shot"}]}}'
    lines = [good % 1, good % 2, (good % 2).replace("shot", "foul"), good[:40], "", "[]", "null", '{"result":null}', (good % 5).replace('"gameId":5', '"gameId":"five"')]
    lines += [(good % 6).replace('"id":2', '"name":"x"'), (good % 7).replace('[{"id":1,"type":"shot"}]', "[]"), (good % 8).replace(',"actions":[{"id":1,"type":"shot"}]', "")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    checked = feeds.read_checked(spark, str(tmp_path / "in"), lines=True)
    kept = feeds.quarantine(checked, str(tmp_path / "bad"))
    assert sorted(r[0] for r in kept.select("result.gameInfo.gameId").collect()) == [1, 2]
    got = {r.reason: r.n for r in feeds.quarantined(spark, str(tmp_path / "bad")).collect()}
    assert got[feeds.TWICE] == 1 and got[feeds.NO_TEAMS] == 1 and got[feeds.NO_ACTIONS] == 2 and got[feeds.BROKEN] >= 2 and sum(got.values()) + 2 >= 10
    whole = tmp_path / "files"
    whole.mkdir()
    (whole / "1.json").write_text(good % 1)
    (whole / "2.json").write_text(good[:60])
    got = feeds.read_checked(spark, str(whole)).select("reason", "file", "damaged").collect()
    assert {(r.reason, r.file[-6:]) for r in got} == {(None, "1.json"), (feeds.BROKEN, "2.json")} and good[:60] in [r.damaged for r in got]


@pytest.mark.parametrize("by", [["g"], ["g", "h"]])
def test_ranks_like_windows(spark, by):
    rows = [(k, None if k % 50 == 0 else "ab"[k % 7 == 0], k % 3, None if k % 11 == 0 else float(k * k % 97) / 4) for k in range(900)] + [(5000, "one", 1, 2.0), (5001, "none", 1, None)]
    df = spark.createDataFrame(rows, "i int, g string, h int, x double").repartition(5)
    w = Window.partitionBy(*by)
    want = df.select("i", F.rank().over(w.orderBy(F.col("x").asc_nulls_last())).alias("rank"), F.count("*").over(Window.partitionBy(*by, "x")).alias("ties"), F.count("*").over(w).alias("rows"), F.count("x").over(w).alias("among"))
    got = ranked(df, F.col("x"), by)
    assert got.columns == ["i", "g", "h", "x", "rank", "ties", "rows", "among"]
    assert sorted(map(tuple, got.select("i", "rank", "ties", "rows", "among").collect())) == sorted(map(tuple, want.collect()))
    pr = with_percent_rank(df, F.col("x"), by, "pr").select("i", "pr").collect()
    assert sorted(map(tuple, pr)) == sorted(map(tuple, df.select("i", F.percent_rank().over(w.orderBy(F.col("x").asc_nulls_last()))).collect()))


def test_table_functions_like_the_library(spark):
    model = FixtureModel(spark, "/root/testdata/sf0.001", 0, 0).keep(("possessions", "lookup", "long", "cube", "members", "subs", "stats"))
    sql.register(model)

    def same(question, df):
        asked = spark.sql(f"SELECT * FROM {question}")
        assert asked.columns == df.columns
        assert sorted(map(str, asked.collect())) == sorted(map(str, df.collect())) != [], question

    same("get_team_ratings_dynamic(2025, p_game_type_csv => '5,16', p_opp_rank_side => 'top', p_opp_rank_n => 3, p_opp_rank_metric => 'def')", model.team_ratings(GameFilter(game_year=2025, game_types=[5, 16], opp_rank_side="top", opp_rank_n=3, opp_rank_metric="def")))
    same("fetch_lineups_csv(2, '1,2', '101', NULL, false, NULL, NULL, 0, p_home_away => 'home')", model.lineups(LineupParams.from_csv(2, teams="1,2", players="101", home_away="home")))
    same("fetch_lineups_all(3, p_player_off_ids => array(101, 202), p_min_poss => 0, p_game_year => 2026)", model.lineups(LineupParams(3, without=[101, 202], games=GameFilter(game_year=2026))))
    from datetime import date

    f = GameFilter(game_year=2026, start=date(2024, 1, 16), end=date(2024, 1, 30), outcome="loss")
    same("onoff_compute(DATE '2024-01-16', DATE '2024-01-30', NULL, 0, 0, NULL, '2026', p_outcome => 'loss')", model.onoff_computed(OnOffParams(f, min_on=0)))
    model.forget()
    plan = spark.sql("SELECT * FROM get_team_ratings_dynamic(2025)")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_outcome" not in plan and "regexp" not in plan  # what is not asked for is folded away
