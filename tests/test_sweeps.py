"""Stints and stamps by one pass, against joins of intervals, also where a game's ids don't follow the clock."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.operators import lineups, stints
from fastbreak.plans.model import FixtureModel


def joined_stints(seg):
    """Every segment with every one of the other team."""
    out = []
    for o in seg:
        for d in seg:
            quarters = (o.quarter < 5 and d.quarter < 5) or (o.quarter >= 5 and o.quarter == d.quarter)
            ends = [x for x in (o.end_id, d.end_id) if x is not None]
            if o.game_id == d.game_id and o.team_id != d.team_id and quarters and ends and min(ends) > max(o.start_id, d.start_id):
                out.append((o.game_id, o.team_id, d.team_id, o.lineup_hash, d.lineup_hash, max(o.start_id, d.start_id), min(ends), min(o.start_segment, d.start_segment), max(o.end_segment, d.end_segment)))
    return sorted(out)


def lookup_of(spark, rng, games, tangled):
    rows = []
    for game in range(games):
        ids = {q: sorted(rng.choice(np.arange(q * 1000, q * 1000 + 900), 12, replace=False).tolist()) for q in (1, 2, 4, 5, 6)}
        for q, own in ids.items():
            clock = sorted(rng.integers(0, 600, 12).tolist(), reverse=True)
            if tangled and game % 2:
                rng.shuffle(own)
            for k, (i, at) in enumerate(zip(own, clock, strict=True)):
                rows.append((i, game, int(rng.integers(1, 3)) if k > 1 else k + 1, q, f"{at}", float(at + max(0, 4 - q) * 600), f"l{i}", f"h{i}"))
    return spark.createDataFrame(rows, "id int, game_id int, team_id int, quarter int, quarter_time string, end_game_seconds_remaining double, lineup_id string, lineup_hash string")


@pytest.mark.parametrize("tangled", [False, True])
def test_stints_are_all_overlaps(spark, tangled):
    rng = np.random.default_rng(4)
    lookup = lookup_of(spark, rng, 6, tangled)
    actions = spark.createDataFrame([(g, q, q * 1000 + 950) for g in range(6) for q in (1, 4, 5)], "game_id int, quarter int, id int")
    found = stints.stints(actions, lookup).select("game_id", "team_id", "team_id_defense", "lineup_hash_offense", "lineup_hash_defense", "final_start_id", "final_end_id", "final_start_seg", "final_end_seg")
    assert sorted(map(tuple, found.collect())) == joined_stints(stints.segments(actions, lookup).collect()) != []


@pytest.mark.parametrize("tangled", [False, True])
def test_stamps_are_all_stints_around(spark, tangled):
    rng = np.random.default_rng(5)
    spans = []
    for g in range(5):
        for t in (1, 2):
            cuts = sorted(rng.choice(500, 9, replace=False).tolist())
            for a, b in zip(cuts[::2], cuts[1::2], strict=False):
                spans.append((t, 3 - t, g, 0, 1.0, 0.0, f"o{a}", f"d{a}", a, b + (60 if tangled and g % 2 else 0), a))
    rows = spark.createDataFrame(spans, "team_id int, team_id_defense int, game_id int, q_bucket int, final_start_seg double, final_end_seg double, lineup_hash_offense string, lineup_hash_defense string, final_start_id int, final_end_id int, segment_id int")
    acts = [(g, int(i), int(rng.integers(1, 4)), int(rng.integers(0, 12) == 0) * 5, None if i % 7 else "x") for g in range(6) for i in rng.choice(600, 80, replace=False)]
    actions = spark.createDataFrame(acts, "game_id int, id int, team_id int, q_bucket int, type string")
    got = stints.stamp(actions, rows)
    assert got.columns[:5] == actions.columns
    want = [(*a, s[8], s[9], s[6]) for a in acts for s in ([s for s in spans if (s[0], s[2], s[3]) == (a[2], a[0], a[3]) and s[8] <= a[1] < s[9]] or [(None,) * 11])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select("game_id", "id", "team_id", "q_bucket", "type", "final_start_id", "final_end_id", "lineup_hash_offense").collect()), key=key) == sorted(want, key=key)
    assert stints.stamp(actions, rows.limit(0)).where("segment_id is not null").isEmpty() and stints.stamp(actions, rows.limit(0)).count() == len(acts)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join"), plan.count("Exchange")


def test_plans_on_written_tables(spark, tmp_path):
    """Adaptive execution off: what is shuffled and joined when tables come from Parquet."""
    model = FixtureModel(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model.materialise(str(tmp_path), ("actions", "rosters", "subs_events", "possessions", "lookup", "stints"))
        fresh = FixtureModel(spark, "/root/testdata/sf0.001")
        fresh.load(str(tmp_path), ("actions", "rosters", "subs_events", "possessions", "lookup", "stints"))
        for name in ("lookup", "stints", "stamped"):
            fresh.__dict__.pop(name, None)
        lookup, spans, stamped = fresh.lookup, None, None
        assert exchanges(lookup)[0] == 2  # both inputs, by game; the wide side stays where it is
        fresh.load(str(tmp_path), ("lookup",))
        spans = fresh.stints
        hashed, joins, _ = exchanges(spans)
        assert joins == 1 and hashed <= 3  # the last ids of quarters only
        fresh.load(str(tmp_path), ("stints",))
        stamped = fresh.stamped
        assert exchanges(stamped)[:2] == (1, 0)
        assert stamped.where(F.col("segment_id").isNotNull()).count() > 0
        fresh.materialise(str(tmp_path / "more"), ("schedule", "stamped", "long"))
        assert exchanges(fresh.advanced)[0] <= 8
        fresh.materialise(str(tmp_path / "more"), ("cube", "members", "subs"))
        # From the cube, not from the actions: seven for the groups' sums and names.
        assert exchanges(fresh.stats)[2] < 20 and "long" not in " ".join(fresh.stats.inputFiles())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stamps_sort_once(spark, tmp_path):
    """All windows of the stamps find their rows in the order of the first one (three sorts of all actions before)."""
    model = FixtureModel(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model.materialise(str(tmp_path), ("actions", "rosters", "subs_events", "possessions", "lookup", "stints"))
        plan = model.stamped._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" Sort [") == 1 and plan.count(" Window [") == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_of_shared_clock_readings(spark):
    """Of several substitutions at one reading the last is shown, but what the others did counts."""
    rng = np.random.default_rng(6)
    players = [(p, 1, t, 2025) for t in (1, 2) for p in range(t * 10, t * 10 + 4)]
    subs = []
    for i in range(60):
        team, who = int(rng.integers(1, 3)), int(rng.integers(0, 4))
        comes = bool(rng.integers(0, 2))
        subs.append((1, team, i, 1, f"{9 - i // 6}", float(9 - i // 6), f"{i:03}", team * 10 + who if comes else None, None if comes else team * 10 + who))
    rosters = spark.createDataFrame(players, "player_id int, game_id int, team_id int, game_year int")
    events = spark.createDataFrame(subs, "game_id int, team_id int, id int, quarter int, quarter_time string, end_game_seconds_remaining double, user_time string, parameters_player_in int, parameters_player_out int")
    want = set()
    for t in (1, 2):
        own = [s for s in subs if s[1] == t]
        state = {p[0]: None for p in players if p[2] == t}
        for k, s in enumerate(own):
            state |= {s[7]: 1} if s[7] else {s[8]: 0}
            if k + 1 == len(own) or own[k + 1][5] != s[5]:
                on = "_".join(str(p) for p in sorted(state) if state[p] == 1) or None
                want |= {(t, p, s[2], state[p], on) for p in state}
    got = lineups.lineups_lookup(rosters, events).select("team_id", "player_id", "id", "is_on_verdict", "lineup_id").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("tangled", [False, True])
def test_stamps_of_long_stints(spark, tangled):
    """Stints that reach over many slices of ids, or end and begin at their borders."""
    size = 1 << stints.SLICE
    cuts = [-2 * size - 5, -3, 7, size - 1, size, size + 1, 3 * size, 3 * size + 9, 9 * size + 4]
    spans = [(t, 3 - t, 1, 0, 1.0, 0.0, f"o{a}", f"d{a}", a, b + (2 * size if tangled else 0), k) for t in (1, 2) for k, (a, b) in enumerate(zip(cuts[t - 1 :: 2], cuts[t::2], strict=False))]
    rows = spark.createDataFrame(spans, "team_id int, team_id_defense int, game_id int, q_bucket int, final_start_seg double, final_end_seg double, lineup_hash_offense string, lineup_hash_defense string, final_start_id int, final_end_id int, segment_id int")
    near = sorted({i + d for i in [*cuts, *(k * size for k in range(-4, 13))] for d in (-1, 0, 1)})
    acts = [(1, i, t, 0) for i in near for t in (1, 2)] + [(1, None, 1, 0), (2, 5, 1, 0)]
    got = stints.stamp(spark.createDataFrame(acts, "game_id int, id int, team_id int, q_bucket int"), rows)
    want = [(*a, s) for a in acts for s in ([s[10] for s in spans if a[1] is not None and (s[0], s[2], s[3]) == (a[2], a[0], a[3]) and s[8] <= a[1] < s[9]] or [None])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select("game_id", "id", "team_id", "q_bucket", "segment_id").collect()), key=key) == sorted(want, key=key)


def test_stamps_see_slices(spark):
    """No window of the stamps holds a team's whole game, whose actions grow with the input (an executor's memory before)."""
    size = 1 << stints.SLICE
    actions = spark.range(-size, 3 * size).selectExpr("1 as game_id", "cast(id as int) as id", "1 as team_id", "0 as q_bucket")
    spans = spark.createDataFrame([(1, 2, 1, 0, 1.0, 0.0, "o", "d", 5, 2 * size, 1)], "team_id int, team_id_defense int, game_id int, q_bucket int, final_start_seg double, final_end_seg double, lineup_hash_offense string, lineup_hash_defense string, final_start_id int, final_end_id int, segment_id int")
    stamped = stints.stamp(actions, spans)
    windows = [line for line in stamped._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 3 and all("slice#" in line.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0] for line in windows)
    assert stamped.where("segment_id = 1").count() == 2 * size - 5
