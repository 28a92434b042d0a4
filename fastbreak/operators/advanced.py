"""Advanced rates on and off court: true shooting, offensive rebounds, turnovers, free throws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded_ratio
from ..functions.windows import percent_rank
from .facts import ended

RATES = ("ts", "oreb", "tov", "ftr")


def lineup_counts(long: DataFrame, schedule: DataFrame) -> DataFrame:
    """What the rates are made of, by lineup, side and season; fouls: those whose free throws were taken.

    Whether a free throw's foul was personal is looked up in the game's actions: a foul and what hangs on it have one key.
    """
    key = F.when(F.col("type") == "foul", F.col("id")).otherwise(F.col("parent_action_id"))
    foul = F.when(F.col("type") == "foul", F.col("parameters_type") == "personal")
    rows = long.select("id", "game_id", "lineup_hash", "type_lineup", "type", "parameters_type", "parameters_made", "pct_ft", "parent_action_id", "team_score", "final_end_poss").repartition("game_id")
    rows = rows.join(schedule.select("game_id", "game_year").repartition("game_id").distinct(), "game_id")
    rows = rows.withColumn("personal", F.max(foul).over(Window.partitionBy("game_id", key)))

    def n(condition: str, name: str):
        return F.count_if(F.expr(condition)).alias(name)

    last = "(type = 'freeThrow' and parameters_made = 'missed' and pct_ft = 1 and personal)"
    return rows.groupBy("lineup_hash", "type_lineup", "game_year").agg(
        F.sum("team_score").alias("pts"), F.sum(ended()).alias("poss"), n("type = 'shot'", "fga"), n("type = 'rebound' and parameters_type = 'offensive'", "oreb"),
        n(f"(type = 'shot' and parameters_made = 'missed') or {last}", "chances"), n("type = 'turnover'", "tov"), n("type = 'freeThrow'", "fta"),
        F.collect_set(F.when((F.col("type") == "freeThrow") & F.col("personal"), F.col("parent_action_id"))).alias("fouls"),
    )


def player_advanced_stats(long: DataFrame, lookup: DataFrame, rosters: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per (player, team, season): rates on and off, differences in tenths of a percent, percentiles.

    A foul's free throws are one true-shooting possession, so its id is counted once a player and state: lineups carry
    the set of their fouls, and a player's are united.
    """
    by_lineup = lineup_counts(long, schedule)
    states = lookup.select("player_id", "team_id", "lineup_hash", F.coalesce("is_on_verdict", F.lit(0)).alias("is_on")).where("lineup_hash is not null").repartition("lineup_hash").distinct()
    keys = ["player_id", "team_id", "game_year", "is_on", "type_lineup"]
    # Dealt by player, which serves all that follows but the percentiles.
    rows = states.join(by_lineup, "lineup_hash").repartition("player_id", "team_id")
    agg = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("pts", "poss", "fga", "oreb", "chances", "tov", "fta")), F.size(F.array_distinct(F.flatten(F.collect_list("fouls")))).alias("trips"))
    agg = agg.withColumn("ts_poss", F.col("fga") + F.col("trips"))
    parts = {"ts": ("pts", F.col("ts_poss") * 2), "oreb": ("oreb", F.col("chances")), "tov": ("tov", F.col("poss")), "ftr": ("fta", F.col("fga"))}
    agg = agg.select(*keys, "poss", *(x for k, (a, b) in parts.items() for x in (F.col(a).cast("bigint").alias(f"{k}_n"), F.nullif(b.cast("bigint"), F.lit(0)).alias(f"{k}_d"))))
    who = ["player_id", "team_id", "game_year"]
    cells = [f"{k}_{x}" for k in RATES for x in "nd"] + ["poss"]
    wide = agg.groupBy(*who).agg(*(F.max(F.when((F.col("type_lineup") == kind) & (F.col("is_on") == on), F.col(c))).alias(f"{kind[:3]}_{s}_{c}") for kind in ("offense", "defense") for s, on in (("on", 1), ("off", 0)) for c in cells))
    rates = {f"{k}_{s}_{r}": F.col(f"{k}_{s}_{r}_n") / F.col(f"{k}_{s}_{r}_d") for k in ("off", "def") for s in ("on", "off") for r in RATES}
    wide = wide.withColumns(rates)

    def change(k: str, r: str):
        """On minus off in tenths of a percent, rounded from whole numbers."""
        a, b, c, d = (F.col(f"{k}_{s}_{r}_{x}") for s in ("on", "off") for x in "nd")
        return rounded_ratio(a * d - c * b, b * d, 1000) / 10

    def difference(k: str, r: str):
        return F.col(f"{k}_on_{r}") - F.col(f"{k}_off_{r}")

    ranks = {"pr_diff_off_ts": percent_rank(difference("off", "ts"), ["game_year"]), "pr_diff_off_oreb": percent_rank(difference("off", "oreb"), ["game_year"]), "pr_diff_def_ts": percent_rank(difference("def", "ts"), ["game_year"], descending=True)}
    names = rosters.select("player_id", "team_id", "firstname", "lastname", "team_name").repartition("player_id", "team_id").distinct()
    out = wide.withColumns({f"{k}_{r}_diff": change(k, r) for k in ("off", "def") for r in RATES} | ranks).join(names, ["player_id", "team_id"])
    return out.select("player_id", "team_id", "firstname", "lastname", "team_name", "game_year", *rates, *(f"{k}_{s}_poss" for k in ("off", "def") for s in ("on", "off")), *(f"{k}_{r}_diff" for k in ("off", "def") for r in RATES), *ranks)
