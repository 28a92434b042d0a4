"""Where possessions end. Null means: not counted as an end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_buckets(actions: DataFrame) -> DataFrame:
    """The share of free throws taken, made points, and the period bucket: 0 in regulation, else the period."""
    share = F.round(F.col("parameters_free_throw_number") / F.nullif(F.col("parameters_free_throws_awarded"), F.lit(0)), 2)
    return actions.withColumns({"pct_ft": share, "team_score": F.when(F.col("parameters_made") == "made", F.col("parameters_points")), "q_bucket": F.when(F.col("quarter") < 5, 0).otherwise(F.col("quarter"))})


def possession_ends(actions: DataFrame) -> DataFrame:
    """Actions with end_poss, the counts of their group and final_end_poss.

    A group is what hangs on one parent action. Rows are dealt by game once; all windows here hold the game in
    their keys and need no other shuffle.
    """
    group = Window.partitionBy("game_id", "parent_action_id")
    ordered = group.orderBy("id", "quarter", F.desc("end_game_seconds_remaining"), "user_time")
    end = F.expr("""case when type = 'shot' and parameters_made = 'made' then true when next_param = 'defensive' and next_type = 'rebound' then true
                         when type = 'freeThrow' and parameters_made = 'made' and pct_ft = 1 then true when type = 'turnover' then true else false end""")
    base = with_buckets(actions.repartition("game_id")).withColumns({"next_type": F.lead("type").over(ordered), "next_param": F.lead("parameters_type").over(ordered)}).withColumn("end_poss", end).drop("next_type", "next_param")

    def count(condition: str):
        return F.coalesce(F.sum(F.expr(f"case when {condition} then 1 when not ({condition}) then 0 end")).over(group), F.lit(0))

    base = base.withColumns({"sum_poss_poss": count("end_poss"), "sum_block": count("parameters_made = 'blocked'"), "sum_tech": count("parameters_type = 'technical'"), "next_end": F.lead("end_poss").over(ordered)})
    own = F.when((F.col("sum_poss_poss") >= 2) & (F.col("id") == F.col("parent_action_id")), F.lit(None).cast("boolean")).when(F.col("sum_block") >= 1, F.col("next_end")).when(F.col("sum_tech") >= 1, F.lit(None).cast("boolean")).otherwise(F.col("end_poss"))
    # As in end_of_quarter_targets(), seen from the action that is marked; all of the game's actions with its id are.
    w = Window.partitionBy("game_id", "quarter").orderBy("id")
    base = base.withColumns({"own": own, "next_type": F.lead("type").over(w), "next_param": F.lead("parameters_type").over(w), "next_parent": F.lead("parent_action_id").over(w), "second_param": F.lead("parameters_type", 2).over(w)})
    last = F.expr("""(next_param = 'end-of-quarter' and ((type = 'shot' and parameters_made = 'missed') or (type = 'rebound' and parameters_type = 'offensive')))
                     or (second_param = 'end-of-quarter' and next_type = 'block' and next_parent = parent_action_id)""")
    marked = F.max(F.coalesce(last, F.lit(False))).over(Window.partitionBy("game_id", "id"))
    out = base.withColumn("marked", marked).withColumn("final_end_poss", F.when(F.col("marked"), True).otherwise(F.col("own")))
    return out.drop("own", "marked", "next_end", "next_type", "next_param", "next_parent", "second_param")


def end_of_quarter_targets(actions: DataFrame) -> DataFrame:
    """(game_id, id) of the last live actions before the ends of quarters: they end a possession."""
    w = Window.partitionBy("game_id", "quarter").orderBy("id")
    near = actions.select("game_id", "id", "type", "parameters_made", "parameters_type", "parent_action_id", F.lead("parameters_type").over(w).alias("next_param"), F.lag("id").over(w).alias("prev_id"), F.lag("parent_action_id").over(w).alias("prev_parent"))
    mark = F.expr("""case when type = 'shot' and parameters_made = 'missed' then id when type = 'rebound' and parameters_type = 'offensive' then id
                          when type = 'block' and prev_parent = parent_action_id then prev_id end""")
    return near.where("next_param = 'end-of-quarter'").select("game_id", mark.alias("id")).where("id is not null").distinct()
