"""Window columns with the null order of the source database: nulls are the largest values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent_rank(value: Column, by: list, descending: bool = False) -> Column:
    order = value.desc_nulls_first() if descending else value.asc_nulls_last()
    return F.percent_rank().over(Window.partitionBy(*by).orderBy(order))


def dense_rank(by: list, order: Column) -> Column:
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(order))


#: Parts that a group's values are cut into, and the accuracy of the cuts.
PARTS, ACCURACY = 64, 1000


def ranked(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Adds rank (of the first of equals, nulls last), ties and among: rows of the group, and of its non-null values.

    No task sees a whole group. Values are counted first; approximate quantiles cut a group's values into parts, and
    the parts' sums say where each begins. The cuts decide where rows go, never what the ranks are.
    """
    groups = df.withColumn("__value", value)
    counts = groups.groupBy(*by, "__value").agg(F.count("*").alias("__n"))
    cuts = groups.groupBy(*by).agg(F.percentile_approx("__value", [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("__cuts"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__salt")
    # A group's cuts are a row; they meet its values under several keys.
    cuts = cuts.select(*(F.col(c).alias(f"__{c}") for c in by), "__cuts", salts)
    counts = counts.withColumn("__salt", F.pmod(F.xxhash64("__value"), F.lit(PARTS)).cast("int"))
    same = reduce(lambda a, b: a & b, (counts[c].eqNullSafe(cuts[f"__{c}"]) for c in by), counts["__salt"] == cuts["__salt"])
    part = F.when(F.col("__value").isNull(), PARTS).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col("__value"))))
    counts = counts.join(cuts, same).select(*(counts[c] for c in by), "__value", "__n", part.alias("__part"))
    total = Window.partitionBy(*by)
    sums = counts.groupBy(*by, "__part").agg(F.sum("__n").alias("__size"), F.sum(F.when(F.col("__value").isNotNull(), F.col("__n"))).alias("__some"))
    # At most PARTS + 1 rows for each group.
    before = F.coalesce(F.sum("__size").over(total.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), before.alias("__before"), F.sum("__size").over(total).alias("__all"), F.coalesce(F.sum("__some").over(total), F.lit(0)).alias("__among"))
    same = reduce(lambda a, b: a & b, (counts[c].eqNullSafe(sums[f"__{c}"]) for c in by), counts["__part"] == sums["__p"])
    inside = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy(F.col("__value").asc_nulls_last()))
    places = counts.withColumn("__first", inside - F.col("__n")).join(sums, same)
    places = places.select(*(counts[c].alias(f"__{c}") for c in by), F.col("__value").alias("__v"), (F.col("__before") + F.col("__first") + 1).alias("rank"), F.col("__n").alias("ties"), F.col("__all").alias("rows"), F.col("__among").alias("among"))
    same = reduce(lambda a, b: a & b, (groups[c].eqNullSafe(places[f"__{c}"]) for c in by), groups["__value"].eqNullSafe(places["__v"]))
    return groups.join(places, same).drop("__value", "__v", *(f"__{c}" for c in by))


def average_rank_percentile(value: Column, by: list) -> Column:
    """(average rank - 1) / (n - 1) of non-null values, null for nulls and where n <= 1."""
    n = F.count(value).over(Window.partitionBy(*by))
    first = F.rank().over(Window.partitionBy(*by).orderBy(value.asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull() & (n > 1), (first + (ties - 1) / 2 - 1) / (n - 1))


def with_percent_rank(df: DataFrame, value: Column, by: list[str], out: str) -> DataFrame:
    """Adds percent_rank() with nulls last, for groups of any size."""
    percent = F.when(F.col("rows") > 1, (F.col("rank") - 1) / (F.col("rows") - 1)).otherwise(F.lit(0.0))
    return ranked(df, value, by).withColumn(out, percent).drop("rank", "ties", "rows", "among")
