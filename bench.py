"""Times the headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each table is timed as the rebuilding of a materialised view: from its parents' files to its own file; the totals by
game are those of the cube that ratings, on/off and groups are added up from. The three
parameterised queries are timed on those files, to a sink that drops the rows. Everything runs once untimed before.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import date
from statistics import median

from pyspark.sql import SparkSession

from fastbreak.operators.filters import GameFilter
from fastbreak.operators.groups import LineupParams
from fastbreak.operators.onoff import OnOffParams
from fastbreak.plans.model import TABLES, FixtureModel

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMED = {"actions": "k02_actions", "possessions": "k05_possessions", "lookup": "k07_lineups_lookup", "stints": "k08_stints", "stamped": "k09_stamped", "long": "k14_events_long", "cube": "k17_totals", "ratings": "k18_ratings", "subs": "k13_sub_lineups", "stats": "k21_group_stats", "onoff_default": "k19_onoff", "advanced": "k20_advanced"}
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    start, end = date(2024, 1, 3), date(2024, 1, 26)
    asked = {
        "k25_onoff_filtered": lambda m: m.onoff_computed(OnOffParams(GameFilter(start=start, end=end, game_types=[5, 16]), min_on=300)),
        "k26_lineups_filtered": lambda m: m.lineups(LineupParams(2, min_poss=20, games=GameFilter(start=start, end=end, home_away="away"))),
        "k28_ratings_filtered": lambda m: m.team_ratings(GameFilter(start=start, end=end, outcome="win")),
    }
    times: dict[str, list[float]] = {}
    for round_ in range(ROUNDS + 1):
        model, path = FixtureModel(spark, SF_DIR), tempfile.mkdtemp(prefix="bench-")
        for name in TABLES:
            began = time.perf_counter()
            model.materialise(path, [name])
            if round_ and name in TIMED:
                times.setdefault(TIMED[name], []).append(time.perf_counter() - began)
        for name, f in asked.items():
            began = time.perf_counter()
            f(model).write.format("noop").mode("overwrite").save()
            if round_:
                times.setdefault(name, []).append(time.perf_counter() - began)
    queries = {k: round(median(v), 3) for k, v in times.items()}
    print(json.dumps({"metric": "median seconds of all headline operators, summed", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
