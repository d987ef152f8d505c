"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from agestrata.operators import folds, ratio, schedule, summary  # noqa: E402
from agestrata.operators.policy import policy_schedule, year_spine  # noqa: E402
from agestrata.plans import all_queries  # noqa: E402
from agestrata.session import local_session  # noqa: E402

HEADLINE = [
    "oadr_history",
    "oadr_sim",
    "oadr_by_policy",
    "oadr_rolling",
    "backtest_rmse",
    "age_profile_summary",
    "total_population_summary",
    "pyramid_table",
    "oadr_grid",
    "schedule_band",
    "oadr_under_band",
    "merge_fertility",
    "central_rates",
    "life_table",
    "net_migration",
    "smooth_by_age",
    "product_ratio",
    "curve_covariance",
    "principal_components",
    "reconstruct",
    "drift_forecast",
    "rolling_rate_backtest",
]


# The published workload: paths, years, sexes and ages of the simulation.
PATHS, FIRST, LAST, AGES = 2000, 2020, 2050, 101


def published(spark):
    """12.5 million rows of the published shape: people fall with age from 65 on, and vary
    by path."""
    i, years = F.col("id"), LAST - FIRST + 1
    age = (i % AGES).cast("int")
    noise = F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000
    people = F.greatest(F.lit(1.0), 150_000.0 - 3_500.0 * F.greatest(age - 62, F.lit(0)) + noise)
    return spark.range(PATHS * years * 2 * AGES, numPartitions=16).select(
        F.expr(f"id div {AGES * 2 * years}").alias("Rep"),
        (F.expr(f"id div {AGES * 2}") % years + FIRST).cast("int").alias("Year"),
        F.when(F.expr(f"id div {AGES}") % 2 == 0, "Female").otherwise("Male").alias("Sex"),
        age.alias("Age"),
        people.alias("Population"),
    )


# The published evaluation: 19 origins of 25 training years, as many series as sexes and
# measures have.
SERIES, HISTORY, TRAIN, AHEAD = 8, 48, 25, 4


def published_backtest(spark):
    """Rolling refits of log rates that rise with age, fall with time and vary by cell."""
    cell = spark.range(SERIES * HISTORY * AGES, numPartitions=8)
    curves = cell.select(
        F.expr(f"id div {HISTORY * AGES}").alias("series"),
        (F.expr(f"id div {AGES}") % HISTORY + 1971).cast("int").alias("Year"),
        (F.col("id") % AGES).cast("int").alias("Age"),
        F.expr(f"-4 + 0.05D * (id % {AGES}) - 0.01D * (id div {AGES} % {HISTORY}) + pmod(xxhash64(id), 1000) / 1e4D").alias("value"),
    )
    return folds.rolling_rate_backtest(curves, folds.fold_table(curves, TRAIN, AHEAD), ["series"], AHEAD)


PUBLISHED = {
    "published_rolling_backtest": lambda s, _: published_backtest(s),
    "published_oadr_by_policy": lambda s, _: ratio.oadr_by_policy(
        published(s), policy_schedule(year_spine(s)), fill=False
    ),
    "published_schedule_band": lambda s, _: schedule.schedule_band(published(s), 804, 2024, 2050, 0.23),
    "published_age_profile_summary": lambda s, _: summary.age_profile_summary(published(s)),
}


def timed(query, spark, sf_dir):
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=8)
    queries = all_queries()
    # The first queries of a JVM pay for class loading, not for their own work.
    for name in ("oadr_history", "oadr_by_policy", "principal_components"):
        timed(queries[name], spark, sf_dir)
    seconds = {name: round(timed(queries[name], spark, sf_dir), 3) for name in HEADLINE}
    shaped = {name: round(timed(query, spark, sf_dir), 3) for name, query in PUBLISHED.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds | shaped,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
