"""Demographic tables derived from ``lineitem``, and the same views as SQL.

The given tables hold no people, so each view reads a whole table and gives its
rows demographic roles: a shipment's year is a Year, its part a single-year Age,
its line status a Sex and its quantity a number of people. Replicates are blocks
of orders and series are blocks of suppliers, so both grow with the data.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.operators.folds import fold_table, fold_years
from agestrata.operators.policy import policy_schedule

ORDERS_PER_REP = 500
SUPPLIERS_PER_SERIES = 20
# The published schedule starts in 2015; moved back so that the years of the data
# see whole and fractional ages and the cap.
POLICY_BASE_YEAR = 1989
FOLD_TRAIN, FOLD_HORIZON = 3, 2
FERTILITY_REGION = "ASIA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str, ages: int = 101) -> DataFrame:
    """One row per line item, with its demographic roles."""
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("Year"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("Sex"),
        (F.col("l_partkey") % ages).cast("int").alias("Age"),
        F.col("l_quantity").alias("Population"),
        F.expr(f"l_orderkey div {ORDERS_PER_REP}").alias("Rep"),
        F.expr(f"cast(l_suppkey div {SUPPLIERS_PER_SERIES} as string)").alias("series"),
        (F.col("l_returnflag") == "R").alias("event"),
    )


def pop(spark, sf_dir, ages: int = 101, keys: Sequence[str] = ()) -> DataFrame:
    return (
        people(spark, sf_dir, ages)
        .groupBy(*keys, "Year", "Sex", "Age")
        .agg(F.sum("Population").alias("Population"))
    )


def sim(spark, sf_dir, rep: Column | None = None) -> DataFrame:
    """``rep`` replaces the replicate, as an expression over line item columns."""
    if rep is None:
        return pop(spark, sf_dir, keys=["Rep"])
    lines = table(spark, sf_dir, "lineitem").select(
        rep.alias("Rep"),
        F.year("l_shipdate").alias("Year"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("Sex"),
        (F.col("l_partkey") % 101).cast("int").alias("Age"),
        "l_quantity",
    )
    return lines.groupBy("Rep", "Year", "Sex", "Age").agg(F.sum("l_quantity").alias("Population"))


def years(spark, sf_dir) -> DataFrame:
    return people(spark, sf_dir).select("Year").distinct()


def policy(spark, sf_dir) -> DataFrame:
    return policy_schedule(years(spark, sf_dir), base_year=POLICY_BASE_YEAR)


def rates(spark, sf_dir) -> DataFrame:
    return (
        people(spark, sf_dir)
        .groupBy("series", "Sex", "Year", "Age")
        .agg(
            F.count_if("event").cast("double").alias("events"),
            F.sum("Population").alias("exposure"),
        )
        .withColumn("rate", F.try_divide("events", "exposure"))
    )


def births(spark, sf_dir) -> DataFrame:
    """``series, Year, Age, births`` by age of mother."""
    mothers = F.col("event") & (F.col("Sex") == "Female") & F.col("Age").between(15, 49)
    return (
        people(spark, sf_dir)
        .where(mothers)
        .groupBy("series", "Year", "Age")
        .agg(F.sum("Population").alias("births"))
    )


def fertility_file(spark, sf_dir) -> DataFrame:
    """The columns of a fertility file; regions come from the supplier."""
    lines = table(spark, sf_dir, "lineitem")
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    measure = (
        F.when(F.col("l_returnflag") == "R", "Births")
        .when(F.col("l_returnflag") == "N", "Female population")
        .otherwise("Other")
    )
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(
            F.col("r_name").alias("Region"),
            (15 + F.col("l_partkey") % 40).cast("string").alias("Age"),
            F.year("l_shipdate").alias("Time"),
            measure.alias("Measure"),
        )
        .agg(F.sum("l_quantity").alias("Value"))
    )


def fertility_history(spark, sf_dir) -> DataFrame:
    """Older rates, ending after the file begins."""
    return (
        people(spark, sf_dir)
        .where((F.col("Sex") == "Female") & F.col("Age").between(15, 49))
        .groupBy((F.col("Year") - 5).cast("int").alias("Year"), "Age")
        .agg(
            F.count_if("event").cast("double").alias("_events"),
            F.sum("Population").alias("exposure"),
        )
        .select("Year", "Age", F.try_divide("_events", "exposure").alias("rate"), "exposure")
    )


def folds(spark, sf_dir) -> DataFrame:
    return fold_table(years(spark, sf_dir), FOLD_TRAIN, FOLD_HORIZON)


def rolling_sim(spark, sf_dir) -> DataFrame:
    """Each origin's test years of the simulation."""
    return sim(spark, sf_dir).join(fold_years(folds(spark, sf_dir), "test").drop("train_to"), "Year")


SQL_VIEWS = {
    "people": f"""
        SELECT CAST(year(l_shipdate) AS INTEGER) AS Year,
               CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS Sex,
               CAST(l_partkey % 101 AS INTEGER) AS Age,
               CAST(l_partkey % 120 AS INTEGER) AS RawAge,
               l_quantity AS Population,
               l_orderkey // {ORDERS_PER_REP} AS Rep,
               CAST(l_suppkey // {SUPPLIERS_PER_SERIES} AS VARCHAR) AS series,
               l_returnflag = 'R' AS event
        FROM lineitem""",
    "v_pop": """
        SELECT Year, Sex, Age, sum(Population) AS Population FROM people GROUP BY ALL""",
    "v_raw_pop": """
        SELECT Year, Sex, RawAge AS Age, sum(Population) AS Population FROM people GROUP BY ALL""",
    "v_sim": """
        SELECT Rep, Year, Sex, Age, sum(Population) AS Population FROM people GROUP BY ALL""",
    "v_sim_orders": """
        SELECT l_orderkey AS Rep, CAST(year(l_shipdate) AS INTEGER) AS Year,
               CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS Sex,
               CAST(l_partkey % 101 AS INTEGER) AS Age, sum(l_quantity) AS Population
        FROM lineitem GROUP BY ALL""",
    "v_years": "SELECT DISTINCT Year FROM people",
    "v_policy": f"""
        SELECT Year, Policy, CAST(policy_rank AS INTEGER) AS policy_rank,
               CAST(CASE WHEN risen < cap THEN risen ELSE cap END AS INTEGER) AS age_months
        FROM (SELECT Year,
                     780 + 6 * (CASE WHEN Year > {POLICY_BASE_YEAR}
                                THEN (Year - {POLICY_BASE_YEAR}) // 2 ELSE 0 END) AS risen
              FROM v_years)
        CROSS JOIN (VALUES ('Proposed', 1, 840), ('Current', 2, 804), ('Age65', 3, 780))
                   AS p(Policy, policy_rank, cap)""",
    "v_rates": """
        SELECT series, Sex, Year, Age,
               CAST(count(*) FILTER (WHERE event) AS DOUBLE) AS events,
               sum(Population) AS exposure,
               CAST(count(*) FILTER (WHERE event) AS DOUBLE) / sum(Population) AS rate
        FROM people GROUP BY series, Sex, Year, Age""",
    "v_births": """
        SELECT series, Year, Age, sum(Population) AS births
        FROM people WHERE event AND Sex = 'Female' AND Age BETWEEN 15 AND 49
        GROUP BY ALL""",
    "v_file": """
        SELECT r_name AS Region, CAST(15 + l_partkey % 40 AS VARCHAR) AS Age,
               CAST(year(l_shipdate) AS INTEGER) AS Time,
               CASE l_returnflag WHEN 'R' THEN 'Births' WHEN 'N' THEN 'Female population'
                    ELSE 'Other' END AS Measure,
               sum(l_quantity) AS Value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey
        GROUP BY ALL""",
    "v_hist": """
        SELECT CAST(Year - 5 AS INTEGER) AS Year, Age,
               CAST(count(*) FILTER (WHERE event) AS DOUBLE) / sum(Population) AS rate,
               sum(Population) AS exposure
        FROM people WHERE Sex = 'Female' AND Age BETWEEN 15 AND 49
        GROUP BY Year, Age""",
    "v_folds": f"""
        SELECT CAST(i AS INTEGER) AS id,
               CAST(first_year - 1 + i AS INTEGER) AS train_from,
               CAST(first_year - 1 + i + {FOLD_TRAIN} - 1 AS INTEGER) AS train_to,
               CAST(first_year - 1 + i + {FOLD_TRAIN} AS INTEGER) AS base_year,
               CAST(first_year - 1 + i + {FOLD_TRAIN} AS INTEGER) AS test_from,
               CAST(first_year - 1 + i + {FOLD_TRAIN} + {FOLD_HORIZON} - 1 AS INTEGER) AS test_to
        FROM (SELECT min(Year) AS first_year,
                     unnest(range(1, max(Year) - min(Year) + 2 - {FOLD_TRAIN} - {FOLD_HORIZON})) AS i
              FROM v_years)""",
    "v_rolling_sim": """
        SELECT s.*, id FROM v_sim s JOIN v_folds ON Year BETWEEN test_from AND test_to""",
}

_NEEDS = {
    "v_pop": ["people"],
    "v_raw_pop": ["people"],
    "v_sim": ["people"],
    "v_years": ["people"],
    "v_policy": ["v_years"],
    "v_rates": ["people"],
    "v_births": ["people"],
    "v_hist": ["people"],
    "v_folds": ["v_years"],
    "v_rolling_sim": ["v_sim", "v_folds"],
}


def with_views(names: Sequence[str], body: str, recursive: bool = False) -> str:
    """``body`` behind a WITH clause that holds the views it names. Further CTEs may
    open ``body``: start it with ``, name AS (...)``."""
    ordered: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    clause = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{clause}\n{body}"
