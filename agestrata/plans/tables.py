"""Filter, reshape, source and join queries."""

import uuid

from pyspark.sql import functions as F

from agestrata.operators import accounting, curves, fertility, filters, reshape
from agestrata.plans import views as V
from agestrata.plans.registry import query, r, results_folder, rounded
from agestrata.plans.views import FERTILITY_REGION, with_views
from agestrata.schema import FERTILITY_CSV
from agestrata.sources import tables

# --- filters --------------------------------------------------------------------


@query(with_views(["v_raw_pop"], "SELECT * FROM v_raw_pop WHERE Age BETWEEN 0 AND 100"))
def restrict_ages(spark, sf_dir):
    return filters.restrict_ages(V.pop(spark, sf_dir, ages=120))


@query(
    with_views(
        ["v_raw_pop"],
        """SELECT Year, Sex, CAST(least(Age, 100) AS INTEGER) AS Age, sum(Population) AS Population
           FROM v_raw_pop GROUP BY Year, Sex, least(Age, 100)""",
    )
)
def collapse_open_age(spark, sf_dir):
    return filters.collapse_open_age(V.pop(spark, sf_dir, ages=120))


@query(with_views(["v_pop"], "SELECT * FROM v_pop WHERE Year BETWEEN 1997 AND 2100"))
def restrict_years(spark, sf_dir):
    return filters.restrict_years(V.pop(spark, sf_dir), 1997, 2100)


@query(
    with_views(
        ["v_sim"],
        """SELECT Rep, CAST(Year + 1 AS INTEGER) AS Year, Sex, Age, Population
           FROM v_sim WHERE Year + 1 <= 2000""",
    )
)
def shift_and_cap_years(spark, sf_dir):
    return filters.shift_and_cap_years(V.sim(spark, sf_dir), 1, 2000)


@query(with_views(["v_pop"], "SELECT * FROM v_pop WHERE Year = (SELECT max(Year) FROM v_pop)"))
def latest_year(spark, sf_dir):
    return filters.latest_year(V.pop(spark, sf_dir))


@query(
    with_views(
        ["v_pop", "v_sim"],
        """SELECT Rep, CAST(Year + 4 AS INTEGER) AS Year, Sex, Age, Population
           FROM v_sim WHERE Year + 4 = (SELECT max(Year) + 1 FROM v_pop)""",
    )
)
def at_horizon(spark, sf_dir):
    future = filters.shift_and_cap_years(V.sim(spark, sf_dir), 4, 9999)
    return filters.at_horizon(future, V.pop(spark, sf_dir), ahead=1)


@query(with_views(["v_pop"], "SELECT Year, Sex, Age, Population * 0.001 AS Population FROM v_pop"))
def scale_measure(spark, sf_dir):
    return filters.scale_measure(V.pop(spark, sf_dir), 0.001)


SLICE = f"""(SELECT Time AS Year, CAST(Age AS INTEGER) AS Age, Measure, Value FROM v_file
    WHERE Region = '{FERTILITY_REGION}' AND CAST(Age AS INTEGER) BETWEEN 15 AND 49)"""


def _slice(spark, sf_dir):
    return filters.fertility_slice(V.fertility_file(spark, sf_dir), FERTILITY_REGION)


@query(with_views(["v_file"], f"SELECT * FROM {SLICE}"))
def fertility_slice(spark, sf_dir):
    return _slice(spark, sf_dir)


@query(
    with_views(
        ["v_file"], f"SELECT Year, Age, Value * 1000.0 AS Value FROM {SLICE} WHERE Measure = 'Births'"
    )
)
def measure_slice(spark, sf_dir):
    return filters.measure_slice(_slice(spark, sf_dir), "Births", 1000)


# --- reshape --------------------------------------------------------------------


@query(with_views(["v_pop"], "SELECT * FROM v_pop"))
def union_sexes(spark, sf_dir):
    pop = V.pop(spark, sf_dir)
    parts = [pop.where(F.col("Sex") == s).drop("Sex") for s in ("Male", "Female")]
    return reshape.union_sexes(*parts)


@query(
    with_views(
        ["v_pop", "v_rates"],
        """SELECT Year, Sex, Age, Population, CAST(NULL AS VARCHAR) AS series,
                  CAST(NULL AS DOUBLE) AS rate FROM v_pop
           UNION ALL BY NAME
           SELECT Year, Sex, Age, CAST(NULL AS DOUBLE) AS Population, series, rate FROM v_rates""",
    )
)
def union_missing(spark, sf_dir):
    rates = V.rates(spark, sf_dir).select("Year", "Sex", "Age", "series", "rate")
    return reshape.union_missing(V.pop(spark, sf_dir), rates)


@query(
    with_views(
        ["v_pop"],
        """SELECT *, 'All' AS Series FROM v_pop
           UNION ALL SELECT *, 'Recent' FROM v_pop WHERE Year >= 1999""",
    )
)
def union_labelled(spark, sf_dir):
    pop = V.pop(spark, sf_dir)
    return reshape.union_labelled({"All": pop, "Recent": filters.restrict_years(pop, 1999)}, "Series")


@query(
    with_views(
        ["v_hist"],
        """, new AS (SELECT Year + 3 AS Year, Age, rate, exposure FROM v_hist)
SELECT * FROM v_hist WHERE Year < (SELECT min(Year) FROM new) UNION ALL SELECT * FROM new""",
    )
)
def append_after(spark, sf_dir):
    history = V.fertility_history(spark, sf_dir)
    later = history.withColumn("Year", (F.col("Year") + 3).cast("int"))
    return reshape.append_after(history, later)


YEARS = list(range(1995, 2002))
WIDE = ", ".join(f'sum(Population) FILTER (WHERE Year = {y}) AS "{y}"' for y in YEARS)


def _wide(spark, sf_dir):
    return reshape.long_to_wide(V.pop(spark, sf_dir), ["Sex", "Age"], "Year", "Population", YEARS)


@query(with_views(["v_pop"], f"SELECT Sex, Age, {WIDE} FROM v_pop GROUP BY Sex, Age"))
def long_to_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(
    with_views(
        ["v_pop"],
        """SELECT Sex, Age, Year, p.Population FROM (SELECT DISTINCT Sex, Age FROM v_pop)
             CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS Year)
             LEFT JOIN v_pop p USING (Sex, Age, Year)""",
    )
)
def year_columns_to_long(spark, sf_dir):
    return reshape.year_columns_to_long(_wide(spark, sf_dir), ["Sex", "Age"], YEARS)


@query(
    with_views(
        ["v_policy"],
        "SELECT Year, Policy, CAST(age_months AS DOUBLE) AS age_months FROM v_policy",
    )
)
def wide_to_long(spark, sf_dir):
    names = ["Proposed", "Current", "Age65"]
    wide = reshape.long_to_wide(V.policy(spark, sf_dir), ["Year"], "Policy", "age_months", names)
    return reshape.wide_to_long(wide, ["Year"], names, "Policy", "age_months")


# Paths as arrays over years per replicate and age, both sexes in a row; a year
# without people is a zero in its array.
def _arrays(spark, sf_dir):
    def path(sex):
        return F.array(
            *[
                F.coalesce(
                    F.sum(F.when((F.col("Sex") == sex) & (F.col("Year") == y), F.col("Population"))),
                    F.lit(0.0),
                )
                for y in YEARS
            ]
        ).alias(sex.lower())

    return V.sim(spark, sf_dir).groupBy("Rep", "Age").agg(path("Male"), path("Female"))


FULL = """, cells AS (
  SELECT Rep, Age, Sex, Year FROM (SELECT DISTINCT Rep, Age FROM v_sim)
    CROSS JOIN (VALUES ('Male'), ('Female')) AS s(Sex)
    CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS Year)),
paths AS (
  SELECT Rep, Age, Sex, Year, coalesce(Population, 0.0) AS Population
  FROM cells LEFT JOIN v_sim USING (Rep, Age, Sex, Year))
"""


@query(
    with_views(
        ["v_sim"], FULL + "SELECT Rep, Age, Sex, Year, Population FROM paths"
    )
)
def array_to_long(spark, sf_dir):
    arrays = _arrays(spark, sf_dir)
    return reshape.union_sexes(
        *[reshape.array_to_long(arrays, ["Rep", "Age"], c, YEARS[0]) for c in ("male", "female")]
    )


@query(
    with_views(
        ["v_sim"],
        FULL
        + """SELECT Rep, CAST(Year + 1 AS INTEGER) AS Year, Sex, Age,
                    Population / 1000.0 AS Population
             FROM paths WHERE Year + 1 <= 2000""",
    )
)
def simulation_from_arrays(spark, sf_dir):
    return reshape.simulation_from_arrays(_arrays(spark, sf_dir), YEARS[0], 1, 2000)


# --- sources --------------------------------------------------------------------


def _stored(df, name, form="parquet"):
    """A path holding ``df``, fresh per call."""
    path = f"{results_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if form == "csv" else df.write
    writer.format(form).save(path)
    return path


@query(with_views(["v_file"], "SELECT * FROM v_file"))
def read_fertility_csv(spark, sf_dir):
    columns = ["Region", "Age", "Time", "Measure", "Value"]
    path = _stored(V.fertility_file(spark, sf_dir).select(*columns), "fertility", "csv")
    return tables.read_fertility_csv(spark, path)


# A line of a CSV in every few is spoiled, by a rule of its own columns: its time, its value,
# the sign of its value, or by being there twice.
SPOILED = """SELECT Region, Age, Measure, CAST(Time AS VARCHAR) AS Time, Value, CAST(Age AS INTEGER) AS a FROM v_file"""


@query(
    with_views(
        ["v_file"],
        f"""SELECT Region, Age, CASE WHEN a % 7 = 1 THEN NULL ELSE CAST(Time AS INTEGER) END AS Time, Measure,
                   CASE WHEN a % 7 = 2 THEN NULL WHEN a % 7 = 3 THEN -1.0 - Value ELSE Value END AS Value,
                   CASE a % 7 WHEN 1 THEN 'Time is not int' WHEN 2 THEN 'Value is not double'
                     WHEN 3 THEN 'Value is out of range' WHEN 4 THEN 'key comes twice' ELSE '' END AS problem
            FROM ({SPOILED}), range(1, 3) AS t(copy) WHERE copy = 1 OR a % 7 = 4""",
    )
)
def read_fertility_checked(spark, sf_dir):
    a = F.col("Age").cast("int") % 7
    file = V.fertility_file(spark, sf_dir).select(
        "Region", "Age", F.when(a == 1, F.concat(F.lit("y"), "Time")).otherwise(F.col("Time").cast("string")).alias("Time"),
        "Measure",
        F.when(a == 2, "n/a").when(a == 3, (F.lit(-1.0) - F.col("Value")).cast("string"))
        .otherwise(F.col("Value").cast("string")).alias("Value"),
        F.explode(F.when(a == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    path = _stored(file.drop("_copy"), "fertility-spoiled", "csv")
    checked = tables.read_checked(
        spark, path, FERTILITY_CSV, keys=["Region", "Age", "Time", "Measure"], ranges={"Value": (0.0, 1e12)}
    )
    good = tables.accepted(checked, 10**9).withColumn("problem", F.lit(""))
    return good.unionByName(
        tables.quarantined(checked).withColumn("problem", F.concat_ws("; ", "problems")).drop("problems")
    )


@query(with_views(["v_pop"], "SELECT * FROM v_pop"))
def read_population(spark, sf_dir):
    return tables.read_population(spark, _stored(V.pop(spark, sf_dir), "population"))


@query(with_views(["v_rates"], "SELECT series, Sex, Year, Age, rate, exposure FROM v_rates"))
def read_rates(spark, sf_dir):
    return tables.read_rates(spark, _stored(V.rates(spark, sf_dir), "rates"))


@query(with_views(["v_hist"], "SELECT Year, Age, rate, exposure FROM v_hist"))
def read_fertility_history(spark, sf_dir):
    return tables.read_fertility_history(spark, _stored(V.fertility_history(spark, sf_dir), "history"))


@query(with_views(["v_sim"], "SELECT * FROM v_sim"))
def save_and_load_result(spark, sf_dir):
    name, folder = f"sim-{uuid.uuid4().hex}", results_folder(spark)
    tables.save_result(V.sim(spark, sf_dir), name, folder, partition_by=["Year"])
    return tables.load_result(spark, name, folder)


@query(with_views(["v_sim"], "SELECT * FROM v_sim"))
def read_simulation(spark, sf_dir):
    return tables.read_simulation(spark, _stored(V.sim(spark, sf_dir), "simulation"))


# --- fertility --------------------------------------------------------------------

CELLS = f"""(SELECT Year, Age, 1000.0 * sum(Value) FILTER (WHERE Measure = 'Births') AS births,
       sum(Value) FILTER (WHERE Measure = 'Female population') AS females
FROM {SLICE} WHERE Measure <> 'Other' GROUP BY Year, Age)"""


@query(with_views(["v_file"], f"SELECT * FROM {CELLS}"))
def births_and_pop(spark, sf_dir):
    return fertility.births_and_pop(_slice(spark, sf_dir))


@query(
    with_views(
        ["v_file"],
        f"SELECT Year, Age, births AS events, females AS exposure, births / females AS rate "
        f"FROM {CELLS} WHERE births IS NOT NULL AND females IS NOT NULL",
    )
)
def rate_from_counts(spark, sf_dir):
    sliced = _slice(spark, sf_dir)
    births = filters.measure_slice(sliced, "Births", 1000).withColumnRenamed("Value", "events")
    females = filters.measure_slice(sliced, "Female population").withColumnRenamed("Value", "exposure")
    return accounting.rate_from_counts(births, females)


@query(
    with_views(
        ["v_file", "v_hist"],
        f"""
SELECT Year, Age, {r('births / females')} AS rate, females AS exposure FROM {CELLS}
UNION ALL
SELECT Year, Age, {r('rate')}, exposure FROM v_hist WHERE Year < (SELECT min(Year) FROM {CELLS})""",
    )
)
def merge_fertility(spark, sf_dir):
    merged = fertility.merge_fertility(
        V.fertility_history(spark, sf_dir), V.fertility_file(spark, sf_dir), FERTILITY_REGION
    )
    return rounded(merged, "rate")


# --- pairing ----------------------------------------------------------------------


@query(
    with_views(
        ["v_pop"],
        """SELECT Year, Age, max(Population) FILTER (WHERE Sex = 'Male') AS Male,
                  max(Population) FILTER (WHERE Sex = 'Female') AS Female
           FROM v_pop GROUP BY Year, Age""",
    )
)
def pair_sexes(spark, sf_dir):
    return curves.pair_sexes(V.pop(spark, sf_dir), value="Population")


@query(
    with_views(
        ["v_pop"],
        """SELECT a.*, b.Population AS next_population FROM v_pop a
           JOIN v_pop b ON a.Sex = b.Sex AND b.Year = a.Year + 1 AND b.Age = a.Age + 1""",
    )
)
def cohort_join(spark, sf_dir):
    return accounting.cohort_join(V.pop(spark, sf_dir))
