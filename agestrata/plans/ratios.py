"""Ratio, summary and rolling-evaluation queries."""

from pyspark.sql import functions as F

from agestrata.operators import filters, folds, policy, ratio, summary
from agestrata.plans import views as V
from agestrata.plans.registry import query, r, rounded
from agestrata.plans.views import with_views


def ratio_sql(months: str) -> str:
    """Ratio of a group, with the pension age split into years and months."""
    f, k = f"({months} // 12)", f"({months} % 12)"
    at = f"coalesce(sum(Population) FILTER (WHERE Age = {f}), 0)"
    older = f"coalesce(sum(Population) FILTER (WHERE Age > {f}), 0)"
    younger = f"coalesce(sum(Population) FILTER (WHERE Age >= 15 AND Age < {f}), 0)"
    return f"(12 * {older} + (12 - {k}) * {at}) / nullif(12 * {younger} + {k} * {at}, 0)"


def _interval(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, {r('quantile_cont(OADR, 0.1)')} AS Lo, {r('quantile_cont(OADR, 0.9)')} AS Hi,
       {r('avg(OADR)')} AS OADR
FROM {source} GROUP BY {keys}"""


CURRENT = "(SELECT Year, age_months FROM v_policy WHERE Policy = 'Current')"
# A scheme that starts late, so that earlier years take its lowest age.
LATE = "(SELECT Year, age_months FROM v_policy WHERE Policy = 'Proposed' AND Year >= 1997)"
FILLED = f"""(SELECT p.*, coalesce(s.age_months, (SELECT min(age_months) FROM {LATE})) AS age_months
             FROM v_pop p LEFT JOIN {LATE} s ON p.Year = s.Year)"""


def _late_scheme(spark, sf_dir):
    return filters.policy_slice(V.policy(spark, sf_dir), "Proposed", 1997)


def _current(spark, sf_dir):
    return filters.policy_slice(V.policy(spark, sf_dir), "Current")


@query(with_views(["v_policy"], "SELECT * FROM v_policy"))
def policy_schedule(spark, sf_dir):
    return V.policy(spark, sf_dir)


@query(with_views(["v_policy"], "SELECT * FROM v_policy"))
def order_by_policy(spark, sf_dir):
    return policy.order_by_policy(V.policy(spark, sf_dir))


@query(with_views(["v_policy"], "SELECT Year, age_months FROM v_policy WHERE Policy = 'Proposed' AND Year >= 1997"))
def policy_slice(spark, sf_dir):
    return _late_scheme(spark, sf_dir)


@query(with_views(["v_pop", "v_policy"], f"SELECT Year, Sex, Age, Population, age_months FROM {FILLED}"))
def attach_scheme(spark, sf_dir):
    return policy.attach_scheme(V.pop(spark, sf_dir), _late_scheme(spark, sf_dir))


@query(
    with_views(
        ["v_pop", "v_policy"],
        f""", aged AS {FILLED}
SELECT Year, Sex, Age, age_months, part."Group", {r('Population * part.share / 12.0')} AS Population
FROM (
  SELECT *, unnest([
    {{'Group': 'Child', 'share': CASE WHEN Age < 15 THEN 12 - older ELSE 0 END}},
    {{'Group': 'Workers', 'share': CASE WHEN Age < 15 THEN 0 ELSE 12 - older END}},
    {{'Group': 'Pension', 'share': older}}]) AS part
  FROM (SELECT *, least(12, greatest(0, 12 * Age + 12 - age_months)) AS older FROM aged))
WHERE part.share > 0""",
    )
)
def split_partial_age(spark, sf_dir):
    aged = policy.attach_scheme(V.pop(spark, sf_dir), _late_scheme(spark, sf_dir))
    return rounded(ratio.split_partial_age(aged), "Population")


@query(
    with_views(
        ["v_pop", "v_policy"],
        f""", aged AS {FILLED},
split AS (
  SELECT Year, Population * (12 - least(12, greatest(0, 12 * Age + 12 - age_months))) / 12.0 AS younger,
         Population * least(12, greatest(0, 12 * Age + 12 - age_months)) / 12.0 AS older, Age
  FROM aged)
SELECT Year, {r('sum(younger) FILTER (WHERE Age < 15)')} AS Child,
       {r('sum(younger) FILTER (WHERE Age >= 15)')} AS Workers, {r('sum(older)')} AS Pension
FROM split GROUP BY Year""",
    )
)
def group_population(spark, sf_dir):
    aged = policy.attach_scheme(V.pop(spark, sf_dir), _late_scheme(spark, sf_dir))
    return rounded(ratio.group_population(aged), "Child", "Workers", "Pension")


@query(
    with_views(
        ["v_pop", "v_policy"],
        f"SELECT Year, {ratio_sql('age_months')} AS OADR FROM {FILLED} GROUP BY Year, age_months",
    )
)
def oadr_history(spark, sf_dir):
    return ratio.oadr(V.pop(spark, sf_dir), _late_scheme(spark, sf_dir))


@query(
    with_views(
        ["v_rates", "v_policy"],
        f"""
SELECT series, p.Year, {ratio_sql('age_months')} AS OADR
FROM (SELECT series, Year, Age, exposure AS Population FROM v_rates) p
     JOIN {CURRENT} s ON p.Year = s.Year
GROUP BY series, p.Year, age_months""",
    )
)
def oadr_by_series(spark, sf_dir):
    """Many populations in one call."""
    pop = V.pop(spark, sf_dir, keys=["series"])
    return ratio.oadr(pop, _current(spark, sf_dir), ["series"], fill=False)


# One pension age per sex: women five years earlier.
@query(
    with_views(
        ["v_pop", "v_policy"],
        f""", aged AS (
  SELECT p.*, CASE Sex WHEN 'Male' THEN age_months ELSE age_months - 60 END AS age_months
  FROM v_pop p JOIN {CURRENT} s ON p.Year = s.Year),
split AS (
  SELECT Year, Age, Population * least(12, greatest(0, 12 * Age + 12 - age_months)) AS older,
         Population * (12 - least(12, greatest(0, 12 * Age + 12 - age_months))) AS younger
  FROM aged)
SELECT Year, sum(older) / sum(younger) FILTER (WHERE Age >= 15) AS OADR
FROM split GROUP BY Year""",
    )
)
def oadr_scheme_by_sex(spark, sf_dir):
    current = _current(spark, sf_dir)
    ages = F.explode(
        F.create_map(
            F.lit("Male"), F.col("age_months"), F.lit("Female"), F.col("age_months") - 60
        )
    ).alias("Sex", "age_months")
    scheme = current.select("Year", ages)
    return ratio.oadr(V.pop(spark, sf_dir), scheme, on=["Year", "Sex"])


RATIOS_CURRENT = f"""(SELECT Rep, s.Year, {ratio_sql('age_months')} AS OADR
      FROM v_sim s JOIN {CURRENT} p ON s.Year = p.Year GROUP BY Rep, s.Year, age_months)"""


@query(with_views(["v_sim", "v_policy"], _interval("Year", RATIOS_CURRENT)))
def oadr_sim(spark, sf_dir):
    out = ratio.oadr_sim(V.sim(spark, sf_dir), _current(spark, sf_dir), fill=False)
    return rounded(out, "Lo", "Hi", "OADR")


@query(
    with_views(
        ["v_sim", "v_policy"],
        f"""
SELECT Year, {r('quantile_cont(OADR, 0.025)')} AS Lo, {r('quantile_cont(OADR, 0.975)')} AS Hi,
       {r('avg(OADR)')} AS OADR
FROM {RATIOS_CURRENT} GROUP BY Year""",
    )
)
def interval_summary(spark, sf_dir):
    ratios = ratio.oadr(V.sim(spark, sf_dir), _current(spark, sf_dir), ["Rep"], fill=False)
    return rounded(ratio.interval_summary(ratios, ["Year"], level=95), "Lo", "Hi", "OADR")


BY_POLICY = f"""(SELECT Policy, policy_rank, Rep, s.Year, {ratio_sql('age_months')} AS OADR
      FROM v_sim s JOIN v_policy p ON s.Year = p.Year
      GROUP BY Policy, policy_rank, Rep, s.Year, age_months)"""


@query(with_views(["v_sim", "v_policy"], _interval("Policy, policy_rank, Year", BY_POLICY)))
def oadr_by_policy(spark, sf_dir):
    out = ratio.oadr_by_policy(V.sim(spark, sf_dir), V.policy(spark, sf_dir), fill=False)
    return rounded(out, "Lo", "Hi", "OADR")


# Policies known from 1997 on: earlier years take each policy's lowest age.
@query(
    with_views(
        ["v_sim", "v_policy"],
        f""", late AS (SELECT * FROM v_policy WHERE Year >= 1997),
complete AS (
  SELECT y.Year, l.Policy, l.policy_rank,
         coalesce(p.age_months, l.lowest) AS age_months
  FROM v_years y
       CROSS JOIN (SELECT Policy, policy_rank, min(age_months) AS lowest FROM late GROUP BY ALL) l
       LEFT JOIN late p ON p.Year = y.Year AND p.Policy = l.Policy),
ratios AS (
  SELECT Policy, policy_rank, Rep, s.Year, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN complete p ON s.Year = p.Year
  GROUP BY Policy, policy_rank, Rep, s.Year, age_months)
{_interval("Policy, policy_rank, Year", "ratios")}""",
    )
)
def oadr_by_policy_filled(spark, sf_dir):
    late = filters.restrict_years(V.policy(spark, sf_dir), 1997)
    out = ratio.oadr_by_policy(V.sim(spark, sf_dir), late)
    return rounded(out, "Lo", "Hi", "OADR")


# --- summaries -----------------------------------------------------------------


@query(
    with_views(
        ["v_sim"],
        f"""
SELECT Sex, Age, Year, {r('avg(Population)')} AS Mean,
       {r('quantile_cont(Population, 0.1)')} AS Lower, {r('quantile_cont(Population, 0.9)')} AS Upper
FROM v_sim GROUP BY Sex, Age, Year""",
    )
)
def age_profile_summary(spark, sf_dir):
    return rounded(summary.age_profile_summary(V.sim(spark, sf_dir)), "Mean", "Lower", "Upper")


# A replicate per order: thousands of them in a group even in the small tables, and ever
# more with the data. Whole quantities of few items make many ties.
@query(
    with_views(
        ["v_sim_orders"],
        f"""
SELECT Sex, Year, {r('avg(Population)')} AS Mean, {r('quantile_cont(Population, 0.1)')} AS Lower,
       {r('quantile_cont(Population, 0.9)')} AS Upper
FROM v_sim_orders GROUP BY Sex, Year""",
    )
)
def age_profile_summary_large_groups(spark, sf_dir):
    sim = V.sim(spark, sf_dir, F.col("l_orderkey"))
    return rounded(summary.age_profile_summary(sim, ["Sex", "Year"]), "Mean", "Lower", "Upper")


TOTALS = "(SELECT Rep, Sex, Year, sum(Population) / 1000.0 AS P FROM v_sim GROUP BY ALL)"
TOTAL_SUMMARY = f"""
SELECT Sex, Year, {r('avg(P)')} AS Mean, {r('median(P)')} AS Median,
       {r('quantile_cont(P, 0.025)')} AS Lo95, {r('quantile_cont(P, 0.975)')} AS Up95,
       {r('quantile_cont(P, 0.1)')} AS Lo80, {r('quantile_cont(P, 0.9)')} AS Up80
FROM {TOTALS} GROUP BY Sex, Year"""
_TOTAL_COLUMNS = ["Mean", "Median", "Lo95", "Up95", "Lo80", "Up80"]


@query(with_views(["v_sim"], TOTAL_SUMMARY))
def total_population_summary(spark, sf_dir):
    return rounded(summary.total_population_summary(V.sim(spark, sf_dir)), *_TOTAL_COLUMNS)


@query(with_views(["v_sim_orders"], TOTAL_SUMMARY.replace("FROM v_sim ", "FROM v_sim_orders ")))
def total_population_summary_large_groups(spark, sf_dir):
    sim = V.sim(spark, sf_dir, F.col("l_orderkey"))
    return rounded(summary.total_population_summary(sim), *_TOTAL_COLUMNS)


@query(
    with_views(
        ["v_sim_orders", "v_policy"],
        f""", ratios AS (
  SELECT Rep, s.Year, nullif({ratio_sql('age_months')}, 0) AS OADR
  FROM v_sim_orders s JOIN {CURRENT} c ON s.Year = c.Year GROUP BY Rep, s.Year, age_months)
SELECT Year, {r('quantile_cont(OADR, 0.1)')} AS Lo, {r('quantile_cont(OADR, 0.9)')} AS Hi, {r('avg(OADR)')} AS OADR
FROM ratios GROUP BY Year""",
    )
)
def oadr_sim_large_groups(spark, sf_dir):
    sim = V.sim(spark, sf_dir, F.col("l_orderkey"))
    out = ratio.oadr_sim(sim, _current(spark, sf_dir), fill=False, na_rm=True)
    return rounded(out, "Lo", "Hi", "OADR")


@query(
    with_views(
        ["v_pop"], "SELECT Sex, Year, sum(Population) / 1000.0 AS Population FROM v_pop GROUP BY Sex, Year"
    )
)
def total_population(spark, sf_dir):
    return summary.total_population(V.pop(spark, sf_dir))


@query(
    with_views(
        ["v_pop", "v_sim"],
        f"""
SELECT Sex, Year, {r('sum(Population) / 1000.0')} AS Population, 'history' AS Part,
       CAST(NULL AS DOUBLE) AS Mean, CAST(NULL AS DOUBLE) AS Median, CAST(NULL AS DOUBLE) AS Lo95,
       CAST(NULL AS DOUBLE) AS Up95, CAST(NULL AS DOUBLE) AS Lo80, CAST(NULL AS DOUBLE) AS Up80
FROM v_pop GROUP BY Sex, Year
UNION ALL BY NAME
SELECT *, CAST(NULL AS DOUBLE) AS Population, 'forecast' AS Part FROM ({TOTAL_SUMMARY})""",
    )
)
def total_population_table(spark, sf_dir):
    out = summary.total_population_table(V.pop(spark, sf_dir), V.sim(spark, sf_dir))
    return rounded(out, "Population", *_TOTAL_COLUMNS)


@query(
    with_views(
        ["v_pop", "v_sim"],
        f""", future AS (SELECT Rep, CAST(Year + 4 AS INTEGER) AS Year, Sex, Age, Population FROM v_sim)
SELECT Year, Sex, Age, Population, CAST(NULL AS DOUBLE) AS Mean, CAST(NULL AS DOUBLE) AS Lower,
       CAST(NULL AS DOUBLE) AS Upper
FROM v_pop WHERE Year = (SELECT max(Year) FROM v_pop)
UNION ALL BY NAME
SELECT Year, Sex, Age, CAST(NULL AS DOUBLE) AS Population, {r('avg(Population)')} AS Mean,
       {r('quantile_cont(Population, 0.1)')} AS Lower, {r('quantile_cont(Population, 0.9)')} AS Upper
FROM future WHERE Year = (SELECT max(Year) + 2 FROM v_pop) GROUP BY Sex, Age, Year""",
    )
)
def pyramid_table(spark, sf_dir):
    future = V.sim(spark, sf_dir).withColumn("Year", (F.col("Year") + 4).cast("int"))
    out = summary.pyramid_table(V.pop(spark, sf_dir), future, ahead=2)
    return rounded(out, "Mean", "Lower", "Upper")


@query(
    with_views(
        ["v_policy"],
        """SELECT min(age_months) AS min_age_months, max(age_months) AS max_age_months,
                  min(Year) AS min_Year, max(Year) AS max_Year FROM v_policy""",
    )
)
def column_range(spark, sf_dir):
    return summary.column_range(V.policy(spark, sf_dir), ["age_months", "Year"])


# --- rolling evaluation --------------------------------------------------------

ROLLING = f""", ratios AS (
  SELECT id, Rep, s.Year, {ratio_sql('age_months')} AS OADR
  FROM v_rolling_sim s JOIN {CURRENT} p ON s.Year = p.Year
  GROUP BY id, Rep, s.Year, age_months),
rolling AS (
  SELECT id, Year, quantile_cont(OADR, 0.1) AS Lo, quantile_cont(OADR, 0.9) AS Hi,
         avg(OADR) AS OADR
  FROM ratios GROUP BY id, Year),
actual AS (
  SELECT p.Year, {ratio_sql('age_months')} AS Actual
  FROM v_pop p JOIN {CURRENT} s ON p.Year = s.Year GROUP BY p.Year, age_months),
errors AS (
  SELECT r.id, r.Year, row_number() OVER (PARTITION BY id ORDER BY r.Year) AS h,
         OADR AS Forecast, Actual, Actual - OADR AS error
  FROM rolling r LEFT JOIN actual a ON r.Year = a.Year)
"""
_ROLLING_VIEWS = ["v_rolling_sim", "v_policy", "v_pop"]


def _rolling(spark, sf_dir):
    return ratio.oadr_rolling(V.rolling_sim(spark, sf_dir), _current(spark, sf_dir), fill=False)


def _actual(spark, sf_dir):
    return ratio.oadr(V.pop(spark, sf_dir), _current(spark, sf_dir), fill=False)


def _errors(spark, sf_dir):
    return folds.backtest_errors(_rolling(spark, sf_dir), _actual(spark, sf_dir))


@query(with_views(["v_folds"], "SELECT * FROM v_folds"))
def fold_table(spark, sf_dir):
    return V.folds(spark, sf_dir)


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING + f"SELECT id, Year, {r('Lo')} AS Lo, {r('Hi')} AS Hi, {r('OADR')} AS OADR FROM rolling",
    )
)
def oadr_rolling(spark, sf_dir):
    return rounded(_rolling(spark, sf_dir), "Lo", "Hi", "OADR")


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING + f"SELECT id, Year, CAST(h AS INTEGER) AS h, {r('Forecast')} AS OADR FROM errors",
    )
)
def horizon_number(spark, sf_dir):
    numbered = folds.horizon_number(_rolling(spark, sf_dir))
    return rounded(numbered.select("id", "Year", "h", "OADR"), "OADR")


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING
        + f"""SELECT id, Year, CAST(h AS INTEGER) AS h, {r('Forecast')} AS Forecast,
                     {r('Actual')} AS Actual, {r('error')} AS error FROM errors""",
    )
)
def attach_actual(spark, sf_dir):
    return rounded(_errors(spark, sf_dir), "Forecast", "Actual", "error")


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING
        + f"SELECT CAST(h AS INTEGER) AS h, {r('sqrt(avg(error * error))')} AS RMSE FROM errors GROUP BY h",
    )
)
def backtest_rmse(spark, sf_dir):
    return rounded(folds.backtest_rmse(_rolling(spark, sf_dir), _actual(spark, sf_dir)), "RMSE")


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING
        + f"SELECT id, {r('sqrt(avg(error * error))')} AS RMSE FROM errors GROUP BY id",
    )
)
def horizon_rmse(spark, sf_dir):
    """Per origin instead of per horizon."""
    return rounded(folds.horizon_rmse(_errors(spark, sf_dir), ["id"]), "RMSE")


@query(
    with_views(
        _ROLLING_VIEWS,
        ROLLING + f"SELECT CAST(h AS INTEGER) AS h, {r('avg(abs(error))')} AS MAE FROM errors GROUP BY h",
    )
)
def horizon_mae(spark, sf_dir):
    return rounded(folds.horizon_mae(_errors(spark, sf_dir)), "MAE")
