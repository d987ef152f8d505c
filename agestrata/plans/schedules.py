"""Schedule-search queries: target 0.60 from age 65, years 1995 to 2001."""

from agestrata.operators import ratio, report, schedule
from agestrata.operators.filters import policy_slice
from agestrata.plans import views as V
from agestrata.plans.ratios import ratio_sql
from agestrata.plans.registry import query, r, rounded
from agestrata.plans.views import with_views

START, FIRST, LAST, TARGET = 780, 1995, 2001, 0.60

# Every replicate against every month the schedule could have reached.
GRID = f""", candidates AS (
  SELECT Year, CAST(unnest(range({START}, {START} + 12 * (Year - {FIRST - 1}) + 1)) AS INTEGER) AS age_months
  FROM v_years),
ratios AS (
  SELECT Rep, s.Year, age_months, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN candidates c ON s.Year = c.Year GROUP BY Rep, s.Year, age_months),
grid AS (
  SELECT Year, age_months, quantile_cont(OADR, 0.1) AS Lo, quantile_cont(OADR, 0.9) AS Hi,
         avg(OADR) AS OADR
  FROM ratios GROUP BY Year, age_months),
need AS (
  SELECT Year, min(age_months) FILTER (WHERE Lo <= {TARGET}) AS lower,
         min(age_months) FILTER (WHERE OADR <= {TARGET}) AS optimal,
         min(age_months) FILTER (WHERE Hi <= {TARGET}) AS upper
  FROM grid GROUP BY Year)"""

# One month's step at a time is bounded by the cap; a year is one step here.
BAND = (
    GRID
    + f""", band AS (
  SELECT CAST({FIRST - 1} AS INTEGER) AS Year, CAST({START} AS INTEGER) AS lower,
         CAST({START} AS INTEGER) AS optimal, CAST({START} AS INTEGER) AS upper
  UNION ALL
  SELECT n.Year,
         least(b.lower + 12, greatest(b.lower, coalesce(n.lower, b.lower + 12))),
         least(b.optimal + 12, greatest(b.optimal, coalesce(n.optimal, b.optimal + 12))),
         least(b.upper + 12, greatest(b.upper, coalesce(n.upper, b.upper + 12)))
  FROM band b JOIN need n ON n.Year = b.Year + 1),
schedule AS (SELECT * FROM band WHERE Year >= {FIRST})"""
)
_VIEWS = ["v_sim", "v_years", "v_policy"]


def _ratios(spark, sf_dir):
    return schedule.candidate_ratios(V.sim(spark, sf_dir), START, FIRST, LAST)


def _band(spark, sf_dir):
    return schedule.schedule_band(V.sim(spark, sf_dir), START, FIRST, LAST, TARGET)


@query(
    with_views(
        _VIEWS,
        GRID
        + f"SELECT Year, age_months, {r('Lo')} AS Lo, {r('Hi')} AS Hi, {r('OADR')} AS OADR FROM grid",
    )
)
def oadr_grid(spark, sf_dir):
    return rounded(schedule.oadr_grid(_ratios(spark, sf_dir)), "Lo", "Hi", "OADR")


@query(with_views(_VIEWS, GRID + "SELECT Year, optimal AS need FROM need"))
def need_month(spark, sf_dir):
    grid = schedule.oadr_grid(_ratios(spark, sf_dir))
    return schedule.need_month(grid, TARGET, "OADR")


@query(with_views(_VIEWS, GRID + "SELECT Year, lower, optimal, upper FROM need"))
def need_months(spark, sf_dir):
    return schedule.need_months(_ratios(spark, sf_dir), TARGET)


@query(with_views(_VIEWS, BAND + "SELECT Year, optimal AS age_months FROM schedule", recursive=True))
def capped_schedule(spark, sf_dir):
    need = schedule.need_months(_ratios(spark, sf_dir), TARGET)
    return schedule.capped_schedule(need, START, FIRST, LAST, columns={"age_months": "optimal"})


@query(with_views(_VIEWS, BAND + "SELECT * FROM schedule", recursive=True))
def schedule_band(spark, sf_dir):
    return _band(spark, sf_dir)


@query(
    with_views(
        _VIEWS,
        BAND
        + f"""SELECT Year, {r('optimal / 12.0')} AS mean, {r('lower / 12.0')} AS lower,
                     {r('upper / 12.0')} AS upper, CAST(80 AS DOUBLE) AS level FROM schedule""",
        recursive=True,
    )
)
def schedule_forecast_table(spark, sf_dir):
    table = schedule.schedule_forecast_table(_band(spark, sf_dir))
    return rounded(table, "mean", "lower", "upper")


@query(
    with_views(
        _VIEWS,
        BAND
        + """SELECT Year, 'Optimal' AS Policy, CAST(1 AS INTEGER) AS policy_rank,
                    optimal AS age_months FROM schedule WHERE Year >= 1997
             UNION ALL BY NAME
             SELECT Year, Policy, CAST(policy_rank + 1 AS INTEGER) AS policy_rank, age_months
             FROM v_policy WHERE Year >= 1997""",
        recursive=True,
    )
)
def compare_schemes(spark, sf_dir):
    return schedule.compare_schemes(V.policy(spark, sf_dir), _band(spark, sf_dir), 1997)


@query(
    with_views(
        _VIEWS,
        BAND
        + f""", named AS (
  SELECT Year, 'Optimal' AS Policy, 1 AS policy_rank, optimal AS age_months FROM schedule
  UNION ALL SELECT Year, 'Lower boundary', 2, lower FROM schedule
  UNION ALL SELECT Year, 'Upper boundary', 3, upper FROM schedule),
under AS (
  SELECT Policy, policy_rank, Rep, s.Year, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN named p ON s.Year = p.Year
  GROUP BY Policy, policy_rank, Rep, s.Year, age_months)
SELECT Policy, policy_rank, Year, {r('quantile_cont(OADR, 0.1)')} AS Lo,
       {r('quantile_cont(OADR, 0.9)')} AS Hi, {r('avg(OADR)')} AS OADR
FROM under GROUP BY Policy, policy_rank, Year""",
        recursive=True,
    )
)
def oadr_under_band(spark, sf_dir):
    ratios = _ratios(spark, sf_dir)
    need = schedule.need_months(ratios, TARGET)
    bands = {name: name for name in ("lower", "optimal", "upper")}
    band = schedule.capped_schedule(need, START, FIRST, LAST, columns=bands)
    return rounded(schedule.searched_ratios(ratios, band), "Lo", "Hi", "OADR")


@query(
    with_views(
        _VIEWS,
        BAND
        + f""", named AS (
  SELECT Year, 'Optimal' AS Policy, 1 AS policy_rank, optimal AS age_months FROM schedule
  UNION ALL SELECT Year, 'Lower boundary', 2, lower FROM schedule
  UNION ALL SELECT Year, 'Upper boundary', 3, upper FROM schedule),
under AS (
  SELECT Policy, policy_rank, Rep, s.Year, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN named p ON s.Year = p.Year
  GROUP BY Policy, policy_rank, Rep, s.Year, age_months)
SELECT Policy, policy_rank, Year, {r('quantile_cont(OADR, 0.1)')} AS Lo,
       {r('quantile_cont(OADR, 0.9)')} AS Hi, {r('avg(OADR)')} AS OADR
FROM under GROUP BY Policy, policy_rank, Year""",
        recursive=True,
    )
)
def oadr_under_band_of_all_years(spark, sf_dir):
    out = schedule.oadr_under_band(V.sim(spark, sf_dir), _band(spark, sf_dir), fill=False)
    return rounded(out, "Lo", "Hi", "OADR")


# The starting scheme's earlier years, then the schedule searched from 1997 on.
@query(
    with_views(
        _VIEWS,
        f""", candidates AS (
  SELECT Year, CAST(unnest(range(804, 804 + 12 * (Year - 1996) + 1)) AS INTEGER) AS age_months
  FROM v_years WHERE Year >= 1997),
ratios AS (
  SELECT Rep, s.Year, age_months, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN candidates c ON s.Year = c.Year GROUP BY Rep, s.Year, age_months),
need AS (
  SELECT Year, min(age_months) FILTER (WHERE m <= {TARGET}) AS need
  FROM (SELECT Year, age_months, avg(OADR) AS m FROM ratios GROUP BY Year, age_months)
  GROUP BY Year),
band AS (
  SELECT CAST(1996 AS INTEGER) AS Year, CAST(804 AS INTEGER) AS optimal
  UNION ALL
  SELECT n.Year, least(b.optimal + 12, greatest(b.optimal, coalesce(n.need, b.optimal + 12)))
  FROM band b JOIN need n ON n.Year = b.Year + 1)
SELECT Year, age_months AS optimal FROM v_policy WHERE Policy = 'Current' AND Year < 1997
UNION ALL SELECT Year, optimal FROM band WHERE Year >= 1997""",
        recursive=True,
    )
)
def schedule_after_start(spark, sf_dir):
    band = schedule.schedule_band(V.sim(spark, sf_dir), 804, 1997, LAST, TARGET)
    start = policy_slice(V.policy(spark, sf_dir), "Current")
    return schedule.prepend_start(band, start, ["optimal"])


LABEL = "concat({0} // 12, 'Y', CASE WHEN {0} % 12 > 0 THEN concat('+', {0} % 12, 'M') ELSE '' END)"


@query(
    with_views(
        _VIEWS,
        BAND
        + f"""SELECT Year, {LABEL.format('lower')} AS lower, {LABEL.format('optimal')} AS optimal,
                     {LABEL.format('upper')} AS upper FROM schedule""",
        recursive=True,
    )
)
def schedule_report(spark, sf_dir):
    return report.schedule_report(_band(spark, sf_dir), ["lower", "optimal", "upper"])


def _blocks_sql(columns):
    labels = ", ".join(f"{LABEL.format(c)} AS {c}" for c in columns)
    cells = ", ".join(
        f"max({c}) FILTER (WHERE block = {b}) AS {c}_{b}" for b in (1, 2, 3) for c in ("Year", *columns)
    )
    return f""", cells AS (
  SELECT (Year - {FIRST}) % 3 AS row, (Year - {FIRST}) // 3 + 1 AS block, Year, {labels} FROM schedule)
SELECT CAST(row AS INTEGER) AS row, {cells} FROM cells GROUP BY row"""


@query(with_views(_VIEWS, BAND + _blocks_sql(["optimal"]), recursive=True))
def side_by_side(spark, sf_dir):
    labels = report.schedule_report(_band(spark, sf_dir), ["optimal"])
    return report.side_by_side(labels, ["optimal"], FIRST, LAST, block=3)


@query(with_views(_VIEWS, BAND + _blocks_sql(["lower", "upper"]), recursive=True))
def side_by_side_band(spark, sf_dir):
    labels = report.schedule_report(_band(spark, sf_dir), ["lower", "upper"])
    return report.side_by_side(labels, ["lower", "upper"], FIRST, LAST, block=3)


@query(
    with_views(
        ["v_sim", "v_policy"],
        f""", named AS (
  SELECT Year, 'Later' AS Policy, 1 AS policy_rank, age_months FROM v_policy WHERE Policy = 'Proposed'
  UNION ALL SELECT Year, 'Sooner', 2, age_months FROM v_policy WHERE Policy = 'Age65'),
under AS (
  SELECT Policy, policy_rank, Rep, s.Year, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN named p ON s.Year = p.Year
  GROUP BY Policy, policy_rank, Rep, s.Year, age_months)
SELECT Policy, policy_rank, Year, {r('quantile_cont(OADR, 0.1)')} AS Lo,
       {r('quantile_cont(OADR, 0.9)')} AS Hi, {r('avg(OADR)')} AS OADR
FROM under GROUP BY Policy, policy_rank, Year""",
    )
)
def oadr_under_schedules(spark, sf_dir):
    policy = V.policy(spark, sf_dir)
    named = {"Later": policy_slice(policy, "Proposed"), "Sooner": policy_slice(policy, "Age65")}
    out = ratio.oadr_under_schedules(V.sim(spark, sf_dir), named, fill=False)
    return rounded(out, "Lo", "Hi", "OADR")


# A schedule per key: here each sex is its own population.
def _by_key_sql(female, male):
    (f_start, f_target), (m_start, m_target) = female, male
    return f""", starts(Sex, start, target) AS (VALUES ('Female', {f_start}, {f_target}), ('Male', {m_start}, {m_target})),
candidates AS (
  SELECT Sex, Year, CAST(unnest(range(start, start + 12 * (Year - {FIRST - 1}) + 1)) AS INTEGER) AS age_months
  FROM v_years, starts),
ratios AS (
  SELECT s.Sex, Rep, s.Year, age_months, {ratio_sql('age_months')} AS OADR
  FROM v_sim s JOIN candidates c ON s.Year = c.Year AND s.Sex = c.Sex GROUP BY s.Sex, Rep, s.Year, age_months),
need AS (
  SELECT Sex, Year, min(age_months) FILTER (WHERE lo <= target) AS lower,
         min(age_months) FILTER (WHERE m <= target) AS optimal,
         min(age_months) FILTER (WHERE hi <= target) AS upper
  FROM (SELECT Sex, Year, age_months, quantile_cont(OADR, 0.1) AS lo, avg(OADR) AS m,
               quantile_cont(OADR, 0.9) AS hi
        FROM ratios GROUP BY Sex, Year, age_months) JOIN starts USING (Sex)
  GROUP BY Sex, Year),
band AS (
  SELECT Sex, CAST({FIRST - 1} AS INTEGER) AS Year, CAST(start AS INTEGER) AS lower,
         CAST(start AS INTEGER) AS optimal, CAST(start AS INTEGER) AS upper
  FROM starts
  UNION ALL
  SELECT n.Sex, n.Year,
         least(b.lower + 12, greatest(b.lower, coalesce(n.lower, b.lower + 12))),
         least(b.optimal + 12, greatest(b.optimal, coalesce(n.optimal, b.optimal + 12))),
         least(b.upper + 12, greatest(b.upper, coalesce(n.upper, b.upper + 12)))
  FROM band b JOIN need n ON n.Year = b.Year + 1 AND n.Sex = b.Sex)
SELECT * FROM band WHERE Year >= {FIRST}"""


@query(with_views(_VIEWS, _by_key_sql((START, TARGET), (START, TARGET)), recursive=True))
def schedule_band_by_key(spark, sf_dir):
    return schedule.schedule_band(V.sim(spark, sf_dir), START, FIRST, LAST, TARGET, keys=["Sex"])


# Each key with its own start and target.
@query(with_views(_VIEWS, _by_key_sql((774, 0.55), (786, 0.70)), recursive=True))
def schedule_band_by_key_start(spark, sf_dir):
    table = spark.createDataFrame([("Female", 774, 0.55), ("Male", 786, 0.70)], "Sex string, start_month int, target double")
    return schedule.schedule_band(
        V.sim(spark, sf_dir), table.drop("target"), FIRST, LAST, table.drop("start_month"), keys=["Sex"], ages=(60, 75)
    )
