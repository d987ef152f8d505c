"""Rates, life tables, growth balance, curves and their components."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from agestrata.operators import accounting, components, curves, fertility, folds, forecast, gaps, rate_models
from agestrata.plans import views as V
from agestrata.plans.registry import query, r, rounded
from agestrata.plans.tables import CELLS
from agestrata.plans.views import FERTILITY_REGION, FOLD_HORIZON, FOLD_TRAIN, with_views

# Rates of cells without events are raised to this before taking logs.
FLOOR = 0.001
# Fixed value: the normal quantile of 0.9, for central intervals of 80 percent.
NORMAL_90 = 1.2815515655446004
SERIES = ["series", "Sex"]

# --- accounting -------------------------------------------------------------------


@query(with_views(["v_rates"], "SELECT series, Sex, Year, Age, events, exposure, rate FROM v_rates"))
def central_rates(spark, sf_dir):
    records = V.people(spark, sf_dir).select(
        "series", "Sex", "Year", "Age",
        F.col("event").cast("double").alias("events"),
        F.col("Population").alias("exposure"),
    )
    return accounting.central_rates(records)


LIFE = """, chances AS (
  SELECT series, Sex, Year, Age, rate,
         CASE WHEN Age = 100 THEN 1.0 ELSE least(1.0, rate / (1 + 0.5 * rate)) END AS q
  FROM v_rates),
counted AS (
  SELECT *, Age = row_number() OVER (PARTITION BY series, Sex, Year ORDER BY Age) - 1 AS whole FROM chances),
alive AS (
  SELECT *, CASE WHEN whole THEN coalesce(product(1 - q) OVER younger, 1.0)
                 WHEN bool_or(q >= 1 AND whole) OVER younger THEN 0.0 END AS l
  FROM counted
  WINDOW younger AS (PARTITION BY series, Sex, Year ORDER BY Age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
years_lived AS (
  SELECT *, l * q AS d,
         CASE WHEN Age = 100 THEN l / nullif(rate, 0) ELSE l - 0.5 * l * q END AS lived FROM alive),
life AS (
  SELECT a.*, CASE WHEN a.Age = 100 THEN a.lived / (y.lived + a.lived)
                   WHEN a.Age = 99 THEN o.lived / (a.lived + o.lived)
                   ELSE o.lived / nullif(a.lived, 0) END AS survival
  FROM years_lived a
       LEFT JOIN years_lived o ON o.series = a.series AND o.Sex = a.Sex AND o.Year = a.Year
                                  AND o.Age = a.Age + 1
       LEFT JOIN years_lived y ON y.series = a.series AND y.Sex = a.Sex AND y.Year = a.Year
                                  AND y.Age = a.Age - 1)"""
_LIFE_COLUMNS = ["rate", "q", "l", "d", "lived", "survival"]


@query(
    with_views(
        ["v_rates"],
        LIFE
        + "SELECT series, Sex, Year, Age, "
        + ", ".join(f"{r(c)} AS {c}" for c in _LIFE_COLUMNS)
        + " FROM life",
    )
)
def life_table(spark, sf_dir):
    return rounded(accounting.life_table(V.rates(spark, sf_dir)), *_LIFE_COLUMNS)


BIRTHS = """, newborn AS (
  SELECT series, Year, s.Sex, sum(births) * s.share AS births
  FROM v_births CROSS JOIN (VALUES ('Male', 1.05 / 2.05), ('Female', 1 / 2.05)) AS s(Sex, share)
  GROUP BY series, Year, s.Sex, s.share)"""


@query(
    with_views(
        ["v_births"], BIRTHS + f"SELECT series, Year, Sex, {r('births')} AS births FROM newborn"
    )
)
def births_by_sex(spark, sf_dir):
    return rounded(accounting.births_by_sex(V.births(spark, sf_dir), ["series"]), "births")


DEATHS = (
    LIFE
    + BIRTHS
    + """, moves AS (
  SELECT p.series, p.Sex, p.Year, least(p.Age + 1, 100) AS Age, p.exposure AS start,
         p.exposure * (1 - survival) AS deaths
  FROM v_rates p LEFT JOIN life l ON p.series = l.series AND p.Sex = l.Sex AND p.Year = l.Year
                                     AND p.Age = l.Age
  UNION ALL
  SELECT b.series, b.Sex, b.Year, 0, births, births * (1 - lived / l)
  FROM newborn b LEFT JOIN life l ON b.series = l.series AND b.Sex = l.Sex AND b.Year = l.Year AND l.Age = 0),
cohorts AS (
  SELECT series, Sex, Year, CAST(Age AS INTEGER) AS Age, sum(start) AS start,
         CASE WHEN count(*) = count(deaths) THEN sum(deaths) END AS deaths
  FROM moves GROUP BY ALL)"""
)


# Cells of either side, in the years that both sides have.
BALANCE = """, later AS (SELECT series, Sex, CAST(Year - 1 AS INTEGER) AS Year, Age, exposure AS "end" FROM v_rates),
balance AS (
  SELECT series, Sex, Year, Age, "end", start, deaths, l.rowid_ IS NOT NULL AS came, c.rowid_ IS NOT NULL AS was
  FROM (SELECT *, 1 AS rowid_ FROM cohorts) c FULL JOIN (SELECT *, 1 AS rowid_ FROM later) l USING (series, Sex, Year, Age)
  WHERE (series, Sex, Year) IN (SELECT series, Sex, Year FROM cohorts)
    AND (series, Sex, Year) IN (SELECT series, Sex, Year FROM later))
"""


def _population(spark, sf_dir):
    return V.rates(spark, sf_dir).select("series", "Sex", "Year", "Age", F.col("exposure").alias("Population"))


def _deaths(spark, sf_dir):
    births = accounting.births_by_sex(V.births(spark, sf_dir), ["series"])
    life = accounting.life_table(V.rates(spark, sf_dir))
    return accounting.cohort_deaths(_population(spark, sf_dir), life, births, ["series"])


@query(
    with_views(
        ["v_rates", "v_births"],
        DEATHS
        + f"SELECT series, Sex, Year, Age, {r('start')} AS start, {r('deaths')} AS deaths FROM cohorts",
    )
)
def cohort_deaths(spark, sf_dir):
    return rounded(_deaths(spark, sf_dir), "start", "deaths")


@query(
    with_views(
        ["v_rates", "v_births"],
        DEATHS
        + BALANCE
        + f"""SELECT series, Sex, Year, Age, {r('"end" - start + deaths')} AS net_migration FROM balance""",
    )
)
def net_migration(spark, sf_dir):
    balance = accounting.net_migration(_population(spark, sf_dir), _deaths(spark, sf_dir), ["series"])
    return rounded(balance, "net_migration")


@query(
    with_views(
        ["v_rates", "v_births"],
        DEATHS
        + BALANCE
        + f"""SELECT series, Sex, Year, Age,
                     {r('CASE WHEN came THEN "end" ELSE 0 END - CASE WHEN was THEN start ELSE 0 END'
                        ' + CASE WHEN was THEN deaths ELSE 0 END')} AS net_migration
              FROM balance""",
    )
)
def net_migration_absent_is_zero(spark, sf_dir):
    balance = accounting.net_migration(
        _population(spark, sf_dir), _deaths(spark, sf_dir), ["series"], absent_is_zero=True
    )
    return rounded(balance, "net_migration")


# --- curves -----------------------------------------------------------------------

LOGS = f""", logs AS (
  SELECT series, Sex, Year, Age, ln(greatest(rate, {FLOOR})) AS value,
         greatest(rate, {FLOOR}) * exposure AS weight
  FROM v_rates)"""

# The line through the neighbours, at their middle; with one age in reach, its value.
LINEAR = """CASE WHEN sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d) <= 1e-12 * sum(w) * sum(w * d * d)
              THEN sum(w * y) / nullif(sum(w), 0)
              ELSE (sum(w * d * d) * sum(w * y) - sum(w * d) * sum(w * d * y))
                   / nullif(sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d), 0) END"""

SMOOTH = (
    LOGS
    + """, near AS (
  SELECT t.series, t.Sex, t.Year, t.Age, s.Age - t.Age AS d, s.value AS y,
         s.weight * pow(1 - pow(abs(s.Age - t.Age) / 6.0, 3), 3) AS w
  FROM logs t JOIN logs s ON s.series = t.series AND s.Sex = t.Sex AND s.Year = t.Year
                             AND s.Age BETWEEN t.Age - 5 AND t.Age + 5),
smooth AS (
  SELECT series, Sex, Year, Age,
         """
    + LINEAR
    + """ AS value
  FROM near GROUP BY series, Sex, Year, Age)"""
)


def _logs(spark, sf_dir):
    return curves.log_rates(V.rates(spark, sf_dir), FLOOR)


def _smooth(spark, sf_dir):
    smooth = curves.smooth_by_age(_logs(spark, sf_dir), SERIES)
    return smooth.withColumnRenamed("smooth", "value")


@query(
    with_views(
        ["v_rates"],
        LOGS
        + f"SELECT series, Sex, Year, Age, {r('value')} AS value, {r('weight')} AS weight FROM logs",
    )
)
def log_rates(spark, sf_dir):
    logs = _logs(spark, sf_dir).select(*SERIES, "Year", "Age", "value", "weight")
    return rounded(logs, "value", "weight")


@query(
    with_views(
        ["v_rates"], SMOOTH + f"SELECT series, Sex, Year, Age, {r('value')} AS smooth FROM smooth"
    )
)
def smooth_by_age(spark, sf_dir):
    return rounded(curves.smooth_by_age(_logs(spark, sf_dir), SERIES), "smooth")


# A third of the cells lack a rate; each is still a cell to be filled.
def _smooth_gaps_sql(weight):
    return f""", gaps AS (
  SELECT series, Sex, Year, Age, CASE WHEN (Age + Year) % 3 > 0 THEN rate END AS value, {weight} AS weight
  FROM v_rates),
near AS (
  SELECT t.series, t.Sex, t.Year, t.Age, s.Age - t.Age AS d, s.value AS y,
         CASE WHEN s.value IS NOT NULL THEN s.weight * pow(1 - pow(abs(s.Age - t.Age) / 6.0, 3), 3) END AS w
  FROM gaps t JOIN gaps s ON s.series = t.series AND s.Sex = t.Sex AND s.Year = t.Year
                             AND s.Age BETWEEN t.Age - 5 AND t.Age + 5)
SELECT series, Sex, Year, Age,
       {r(LINEAR)} AS smooth
FROM near GROUP BY series, Sex, Year, Age"""


def _gaps(spark, sf_dir):
    held = F.when((F.col("Age") + F.col("Year")) % 3 > 0, F.col("rate"))
    return V.rates(spark, sf_dir).withColumn("value", held).withColumn("weight", F.col("exposure"))


@query(with_views(["v_rates"], _smooth_gaps_sql("exposure")))
def smooth_with_gaps(spark, sf_dir):
    return rounded(curves.smooth_by_age(_gaps(spark, sf_dir), SERIES), "smooth")


@query(with_views(["v_rates"], _smooth_gaps_sql("1.0")))
def smooth_unweighted_with_gaps(spark, sf_dir):
    return rounded(curves.smooth_by_age(_gaps(spark, sf_dir), SERIES, weight=None), "smooth")


PAIRED = """, paired AS (
  SELECT series, Year, Age, max(exposure) FILTER (WHERE Sex = 'Male') AS M,
         max(exposure) FILTER (WHERE Sex = 'Female') AS F
  FROM v_rates GROUP BY series, Year, Age)"""


def _paired(spark, sf_dir, how):
    return how(V.rates(spark, sf_dir), ["series"], "exposure")


@query(
    with_views(
        ["v_rates"],
        PAIRED
        + f"""SELECT series, Year, Age, {r('sqrt(M * F)')} AS product, {r('sqrt(M / F)')} AS ratio
              FROM paired""",
    )
)
def product_ratio(spark, sf_dir):
    return rounded(_paired(spark, sf_dir, curves.product_ratio), "product", "ratio")


@query(
    with_views(
        ["v_rates"],
        PAIRED
        + """SELECT series, Year, Age, (M + F) / 2 AS half_sum, (M - F) / 2 AS half_difference
             FROM paired""",
    )
)
def sum_difference(spark, sf_dir):
    return _paired(spark, sf_dir, curves.sum_difference)


ROUND_TRIP = with_views(
    ["v_rates"],
    PAIRED
    + f"""SELECT series, 'Male' AS Sex, Year, Age, {r('M + 0 * F')} AS value FROM paired
          UNION ALL SELECT series, 'Female', Year, Age, {r('F + 0 * M')} FROM paired""",
)


@query(ROUND_TRIP)
def recombine_product_ratio(spark, sf_dir):
    paired = _paired(spark, sf_dir, curves.product_ratio)
    return rounded(curves.recombine_product_ratio(paired, ["series"]), "value")


@query(ROUND_TRIP)
def recombine_sum_difference(spark, sf_dir):
    paired = _paired(spark, sf_dir, curves.sum_difference)
    return rounded(curves.recombine_sum_difference(paired, ["series"]), "value")


CENTERED = (
    LOGS
    + """, mean_curve AS (SELECT series, Sex, Age, avg(value) AS mu FROM logs GROUP BY ALL),
centered AS (
  SELECT l.series, l.Sex, l.Year, l.Age, mu, value - mu AS centered
  FROM logs l JOIN mean_curve m ON l.series = m.series AND l.Sex = m.Sex AND l.Age = m.Age)"""
)


def _centered(spark, sf_dir):
    return curves.center_curves(_logs(spark, sf_dir), SERIES)


@query(
    with_views(
        ["v_rates"],
        CENTERED
        + f"SELECT series, Sex, Year, Age, {r('mu')} AS mu, {r('centered')} AS centered FROM centered",
    )
)
def center_curves(spark, sf_dir):
    return rounded(_centered(spark, sf_dir), "mu", "centered")


@query(
    with_views(
        ["v_rates"],
        CENTERED
        + f"""SELECT a.series, a.Sex, a.Age AS Age_i, b.Age AS Age_j,
                     {r('sum(a.centered * b.centered)')} AS moment
              FROM centered a JOIN centered b
                   ON a.series = b.series AND a.Sex = b.Sex AND a.Year = b.Year
              GROUP BY a.series, a.Sex, a.Age, b.Age""",
    )
)
def curve_covariance(spark, sf_dir):
    return rounded(components.curve_covariance(_centered(spark, sf_dir), SERIES), "moment")


def _basis(centered):
    return components.leading_components(centered, SERIES)


# Eigenvectors are not SQL; tests compare them with numpy.
@query()
def principal_components(spark, sf_dir):
    return rounded(_basis(_centered(spark, sf_dir)), "phi", "share")


# Seven centred years have six components, so the shares of all six make the whole.
@query(
    with_views(
        ["v_rates"],
        """SELECT series, Sex, CAST(6 AS BIGINT) AS components, 1.0::DOUBLE AS whole
           FROM v_rates GROUP BY series, Sex""",
    )
)
def variance_shares(spark, sf_dir):
    shares = components.variance_shares(_basis(_centered(spark, sf_dir)), SERIES)
    whole = shares.groupBy(*SERIES).agg(
        F.count("j").alias("components"), F.sum("share").alias("whole")
    )
    return rounded(whole, "whole")


# What makes a vector a principal component, checked for each: the matrix (which has its
# own query) maps it to its share of the trace times itself, it has length 1 and stands
# at right angles to the others, and shares do not rise.
@query(
    with_views(
        ["v_rates"],
        """SELECT series, Sex, CAST(unnest(range(1, 7)) AS INTEGER) AS j, 0.0::DOUBLE AS off_eigen,
                  0.0::DOUBLE AS off_length, 0.0::DOUBLE AS off_angle, true AS in_order
           FROM v_rates GROUP BY series, Sex""",
    )
)
def component_check(spark, sf_dir):
    centered = _centered(spark, sf_dir)
    matrix, basis = components.curve_covariance(centered, SERIES), _basis(centered)
    trace = matrix.where("Age_i = Age_j").groupBy(*SERIES).agg(F.sum("moment").alias("trace"))
    other = basis.select(*SERIES, F.col("Age").alias("Age_j"), "j", F.col("phi").alias("_phi"))
    image = (
        matrix.join(other, [*SERIES, "Age_j"]).groupBy(*SERIES, "j", F.col("Age_i").alias("Age"))
        .agg(F.sum(F.col("moment") * F.col("_phi")).alias("image"))
    )
    whole = basis.join(image, [*SERIES, "j", "Age"]).join(trace, SERIES)
    eigen = whole.groupBy(*SERIES, "j").agg(
        F.max(F.abs(F.col("image") - F.col("share") * F.col("trace") * F.col("phi"))).alias("off_eigen"),
        F.abs(F.sum(F.col("phi") * F.col("phi")) - 1).alias("off_length"),
        F.max("share").alias("share"),
    )
    partner = basis.select(*SERIES, "Age", F.col("j").alias("k"), F.col("phi").alias("_phi"))
    angles = (
        basis.join(partner, [*SERIES, "Age"]).where("j != k").groupBy(*SERIES, "j", "k")
        .agg(F.abs(F.sum(F.col("phi") * F.col("_phi"))).alias("angle"))
        .groupBy(*SERIES, "j").agg(F.max("angle").alias("off_angle"))
    )
    before = F.lag("share").over(Window.partitionBy(*SERIES).orderBy("j"))
    return rounded(
        eigen.join(angles, [*SERIES, "j"]).withColumn("in_order", F.coalesce(F.col("share") <= before, F.lit(True)))
        .drop("share"),
        "off_eigen", "off_length", "off_angle",
    )


# The leading component alone, whose direction and share SQL can find: a fixed number of
# squarings of the small matrix of years by years leaves it.
LEADING = """, gram AS (
  SELECT a.series, a.Sex, a.Year AS i, b.Year AS k, sum(a.centered * b.centered) AS g
  FROM centered a JOIN centered b ON a.series = b.series AND a.Sex = b.Sex AND a.Age = b.Age
  GROUP BY ALL),
scale AS (SELECT series, Sex, sum(g) AS trace FROM gram WHERE i = k GROUP BY ALL),
powers AS (
  SELECT 0 AS n, gram.series, gram.Sex, i, k, g / trace AS g FROM gram JOIN scale USING (series, Sex)
  UNION ALL
  (WITH squared AS (
     SELECT a.n + 1 AS n, a.series, a.Sex, a.i, b.k, sum(a.g * b.g) AS g
     FROM powers a JOIN powers b ON a.series = b.series AND a.Sex = b.Sex AND a.k = b.i
     WHERE a.n < 40 GROUP BY ALL),
   size AS (SELECT series, Sex, sum(g) AS size FROM squared WHERE i = k GROUP BY ALL)
   SELECT n, squared.series, squared.Sex, i, k, g / size AS g FROM squared JOIN size USING (series, Sex))),
-- The limit is v v', so v' G v is the sum of its products with G.
largest AS (
  SELECT series, Sex, sum(p.g * gram.g) AS lambda_
  FROM powers p JOIN gram USING (series, Sex, i, k) WHERE n = 40 GROUP BY ALL),
fitted AS (
  SELECT c.series, c.Sex, p.k AS Year, c.Age, sum(p.g * c.centered) AS part
  FROM powers p JOIN centered c ON c.series = p.series AND c.Sex = p.Sex AND c.Year = p.i
  WHERE n = 40 GROUP BY ALL)"""


@query(
    with_views(
        ["v_rates"],
        CENTERED
        + LEADING
        + f"""
SELECT f.series, f.Sex, f.Year, f.Age, {r('mu + part')} AS fitted, {r('lambda_ / trace')} AS share
FROM fitted f JOIN mean_curve m ON m.series = f.series AND m.Sex = f.Sex AND m.Age = f.Age
     JOIN largest l ON l.series = f.series AND l.Sex = f.Sex JOIN scale s ON s.series = f.series AND s.Sex = f.Sex""",
        recursive=True,
    )
)
def leading_component(spark, sf_dir):
    centered = _centered(spark, sf_dir)
    basis = components.leading_components(centered, SERIES, 1)
    scores = components.component_scores(centered, basis, SERIES, 1)
    mu = centered.groupBy(*SERIES, "Age").agg(F.max_by("mu", "Year").alias("mu"))
    fitted = components.reconstruct(mu, basis, scores, SERIES, 1)
    shares = components.variance_shares(basis, SERIES).select(*SERIES, "share")
    return rounded(fitted.join(shares, SERIES), "fitted", "share")


# One component of many: what is rebuilt is its score times its loading, so drift and the
# variance of its steps are those of each age's rebuilt values, and the rest is residual.
@query(
    with_views(
        ["v_rates"],
        CENTERED
        + LEADING
        + f""", span AS (SELECT series, Sex, min(Year) AS first, max(Year) AS last FROM fitted GROUP BY ALL),
steps AS (
  SELECT a.series, a.Sex, a.Age, count(*)::DOUBLE AS n, var_samp(a.part - b.part) AS v
  FROM fitted a JOIN fitted b ON a.series = b.series AND a.Sex = b.Sex AND a.Age = b.Age AND b.Year = a.Year - 1
  GROUP BY ALL),
rest AS (
  SELECT c.series, c.Sex, c.Age, greatest(c.whole - f.held, 0) / nullif(c.n - 1, 0) AS residual
  FROM (SELECT series, Sex, Age, sum(centered * centered) AS whole, count(*) AS n FROM centered GROUP BY ALL) c
       JOIN (SELECT series, Sex, Age, sum(part * part) AS held FROM fitted GROUP BY ALL) f
       ON c.series = f.series AND c.Sex = f.Sex AND c.Age = f.Age),
ahead AS (
  SELECT m.series, m.Sex, m.Age, last + h AS Year, mu + b.part + h * (b.part - a.part) / (last - first) AS fitted,
         {NORMAL_90} * sqrt(CASE WHEN n > 1 THEN v * h * (1 + h / n) END + residual) AS half
  FROM mean_curve m JOIN span USING (series, Sex)
       JOIN fitted a ON a.series = m.series AND a.Sex = m.Sex AND a.Age = m.Age AND a.Year = first
       JOIN fitted b ON b.series = m.series AND b.Sex = m.Sex AND b.Age = m.Age AND b.Year = last
       JOIN steps s ON s.series = m.series AND s.Sex = m.Sex AND s.Age = m.Age
       JOIN rest e ON e.series = m.series AND e.Sex = m.Sex AND e.Age = m.Age,
       range(1, 34) AS t(h))
SELECT series, Sex, CAST(Year AS INTEGER) AS Year, Age, {r('fitted')} AS fitted, {r('fitted - half')} AS lower,
       {r('fitted + half')} AS upper
FROM ahead""",
        recursive=True,
    )
)
def component_forecast_interval(spark, sf_dir):
    out = rate_models.component_forecast(_logs(spark, sf_dir), SERIES, components=1, level=80)
    return rounded(out, "fitted", "lower", "upper")


# A basis SQL can form too: the centred curves of the first two years.
@query(
    with_views(
        ["v_rates"],
        CENTERED
        + f"""SELECT c.series, c.Sex, c.Year, CAST(b.Year - 1994 AS INTEGER) AS j,
                     {r('sum(c.centered * b.centered)')} AS beta
              FROM centered c JOIN centered b
                   ON c.series = b.series AND c.Sex = b.Sex AND c.Age = b.Age AND b.Year <= 1996
              GROUP BY c.series, c.Sex, c.Year, b.Year""",
    )
)
def component_scores(spark, sf_dir):
    centered = _centered(spark, sf_dir)
    basis = centered.where(F.col("Year") <= 1996).select(
        *SERIES, (F.col("Year") - 1994).alias("j"), "Age", F.col("centered").alias("phi")
    )
    return rounded(components.component_scores(centered, basis, SERIES, 2), "beta")


# All six components rebuild seven years exactly; a cell without a rate gets the mean.
@query(
    with_views(
        ["v_rates"],
        CENTERED
        + f"""SELECT m.series, m.Sex, y.Year, m.Age, {r('coalesce(l.value, m.mu)')} AS fitted
              FROM mean_curve m
                   JOIN (SELECT DISTINCT series, Sex, Year FROM logs) y
                        ON y.series = m.series AND y.Sex = m.Sex
                   LEFT JOIN logs l ON l.series = m.series AND l.Sex = m.Sex AND l.Year = y.Year
                        AND l.Age = m.Age""",
    )
)
def reconstruct(spark, sf_dir):
    centered = _centered(spark, sf_dir)
    basis = _basis(centered)
    scores = components.component_scores(centered, basis, SERIES)
    mu = centered.groupBy(*SERIES, "Age").agg(F.max_by("mu", "Year").alias("mu"))
    fitted = components.reconstruct(mu, basis, scores, SERIES)
    return rounded(fitted, "fitted")


# --- curves with missing cells ------------------------------------------------------

# A cell without events has no log rate: it is missing.
SEEN = """, seen AS (
  SELECT series, Sex, Year, Age, ln(rate) AS value FROM v_rates WHERE events > 0)"""


def _seen(spark, sf_dir):
    seen = V.rates(spark, sf_dir).where("events > 0")
    return seen.select(*SERIES, "Year", "Age", F.ln("rate").alias("value"))


@query(
    with_views(
        ["v_rates"],
        SEEN
        + f""", deviations AS (
  SELECT series, Sex, Year, Age, value - avg(value) OVER (PARTITION BY series, Sex, Age) AS c FROM seen)
SELECT a.series, a.Sex, a.Age AS Age_i, b.Age AS Age_j, count(*) AS years, {r('avg(a.c * b.c)')} AS moment
FROM deviations a JOIN deviations b ON a.series = b.series AND a.Sex = b.Sex AND a.Year = b.Year
GROUP BY ALL""",
    )
)
def pairwise_covariance(spark, sf_dir):
    centered = curves.center_curves(_seen(spark, sf_dir), SERIES)
    return rounded(gaps.pairwise_covariance(centered, SERIES), "moment")


# A table whose every cell is known from its margins: mean log rate of the age times that of
# the year. Spark sees it where there were events only, and has to find the rest.
MARGINS = (
    SEEN
    + """, by_age AS (SELECT series, Sex, Age, avg(value) AS a FROM seen GROUP BY ALL),
by_year AS (SELECT series, Sex, Year, avg(value) AS k FROM seen GROUP BY ALL)"""
)


def _from_margins(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    age = F.avg("value").over(Window.partitionBy(*SERIES, "Age"))
    year = F.avg("value").over(Window.partitionBy(*SERIES, "Year"))
    return seen.select(*SERIES, "Year", "Age", (age * year).alias("value"))


@query(
    with_views(
        ["v_rates"],
        MARGINS
        + f"""SELECT series, Sex, Year, Age, {r('a * k')} AS fitted, 1.0::DOUBLE AS share
              FROM by_age JOIN by_year USING (series, Sex)""",
    )
)
def filled_component(spark, sf_dir):
    fit = gaps.gappy_fit(_from_margins(spark, sf_dir), SERIES, 1)
    basis = gaps.gappy_basis(fit, SERIES)
    mu = gaps.gappy_mean(fit, SERIES).select(*SERIES, "Age", "mu")
    fitted = components.reconstruct(mu, basis, gaps.gappy_scores(fit, SERIES), SERIES, 1)
    shares = components.variance_shares(basis, SERIES).select(*SERIES, "share")
    return rounded(fitted.join(shares, SERIES), "fitted", "share")


@query(
    with_views(
        ["v_rates"],
        MARGINS
        + f""", ends AS (
  SELECT series, Sex, max(Year) AS last, arg_max(k, Year) AS k,
         (arg_max(k, Year) - arg_min(k, Year)) / (max(Year) - min(Year)) AS drift
  FROM by_year GROUP BY ALL),
steps AS (
  SELECT a.series, a.Sex, count(*)::DOUBLE AS n, var_samp(a.k - b.k) AS v
  FROM by_year a JOIN by_year b ON a.series = b.series AND a.Sex = b.Sex AND b.Year = a.Year - 1 GROUP BY ALL),
ahead AS (
  SELECT series, Sex, Age, last + h AS Year, a * (k + h * drift) AS fitted,
         {NORMAL_90} * abs(a) * sqrt(v * h * (1 + h / n)) AS half
  FROM by_age JOIN ends USING (series, Sex) JOIN steps USING (series, Sex), range(1, 34) AS t(h))
SELECT series, Sex, CAST(Year AS INTEGER) AS Year, Age, {r('fitted')} AS fitted, {r('fitted - half')} AS lower,
       {r('fitted + half')} AS upper
FROM ahead""",
    )
)
def filled_forecast(spark, sf_dir):
    seen = _from_margins(spark, sf_dir)
    out = rate_models.component_forecast(seen, SERIES, components=1, level=80, fill=True)
    return rounded(out, "fitted", "lower", "upper")


# --- forecasts --------------------------------------------------------------------

CELL = [*SERIES, "Age"]


@query(
    with_views(
        ["v_rates"],
        LOGS
        + f""", ends AS (
  SELECT series, Sex, Age, min(Year) AS first, max(Year) AS last, arg_min(value, Year) AS a,
         arg_max(value, Year) AS b FROM logs GROUP BY series, Sex, Age)
SELECT series, Sex, Age, CAST(h AS INTEGER) AS h, CAST(last + h AS INTEGER) AS Year,
       {r('b + h * coalesce((b - a) / nullif(last - first, 0), 0)')} AS value
FROM (SELECT *, unnest(range(1, 34)) AS h FROM ends)""",
    )
)
def drift_forecast(spark, sf_dir):
    return rounded(forecast.drift_forecast(_logs(spark, sf_dir), CELL, value="value"), "value")


@query(
    with_views(
        ["v_rates"],
        PAIRED
        + f""", ratios AS (SELECT series, Year, Age, ln(sqrt(M / F)) AS value FROM paired WHERE M / F IS NOT NULL),
steps AS (
  SELECT a.*, b.value AS prev FROM ratios a
  LEFT JOIN ratios b ON a.series = b.series AND a.Age = b.Age AND b.Year = a.Year - 1),
fit AS (
  SELECT series, Age, regr_slope(value, prev) AS slope, avg(value) FILTER (WHERE prev IS NOT NULL) AS y,
         avg(prev) AS x, max(Year) AS last, arg_max(value, Year) AS last_value
  FROM steps GROUP BY series, Age),
bounded AS (
  SELECT *, CASE WHEN slope IS NULL OR isnan(slope) THEN 0 WHEN slope > 0.99 THEN 0.99
                 WHEN slope < -0.99 THEN -0.99 ELSE slope END AS s
  FROM fit),
leveled AS (SELECT *, coalesce((y - s * x) / (1 - s), last_value) AS level FROM bounded)
SELECT series, Age, CAST(h AS INTEGER) AS h, CAST(last + h AS INTEGER) AS Year,
       {r('level + pow(s, h) * (last_value - level)')} AS value
FROM (SELECT *, unnest(range(1, 34)) AS h FROM leveled)""",
    )
)
def mean_reverting_forecast(spark, sf_dir):
    ratios = _paired(spark, sf_dir, curves.product_ratio).where("ratio IS NOT NULL").select(
        "series", "Year", "Age", F.ln("ratio").alias("value")
    )
    ahead = forecast.mean_reverting_forecast(ratios, ["series", "Age"], value="value")
    return rounded(ahead, "value")


STEPS = """, steps AS (
  SELECT a.*, b.value AS prev, a.value - b.value AS step FROM logs a
  LEFT JOIN logs b ON a.series = b.series AND a.Sex = b.Sex AND a.Age = b.Age AND b.Year = a.Year - 1)"""


@query(
    with_views(
        ["v_rates"],
        LOGS
        + STEPS
        + f""", fit AS (
  SELECT series, Sex, Age, min(Year) AS first, max(Year) AS last, arg_min(value, Year) AS a, arg_max(value, Year) AS b,
         count(step)::DOUBLE AS n, var_samp(step) AS v FROM steps GROUP BY series, Sex, Age),
ahead AS (
  SELECT *, b + h * coalesce((b - a) / nullif(last - first, 0), 0) AS value,
         CASE WHEN n > 1 THEN {NORMAL_90} * sqrt(v * h * (1 + h / n)) END AS half
  FROM (SELECT *, unnest(range(1, 34)) AS h FROM fit))
SELECT series, Sex, Age, CAST(h AS INTEGER) AS h, CAST(last + h AS INTEGER) AS Year, {r('value')} AS value,
       {r('value - half')} AS lower, {r('value + half')} AS upper
FROM ahead""",
    )
)
def drift_interval(spark, sf_dir):
    ahead = forecast.drift_forecast(_logs(spark, sf_dir), CELL, value="value", level=80)
    return rounded(ahead, "value", "lower", "upper")


@query(
    with_views(
        ["v_rates"],
        LOGS
        + STEPS
        + f""", fit AS (
  SELECT series, Sex, Age, max(Year) AS last, arg_max(value, Year) AS last_value, count(step)::DOUBLE AS n,
         regr_slope(value, prev) AS slope, avg(value) FILTER (WHERE prev IS NOT NULL) AS y, avg(prev) AS x
  FROM steps GROUP BY series, Sex, Age),
bounded AS (
  SELECT *, CASE WHEN slope IS NULL OR isnan(slope) THEN 0 ELSE least(0.99, greatest(-0.99, slope)) END AS s FROM fit),
leveled AS (SELECT *, coalesce((y - s * x) / (1 - s), last_value) AS level FROM bounded),
spread AS (
  SELECT l.series, l.Sex, l.Age, sum(pow(p.value - y - s * (p.prev - x), 2)) / nullif(any_value(n) - 2, 0) AS v
  FROM leveled l JOIN steps p ON p.series = l.series AND p.Sex = l.Sex AND p.Age = l.Age AND p.prev IS NOT NULL
  GROUP BY l.series, l.Sex, l.Age),
ahead AS (
  SELECT l.*, h, level + pow(s, h) * (last_value - level) AS value,
         CASE WHEN n > 2 THEN {NORMAL_90} * sqrt(v * (1 - pow(s, 2 * h)) / (1 - s * s)) END AS half
  FROM (SELECT *, unnest(range(1, 34)) AS h FROM leveled) l
       LEFT JOIN spread p ON p.series = l.series AND p.Sex = l.Sex AND p.Age = l.Age)
SELECT series, Sex, Age, CAST(h AS INTEGER) AS h, CAST(last + h AS INTEGER) AS Year, {r('value')} AS value,
       {r('value - half')} AS lower, {r('value + half')} AS upper
FROM ahead""",
    )
)
def mean_reverting_interval(spark, sf_dir):
    ahead = forecast.mean_reverting_forecast(_logs(spark, sf_dir), CELL, value="value", level=80)
    return rounded(ahead, "value", "lower", "upper")


# Three training years have two components, so drift of all scores is drift of each
# age: last + h * (last - first) / 2, with the mean where a year lacks the age.
BACKTEST = (
    LOGS
    + f""", training AS (
  SELECT l.*, id, train_from, train_to FROM logs l JOIN v_folds ON Year BETWEEN train_from AND train_to),
means AS (
  SELECT series, Sex, id, train_from, train_to, Age, avg(value) AS mu FROM training GROUP BY ALL),
ends AS (
  SELECT m.*, coalesce(a.value, mu) AS first_value, coalesce(b.value, mu) AS last_value
  FROM means m
       LEFT JOIN logs a ON a.series = m.series AND a.Sex = m.Sex AND a.Age = m.Age AND a.Year = train_from
       LEFT JOIN logs b ON b.series = m.series AND b.Sex = m.Sex AND b.Age = m.Age AND b.Year = train_to),
ahead AS (
  SELECT *, train_to + h AS Year, last_value + h * (last_value - first_value) / {FOLD_TRAIN - 1}.0 AS fitted
  FROM (SELECT *, unnest(range(1, {FOLD_HORIZON + 1})) AS h FROM ends))"""
)


@query(
    with_views(
        ["v_rates", "v_folds"],
        BACKTEST
        + f"""SELECT series, Sex, id, CAST(h AS INTEGER) AS h, CAST(Year AS INTEGER) AS Year, Age,
                     {r('fitted')} AS fitted FROM ahead""",
    )
)
def rolling_rate_forecast(spark, sf_dir):
    out = folds.rolling_rate_forecast(_logs(spark, sf_dir), V.folds(spark, sf_dir), SERIES, FOLD_HORIZON)
    return rounded(out, "fitted")


@query(
    with_views(
        ["v_rates", "v_folds"],
        BACKTEST
        + f"""SELECT a.series, a.Sex, CAST(h AS INTEGER) AS h,
                     {r('CASE WHEN count(*) = count(value) THEN sqrt(avg(pow(value - fitted, 2))) END')} AS RMSE
              FROM ahead a LEFT JOIN logs l ON l.series = a.series AND l.Sex = a.Sex
                   AND l.Year = a.Year AND l.Age = a.Age
              GROUP BY a.series, a.Sex, h""",
    )
)
def rolling_rate_backtest(spark, sf_dir):
    out = folds.rolling_rate_backtest(_logs(spark, sf_dir), V.folds(spark, sf_dir), SERIES, FOLD_HORIZON)
    return rounded(out, "RMSE")


# Each origin fits both sexes together. What they share drifts, so its forecast is one of
# each age again; the geometric mean of the sexes takes the rest out of the comparison.
SHARED_BACKTEST = (
    BACKTEST.replace("FROM logs l JOIN v_folds", "FROM shared l JOIN v_folds").replace(
        ", training AS", """, shared AS (
  SELECT m.series, 'Both' AS Sex, m.Year, m.Age, (m.value + f.value) / 2 AS value
  FROM logs m JOIN logs f ON m.series = f.series AND m.Year = f.Year AND m.Age = f.Age
  WHERE m.Sex = 'Male' AND f.Sex = 'Female'), training AS""", 1
    )
    .replace("LEFT JOIN logs a", "LEFT JOIN shared a").replace("LEFT JOIN logs b", "LEFT JOIN shared b")
)


@query(
    with_views(
        ["v_rates", "v_folds"],
        SHARED_BACKTEST
        + f"""SELECT series, id, CAST(h AS INTEGER) AS h, CAST(Year AS INTEGER) AS Year, Age,
                     {r('exp(fitted)')} AS product FROM ahead""",
    )
)
def rolling_coherent_forecast(spark, sf_dir):
    out = folds.rolling_coherent_forecast(_positive(spark, sf_dir), V.folds(spark, sf_dir), ["series"], FOLD_HORIZON)
    shared = curves.product_ratio(out, ["series", "id", "h"])
    return rounded(shared.select("series", "id", "h", "Year", "Age", "product"), "product")


# What sets the sexes apart needs eigenvectors; tests follow it by hand.
@query()
def rolling_coherent_backtest(spark, sf_dir):
    out = folds.rolling_coherent_backtest(_positive(spark, sf_dir), V.folds(spark, sf_dir), ["series"], FOLD_HORIZON)
    return rounded(out, "RMSE")


# Six components of seven years leave nothing out, so drift of all scores is drift of
# each age, again with the mean where the first or last year lacks the age.
def _drift_sql(source, keys):
    on_m = " AND ".join(f"{{0}}.{k} = m.{k}" for k in [*keys, "Age"])
    listed = ", ".join(keys)
    return f""", span AS (SELECT {listed}, min(Year) AS first, max(Year) AS last FROM {source} GROUP BY {listed}),
means AS (SELECT {listed}, Age, avg(value) AS mu FROM {source} GROUP BY {listed}, Age),
ends AS (
  SELECT m.*, first, last, coalesce(a.value, mu) AS first_value, coalesce(b.value, mu) AS last_value
  FROM means m JOIN span USING ({listed})
       LEFT JOIN {source} a ON {on_m.format('a')} AND a.Year = first
       LEFT JOIN {source} b ON {on_m.format('b')} AND b.Year = last),
ahead AS (
  SELECT {listed}, Age, CAST(last + h AS INTEGER) AS Year,
         last_value + h * (last_value - first_value) / (last - first) AS value
  FROM (SELECT *, unnest(range(1, 34)) AS h FROM ends))"""


@query(
    with_views(
        ["v_rates"],
        LOGS
        + _drift_sql("logs", SERIES)
        + f"SELECT series, Sex, Year, Age, {r('value')} AS fitted FROM ahead",
    )
)
def component_forecast(spark, sf_dir):
    return rounded(rate_models.component_forecast(_logs(spark, sf_dir), SERIES), "fitted")


def _positive(spark, sf_dir):
    rates = V.rates(spark, sf_dir)
    return rates.withColumn("value", F.greatest("rate", F.lit(FLOOR)))


# The part that sets the sexes apart needs eigenvectors; tests check it with numpy.
@query()
def coherent_forecast(spark, sf_dir):
    return rounded(rate_models.coherent_forecast(_positive(spark, sf_dir), ["series"]), "value")


@query(
    with_views(
        ["v_rates"],
        LOGS
        + """, shared AS (
  SELECT m.series, m.Year, m.Age, (m.value + f.value) / 2 AS value
  FROM logs m JOIN logs f ON m.series = f.series AND m.Year = f.Year AND m.Age = f.Age
  WHERE m.Sex = 'Male' AND f.Sex = 'Female')"""
        + _drift_sql("shared", ["series"])
        + f"SELECT series, Year, Age, {r('exp(value)')} AS product FROM ahead",
    )
)
def coherent_forecast_product(spark, sf_dir):
    forecast_rates = rate_models.coherent_forecast(_positive(spark, sf_dir), ["series"])
    shared = curves.product_ratio(forecast_rates, ["series"]).select("series", "Year", "Age", "product")
    return rounded(shared, "product")


@query(
    with_views(
        ["v_rates"],
        PAIRED
        + """, shared AS (SELECT series, Year, Age, (M + F) / 2 AS value FROM paired WHERE M + F IS NOT NULL)"""
        + _drift_sql("shared", ["series"])
        + f"SELECT series, Year, Age, {r('value')} AS half_sum FROM ahead",
    )
)
def coherent_forecast_sum(spark, sf_dir):
    measure = V.rates(spark, sf_dir).withColumn("value", F.col("exposure"))
    ahead = rate_models.coherent_forecast(measure, ["series"], log=False)
    shared = curves.sum_difference(ahead, ["series"]).select("series", "Year", "Age", "half_sum")
    return rounded(shared, "half_sum")


# --- whole models: measured, smoothed, fitted and forecast ------------------------


@query(
    with_views(
        ["v_rates"],
        SMOOTH
        + """, shared AS (
  SELECT m.series, m.Year, m.Age, (m.value + f.value) / 2 AS value
  FROM smooth m JOIN smooth f ON m.series = f.series AND m.Year = f.Year AND m.Age = f.Age
  WHERE m.Sex = 'Male' AND f.Sex = 'Female')"""
        + _drift_sql("shared", ["series"])
        + f"SELECT series, Year, Age, {r('exp(value)')} AS product FROM ahead",
    )
)
def mortality_model(spark, sf_dir):
    """Rates, their logarithms smoothed over age, both sexes forecast together; the part
    that the sexes share is compared."""
    smooth = _smooth(spark, sf_dir).withColumn("value", F.exp("value"))
    ahead = rate_models.coherent_forecast(smooth, ["series"])
    shared = curves.product_ratio(ahead, ["series"]).select("series", "Year", "Age", "product")
    return rounded(shared, "product")


MIGRATION = (
    DEATHS
    + BALANCE
    + """, moved AS (SELECT series, Sex, Year, Age, "end" - start + deaths AS value FROM balance),
near AS (
  SELECT t.series, t.Sex, t.Year, t.Age, s.Age - t.Age AS d, s.value AS y,
         CASE WHEN s.value IS NOT NULL THEN pow(1 - pow(abs(s.Age - t.Age) / 6.0, 3), 3) END AS w
  FROM moved t JOIN moved s ON s.series = t.series AND s.Sex = t.Sex AND s.Year = t.Year
                               AND s.Age BETWEEN t.Age - 5 AND t.Age + 5),
smooth AS (
  SELECT series, Sex, Year, Age,
         """
    + LINEAR
    + """ AS value
  FROM near GROUP BY series, Sex, Year, Age)"""
)


@query(
    with_views(
        ["v_rates", "v_births"],
        MIGRATION
        + """, shared AS (
  SELECT m.series, m.Year, m.Age, (m.value + f.value) / 2 AS value
  FROM smooth m JOIN smooth f ON m.series = f.series AND m.Year = f.Year AND m.Age = f.Age
  WHERE m.Sex = 'Male' AND f.Sex = 'Female' AND m.value + f.value IS NOT NULL)"""
        + _drift_sql("shared", ["series"])
        + f"SELECT series, Year, Age, {r('value')} AS half_sum FROM ahead",
    )
)
def migration_model(spark, sf_dir):
    """Net migration by growth balance, smoothed over age without weights, both sexes
    forecast together by half sums and half differences; the half sum is compared."""
    moved = accounting.net_migration(_population(spark, sf_dir), _deaths(spark, sf_dir), ["series"])
    smooth = curves.smooth_by_age(moved, SERIES, value="net_migration", weight=None)
    ahead = rate_models.coherent_forecast(smooth.withColumnRenamed("smooth", "value"), ["series"], log=False)
    shared = curves.sum_difference(ahead, ["series"]).select("series", "Year", "Age", "half_sum")
    return rounded(shared, "half_sum")


@query(
    with_views(
        ["v_file", "v_hist"],
        f""", merged AS (
  SELECT Year, Age, births / females AS rate, females AS exposure FROM {CELLS}
  UNION ALL
  SELECT Year, Age, rate, exposure FROM v_hist WHERE Year < (SELECT min(Year) FROM {CELLS})),
logs AS (
  SELECT Year, Age, ln(greatest(rate, {FLOOR})) AS value, greatest(rate, {FLOOR}) * exposure AS weight
  FROM merged WHERE rate IS NOT NULL),
near AS (
  SELECT t.Year, t.Age, s.Age - t.Age AS d, s.value AS y, s.weight * pow(1 - pow(abs(s.Age - t.Age) / 6.0, 3), 3) AS w
  FROM logs t JOIN logs s ON s.Year = t.Year AND s.Age BETWEEN t.Age - 5 AND t.Age + 5),
smooth AS (
  SELECT '{FERTILITY_REGION}' AS Region, Year, Age,
         {LINEAR} AS value
  FROM near GROUP BY Year, Age)"""
        + _drift_sql("smooth", ["Region"])
        + f"SELECT Region, Year, Age, {r('value')} AS fitted FROM ahead",
    )
)
def fertility_model(spark, sf_dir):
    """A new fertility file joined to the history, smoothed over age, fitted and forecast.
    Eleven components of twelve years leave nothing out."""
    merged = fertility.merge_fertility(
        V.fertility_history(spark, sf_dir), V.fertility_file(spark, sf_dir), FERTILITY_REGION
    )
    logs = curves.log_rates(merged.where("rate IS NOT NULL"), FLOOR).withColumn("Region", F.lit(FERTILITY_REGION))
    smooth = curves.smooth_by_age(logs, ["Region"]).withColumnRenamed("smooth", "value")
    return rounded(rate_models.component_forecast(smooth, ["Region"], components=11), "fitted")
