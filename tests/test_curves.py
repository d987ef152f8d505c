import numpy as np
import pandas as pd
import pytest

from agestrata.operators import components, curves, folds, forecast, rate_models
from agestrata.operators.policy import year_spine

AGES, YEARS = np.arange(101), np.arange(1950, 1990)


def surface(seed, ages=AGES, years=YEARS):
    rng = np.random.default_rng(seed)
    base = -8 + 0.08 * ages
    time = np.cumsum(rng.normal(-0.02, 0.05, len(years)))
    shape = np.exp(-((ages - 40) / 30.0) ** 2)
    return base + np.outer(time, shape) + rng.normal(0, 0.05, (len(years), len(ages)))


def long(spark, surfaces, ages=AGES, years=YEARS):
    parts = []
    for name, x in surfaces.items():
        y, a = np.meshgrid(years, ages, indexing="ij")
        parts.append(pd.DataFrame({"series": name, "Year": y.ravel(), "Age": a.ravel(), "value": x.ravel()}))
    frame = pd.concat(parts).sample(frac=1, random_state=1)
    return spark.createDataFrame(frame, "series string, Year int, Age int, value double")


def wide(df, value, columns="Age"):
    return df.toPandas().pivot(index="Year", columns=columns, values=value).sort_index()


def test_smoother_is_weighted_least_squares(spark):
    rng = np.random.default_rng(0)
    ages = np.delete(np.arange(31), [7, 8, 20])
    frame = pd.DataFrame({"series": "s", "Year": 2000, "Age": ages, "value": rng.normal(size=len(ages)),
                          "weight": rng.uniform(1, 50, len(ages))})
    df = spark.createDataFrame(frame, "series string, Year int, Age int, value double, weight double")
    got = curves.smooth_by_age(df, ["series"], bandwidth=4).toPandas().set_index("Age").smooth
    assert sorted(got.index) == list(ages)
    for target in ages:
        d = ages - target
        k = np.where(abs(d) <= 4, (1 - (abs(d) / 5.0) ** 3) ** 3, 0) * frame.weight
        x = np.c_[np.ones(len(d)), d]
        beta = np.linalg.lstsq(x * np.sqrt(k.values)[:, None], frame.value * np.sqrt(k), rcond=None)[0]
        assert got[target] == pytest.approx(beta[0], abs=1e-10)


def test_smoother_with_one_age_in_reach(table):
    df = table([("s", 2000, 1, 3.0, 2.0), ("s", 2000, 50, 4.0, 2.0)],
               "series string, Year int, Age int, value double, weight double")
    got = {r.Age: r.smooth for r in curves.smooth_by_age(df, ["series"]).collect()}
    assert got == {1: pytest.approx(3.0), 50: pytest.approx(4.0)}


def test_years_are_not_mixed(table):
    rows = [("s", y, a, float(y), 1.0) for y in (1, 2) for a in range(20)]
    df = table(rows, "series string, Year int, Age int, value double, weight double")
    for r in curves.smooth_by_age(df, ["series"]).collect():
        assert r.smooth == pytest.approx(r.Year)


def test_log_of_an_empty_cell(table):
    df = table([(2000, 1, 0.0, 10.0), (2000, 2, 0.5, 10.0)], "Year int, Age int, rate double, exposure double")
    assert [r.Age for r in curves.log_rates(df).collect()] == [2]
    floored = {r.Age: r.value for r in curves.log_rates(df, 0.01).collect()}
    assert floored[1] == pytest.approx(np.log(0.01))


def test_pairs_round_trip(table):
    rows = [(s, 2000, a, float(a + 1 + (s == "Male"))) for s in ("Male", "Female") for a in range(5)]
    df = table(rows, "Sex string, Year int, Age int, value double")
    for forth, back in (
        (curves.product_ratio, curves.recombine_product_ratio),
        (curves.sum_difference, curves.recombine_sum_difference),
    ):
        got = {(r.Sex, r.Year, r.Age): r.value for r in back(forth(df)).collect()}
        assert got == {(s, y, a): pytest.approx(v) for s, y, a, v in rows}


def test_repeated_cell_is_refused(table):
    rows = [("Male", 2000, 1, 1.0), ("Male", 2000, 1, 2.0), ("Female", 2000, 1, 2.0)]
    with pytest.raises(Exception, match="two rows for one cell"):
        curves.pair_sexes(table(rows, "Sex string, Year int, Age int, value double")).collect()


@pytest.fixture(scope="module")
def fitted(spark):
    surfaces = {"a": surface(1), "b": surface(2)}
    df = long(spark, surfaces).cache()
    centered = curves.center_curves(df, ["series"]).cache()
    covariance = components.curve_covariance(centered, ["series"]).cache()
    basis = components.principal_components(covariance, ["series"]).cache()
    scores = components.component_scores(centered, basis, ["series"]).cache()
    return surfaces, df, centered, covariance, basis, scores


def test_covariance_is_the_matrix_product(fitted):
    surfaces, _, _, covariance, _, _ = fitted
    frame = covariance.toPandas()
    for name, x in surfaces.items():
        x = x - x.mean(axis=0)
        got = frame[frame.series == name].pivot(index="Age_i", columns="Age_j", values="moment")
        np.testing.assert_allclose(got.to_numpy(), x.T @ x, atol=1e-10)


def test_blocks_of_years_add_up(spark, monkeypatch):
    monkeypatch.setattr(components, "YEARS_PER_BLOCK", 7)
    ages, years = np.arange(6), np.arange(1990, 2031)
    x = surface(5, ages, years)
    x -= x.mean(axis=0)
    df = long(spark, {"s": x}, ages, years).withColumnRenamed("value", "centered")
    got = components.curve_covariance(df, ["series"]).toPandas()
    got = got.pivot(index="Age_i", columns="Age_j", values="moment").to_numpy()
    np.testing.assert_allclose(got, x.T @ x, atol=1e-12)


def test_components_against_svd(fitted):
    surfaces, df, _, _, basis, scores = fitted
    loadings, frame = basis.toPandas(), scores.toPandas()
    for name, x in surfaces.items():
        x = x - x.mean(axis=0)
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        share = s**2 / (s**2).sum()
        mine = loadings[loadings.series == name]
        got_share = mine.groupby("j").share.first().to_numpy()
        np.testing.assert_allclose(got_share, share[:6], atol=1e-10)
        assert (np.diff(got_share) <= 1e-12).all() and got_share.sum() <= 1 + 1e-12
        phi = mine.pivot(index="Age", columns="j", values="phi").to_numpy()
        np.testing.assert_allclose(phi.T @ phi, np.eye(6), atol=1e-10)
        beta = frame[frame.series == name].pivot(index="Year", columns="j", values="beta").to_numpy()
        np.testing.assert_allclose(beta @ phi.T, (u[:, :6] * s[:6]) @ vt[:6], atol=1e-8)
        assert all(c[np.abs(c).argmax()] > 0 for c in phi.T)


def test_reconstruction_does_not_depend_on_signs(fitted):
    surfaces, df, centered, _, basis, scores = fitted
    mu = curves.mean_curve(df, ["series"])
    flipped = basis.withColumn("phi", -basis.phi)
    other = components.component_scores(centered, flipped, ["series"])
    one = components.reconstruct(mu, basis, scores, ["series"])
    two = components.reconstruct(mu, flipped, other, ["series"]).withColumnRenamed("fitted", "again")
    both = one.join(two, ["series", "Year", "Age"]).toPandas()
    assert len(both) == 2 * len(AGES) * len(YEARS)
    np.testing.assert_allclose(both.fitted, both.again, atol=1e-10)
    x = surfaces["a"]
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = x.mean(axis=0) + (u[:, :6] * s[:6]) @ vt[:6]
    np.testing.assert_allclose(wide(one.where("series = 'a'"), "fitted").to_numpy(), want, atol=1e-8)


def test_drift(table):
    df = table([("a", 2000, 1.0), ("a", 2002, 2.0), ("a", 2004, 5.0), ("b", 2000, 7.0)],
               "k string, Year int, beta double")
    got = {(r.k, r.h): (r.Year, r.beta) for r in forecast.drift_forecast(df, ["k"], 2).collect()}
    assert got == {("a", 1): (2005, 6.0), ("a", 2): (2006, 7.0), ("b", 1): (2001, 7.0), ("b", 2): (2002, 7.0)}


def test_mean_reversion(spark, table):
    rng = np.random.default_rng(6)
    y = [0.3]
    for _ in range(60):
        y.append(0.1 + 0.7 * y[-1] + rng.normal(0, 0.05))
    df = table([("a", 1950 + i, float(v)) for i, v in enumerate(y)], "k string, Year int, beta double")
    got = [r.beta for r in forecast.mean_reverting_forecast(df, ["k"], 200).orderBy("h").collect()]
    slope, intercept = np.polyfit(y[:-1], y[1:], 1)
    last = y[-1]
    for value in got[:5]:
        last = intercept + slope * last
        assert value == pytest.approx(last)
    assert got[-1] == pytest.approx(intercept / (1 - slope))


def test_mean_reversion_of_short_and_exploding_series(table):
    df = table([("one", 2000, 4.0)] + [("up", 2000 + i, 2.0**i) for i in range(8)],
               "k string, Year int, beta double")
    got = forecast.mean_reverting_forecast(df, ["k"], 3).toPandas()
    assert (got[got.k == "one"].beta == 4.0).all()
    assert np.isfinite(got.beta).all()


def test_nineteen_origins(spark):
    rows = folds.fold_table(year_spine(spark, 1950, 2018), 25, 25).orderBy("id").collect()
    assert len(rows) == 19
    assert tuple(rows[0]) == (1, 1950, 1974, 1975, 1975, 1999)
    assert tuple(rows[-1]) == (19, 1968, 1992, 1993, 1993, 2017)


def test_too_few_years_have_no_origin(spark):
    assert folds.fold_table(year_spine(spark, 2000, 2004), 3, 2).count() == 0


def test_errors_by_horizon(table):
    rolling = table([(1, 2001, 0.2), (1, 2000, 0.1), (2, 2001, 0.4), (2, 2002, 0.5)],
                    "id int, Year int, OADR double")
    actual = table([(2000, 0.2), (2001, 0.3)], "Year int, OADR double")
    errors = folds.backtest_errors(rolling, actual).cache()
    assert {(r.id, r.Year): r.h for r in errors.collect()} == {(1, 2000): 1, (1, 2001): 2, (2, 2001): 1, (2, 2002): 2}
    rmse = {r.h: r.RMSE for r in folds.horizon_rmse(errors).collect()}
    assert rmse[1] == pytest.approx(0.1) and rmse[2] is None
    kept = {r.h: r.RMSE for r in folds.horizon_rmse(errors, na_rm=True).collect()}
    assert kept[2] == pytest.approx(0.1)
    assert {r.h: r.MAE for r in folds.horizon_mae(errors).collect()}[1] == pytest.approx(0.1)


def test_rolling_forecast_against_numpy(spark):
    ages, years = np.arange(12), np.arange(2000, 2016)
    x = surface(9, ages, years)
    df = long(spark, {"s": x}, ages, years)
    origins = folds.fold_table(df, 8, 3)
    got = folds.rolling_rate_forecast(df, origins, ["series"], 3, components=2).toPandas()
    assert sorted(got.id.unique()) == list(range(1, 6))
    for origin in range(1, 6):
        train = x[origin - 1 : origin + 7]
        mean = train.mean(axis=0)
        u, s, vt = np.linalg.svd(train - mean, full_matrices=False)
        beta = u[:, :2] * s[:2]
        for h in (1, 2, 3):
            want = mean + (beta[-1] + h * (beta[-1] - beta[0]) / 7) @ vt[:2]
            part = got[(got.id == origin) & (got.h == h)].sort_values("Age")
            assert set(part.Year) == {2000 + origin + 6 + h}
            np.testing.assert_allclose(part.fitted, want, atol=1e-8)
    errors = folds.rolling_rate_backtest(df, origins, ["series"], 3, components=2).toPandas()
    assert len(errors) == 3 and errors.RMSE.notna().all()


def numpy_parts(x, components, horizon, revert):
    """Forecast of one part, with numpy: drift, or return to the mean."""
    mean = x.mean(axis=0)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    beta = (u * s)[:, :components]
    ahead = []
    for b in beta.T:
        if revert:
            slope, intercept = np.polyfit(b[:-1], b[1:], 1)
            slope = np.clip(slope, -0.99, 0.99)
            level = (b[1:].mean() - slope * b[:-1].mean()) / (1 - slope)
            ahead.append([level + slope**h * (b[-1] - level) for h in range(1, horizon + 1)])
        else:
            drift = (b[-1] - b[0]) / (len(b) - 1)
            ahead.append([b[-1] + h * drift for h in range(1, horizon + 1)])
    return mean + np.array(ahead).T @ vt[:components]


@pytest.mark.parametrize("log", [True, False])
def test_coherent_forecast_against_numpy(spark, log):
    ages, years = np.arange(15), np.arange(1990, 2015)
    male, female = surface(11, ages, years), surface(12, ages, years)
    scale = np.exp if log else (lambda x: x)
    df = long(spark, {"Male": scale(male), "Female": scale(female)}, ages, years)
    df = df.withColumnRenamed("series", "Sex")
    got = rate_models.coherent_forecast(df, horizon=4, components=3, log=log)
    shared = numpy_parts((male + female) / 2, 3, 4, revert=False)
    apart = numpy_parts((male - female) / 2, 3, 4, revert=True)
    for sex, want in (("Male", shared + apart), ("Female", shared - apart)):
        part = wide(got.where(f"Sex = '{sex}'"), "value")
        assert list(part.index) == [2015, 2016, 2017, 2018]
        np.testing.assert_allclose(part.to_numpy(), scale(want), atol=1e-8)


@pytest.mark.parametrize("weight", ["weight", None])
def test_a_constant_curve_with_gaps_stays_constant(table, weight):
    rows = [("a", 2000, age, None if age in (0, 5, 6, 17) else 10.0, float(1 + age % 4)) for age in range(20)]
    curve = table(rows, "series string, Year int, Age int, value double, weight double")
    got = curves.smooth_by_age(curve, ["series"], weight=weight).collect()
    assert len(got) == 20 and all(r.smooth == pytest.approx(10.0) for r in got)


def test_a_missing_weight_counts_as_a_missing_value(table):
    rows = [("a", 2000, age, 1000.0 if age == 5 else 10.0, None if age == 5 else 1.0) for age in range(12)]
    curve = table(rows, "series string, Year int, Age int, value double, weight double")
    assert all(r.smooth == pytest.approx(10.0) for r in curves.smooth_by_age(curve, ["series"]).collect())


def test_unpaired_cells_stay_unless_dropped(table):
    rows = [("Male", 2000, 1, 4.0), ("Female", 2000, 1, 1.0), ("Male", 2000, 2, 9.0)]
    df = table(rows, "Sex string, Year int, Age int, value double")
    got = {r.Age: (r.Male, r.Female) for r in curves.pair_sexes(df).collect()}
    assert got == {1: (4.0, 1.0), 2: (9.0, None)}
    assert {r.Age: r["product"] for r in curves.product_ratio(df).collect()} == {1: 2.0, 2: None}
    kept = curves.pair_cells(df, ["Year", "Age"], "Sex", ["Male", "Female"], "value", drop_unpaired=True)
    assert [r.Age for r in kept.collect()] == [1]


def test_packed_moments_give_the_same_components(table):
    rng = np.random.default_rng(8)
    rows = [
        ("a", year, age, float(rng.normal()))
        for year in [*range(2000, 2004), *range(2600, 2604)]
        for age in range(10) if (year, age) != (2601, 3) and not (year > 2500 and age == 9)
    ]
    centered = curves.center_curves(table(rows, "series string, Year int, Age int, value double"), ["series"])
    by_rows = components.principal_components(components.curve_covariance(centered, ["series"]), ["series"], 3)
    packed = components.leading_components(centered, ["series"], 3)
    a, b = ({(r.j, r.Age): (r.phi, r.share) for r in df.collect()} for df in (by_rows, packed))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_repeated_and_infinite_cells_are_refused(table):
    shape = "series string, Year int, Age int, centered double"
    for bad, message in (([("a", 1, 1, 1.0), ("a", 1, 1, 2.0)], "two rows"), ([("a", 1, 1, float("inf"))], "infinite")):
        with pytest.raises(Exception, match=message):
            components.leading_components(table(bad, shape), ["series"]).collect()


def test_intervals_of_scores(table):
    values = [1.0, 2.5, 3.0, 5.5, 6.0]
    df = table([("a", 2000 + i, v) for i, v in enumerate(values)], "k string, Year int, beta double")
    steps = np.diff(values)
    z, v, n = 1.2815515655446004, steps.var(ddof=1), len(steps)
    for r in forecast.drift_forecast(df, ["k"], 5, level=80).collect():
        mean = values[-1] + r.h * steps.mean()
        half = z * np.sqrt(v * r.h * (1 + r.h / n))
        assert (r.beta, r.lower, r.upper) == pytest.approx((mean, mean - half, mean + half))
    short = forecast.mean_reverting_forecast(df.where("Year < 2002"), ["k"], 2, level=80).collect()
    assert all(r.lower is None and r.beta is not None for r in short)


def test_coherent_rolling_errors_are_those_of_each_origin(table):
    rng = np.random.default_rng(3)
    rows = [
        ("a", sex, 1990 + t, age, float(np.exp(rng.normal(0, 0.1) - 4 + 0.05 * age - 0.02 * t)))
        for sex in ("Male", "Female") for t in range(8) for age in range(6)
    ]
    df = table(rows, "series string, Sex string, Year int, Age int, value double")
    origins = folds.fold_table(df, 4, 2)
    got = {(r.Sex, r.h): r.RMSE for r in folds.rolling_coherent_backtest(df, origins, ["series"], 2, 2).collect()}
    actual = {(r[1], r[2], r[3]): r[4] for r in rows}
    errors = {}
    for o in origins.collect():
        training = df.where(f"Year BETWEEN {o.train_from} AND {o.train_to}")
        for r in rate_models.coherent_forecast(training, ["series"], 2, 2).collect():
            errors.setdefault((r.Sex, r.Year - o.train_to), []).append(actual[r.Sex, r.Year, r.Age] - r.value)
    assert got.keys() == errors.keys()
    assert all(got[k] == pytest.approx(np.sqrt(np.mean(np.square(e)))) for k, e in errors.items())


def _wave(rng, years, ages):
    """Curves of two components and some noise."""
    t, a = np.arange(years), np.arange(ages)
    return (
        -3 + 0.05 * a + np.outer(np.cumsum(rng.normal(0.1, 0.3, years)), np.cos(a / 3))
        + np.outer(np.cumsum(rng.normal(0, 0.2, years)), np.sin(a / 2)) + rng.normal(0, 0.02, (years, ages))
    )


def _parts(x, components, horizon, reverting):
    """Forecast and variance of curves by the formulas written out."""
    mu = x.mean(axis=0)
    c = x - mu
    phi = np.linalg.svd(c, full_matrices=False)[2][:components]
    beta = c @ phi.T
    residual = ((c - beta @ phi) ** 2).sum(axis=0) / (len(x) - 1)
    h, n = np.arange(1, horizon + 1)[:, None], len(x) - 1
    mean, var = np.tile(mu, (horizon, 1)), np.tile(residual, (horizon, 1))
    for b, p in zip(beta.T, phi):
        if reverting:
            s, _ = np.polyfit(b[:-1], b[1:], 1)
            s = np.clip(s, -0.99, 0.99)
            level = (b[1:].mean() - s * b[:-1].mean()) / (1 - s)
            e = (b[1:] - b[1:].mean()) - s * (b[:-1] - b[:-1].mean())
            mean = mean + (level + s**h * (b[-1] - level)) * p
            var = var + (e**2).sum() / (n - 2) * (1 - s ** (2 * h)) / (1 - s * s) * p**2
        else:
            d = np.diff(b)
            mean = mean + (b[-1] + h * d.mean()) * p
            var = var + d.var(ddof=1) * h * (1 + h / n) * p**2
    return mean, var


@pytest.mark.parametrize("components", [1, 2])
def test_intervals_of_curves(spark, components):
    from statistics import NormalDist

    from agestrata.operators import rate_models

    rng, z = np.random.default_rng(21), NormalDist().inv_cdf(0.9)
    x = _wave(rng, 14, 9)
    rows = [("s", 2000 + i, j, float(v)) for (i, j), v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, "series string, Year int, Age int, value double")
    mean, var = _parts(x, components, 5, False)
    got = rate_models.component_forecast(df, ["series"], 5, components, level=80).collect()
    assert len(got) == 45
    for r in got:
        at = (r.Year - 2014, r.Age)
        assert [r.fitted, r.lower, r.upper] == pytest.approx(
            [mean[at], mean[at] - z * var[at] ** 0.5, mean[at] + z * var[at] ** 0.5], rel=1e-9
        )
    plain = rate_models.component_forecast(df, ["series"], 5, components)
    assert plain.columns == ["series", "Year", "Age", "fitted"]


@pytest.mark.parametrize("log", [True, False])
def test_intervals_of_both_sexes(spark, log):
    from statistics import NormalDist

    from agestrata.operators import rate_models

    rng, z = np.random.default_rng(22), NormalDist().inv_cdf(0.975)
    sexes = {"Male": _wave(rng, 15, 6), "Female": _wave(rng, 15, 6)}
    rows = [(s, 2000 + i, j, float(np.exp(v) if log else v)) for s, x in sexes.items() for (i, j), v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, "Sex string, Year int, Age int, value double")
    shared, apart = (sexes["Male"] + sexes["Female"]) / 2, (sexes["Male"] - sexes["Female"]) / 2
    (m0, v0), (m1, v1) = _parts(shared, 1, 4, False), _parts(apart, 1, 4, True)
    got = rate_models.coherent_forecast(df, [], 4, 1, log=log, level=95).collect()
    assert len(got) == 48
    for r in got:
        at = (r.Year - 2015, r.Age)
        mean = m0[at] + m1[at] * (1 if r.Sex == "Male" else -1)
        ends = [mean, mean - z * (v0[at] + v1[at]) ** 0.5, mean + z * (v0[at] + v1[at]) ** 0.5]
        assert [r.value, r.lower, r.upper] == pytest.approx(np.exp(ends) if log else ends, rel=1e-8)
