"""Moving-window refits against a refit of every origin by itself."""

import numpy as np
import pytest

from agestrata.operators import folds, rate_models, rolling

SHAPE = "series string, Year int, Age int, value double"


def gappy(seed, shift=0.0, years=14, ages=7):
    """Curves with absent cells, NULL cells, an age unknown in early years, a missing year."""
    rng = np.random.default_rng(seed)
    rows = []
    for series in ("a", "b"):
        for t in range(years):
            for age in range(ages):
                value = shift + float(rng.normal(0, 1) + 0.3 * t * age)
                if (series, t) == ("b", 5) or rng.random() < 0.08 or (age == 6 and t < 4):
                    continue
                rows.append((series, 1990 + t, age, None if rng.random() < 0.08 or (age == 5 and t < 6) else value))
    return rows


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_each_origin_as_by_itself(table, shift):
    df = table(gappy(1, shift), SHAPE)
    origins = folds.fold_table(df, 5, 2)
    got = {
        (r.series, r.id, r.Year, r.Age): r.fitted
        for r in rolling.rolling_fits(df, origins, ["series"], 2, 3).collect()
    }
    training = df.join(folds.fold_years(origins, "train"), "Year")
    alone = rate_models.component_forecast(training, ["series", "id"], 2, 3).collect()
    want = {(r.series, r.id, r.Year, r.Age): r.fitted for r in alone}
    assert got.keys() == want.keys() and len({k[1] for k in got}) == 7
    assert any(v is None for v in want.values())
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9)), k


def test_returning_scores_as_by_themselves(table):
    rows = [(s, *r) for r in gappy(2) if r[3] is not None for s in ("Male", "Female")]
    rng = np.random.default_rng(5)
    rows = [(series, sex, y, age, float(np.exp(0.1 * v + rng.normal(0, 0.1)))) for sex, series, y, age, v in rows]
    df = table(rows, "series string, Sex string, Year int, Age int, value double")
    origins = folds.fold_table(df, 6, 2)
    for log in (True, False):
        got = {
            (r.series, r.id, r.Sex, r.Year, r.Age): r.value
            for r in folds.rolling_coherent_forecast(df, origins, ["series"], 2, 2, log=log).collect()
        }
        training = df.join(folds.fold_years(origins, "train"), "Year")
        alone = rate_models.coherent_forecast(training, ["series", "id"], 2, 2, log=log).collect()
        want = {(r.series, r.id, r.Sex, r.Year, r.Age): r.value for r in alone}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v, rel=1e-8, abs=1e-9) for k, v in want.items())


def test_rows_that_enter_python_do_not_grow_with_origins(table):
    df = table([("a", 1990 + t, age, float(t * age)) for t in range(30) for age in range(9)], SHAPE)
    assert rolling.packed_years(df, ["series"]).count() == 30
    origins = folds.fold_table(df, 10, 1)
    out = rolling.rolling_fits(df, origins, ["series"], 1, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select("id").distinct().count() == 19
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Join" not in plan


def test_windows_in_any_order():
    rng = np.random.default_rng(7)
    x = rng.normal(5, 1, (12, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    moments = rolling._Moments(x)
    for lo, hi in [(0, 5), (1, 6), (1, 9), (3, 9), (9, 12), (2, 4), (2, 12)]:
        part = x[lo:hi]
        mu, matrix, known = moments.move(lo, hi)
        mean = np.array([np.nanmean(c) if (~np.isnan(c)).any() else np.nan for c in part.T])
        centered = np.nan_to_num(part - mean)
        np.testing.assert_allclose((mu + moments.shift)[known], mean[known], atol=1e-12)
        np.testing.assert_allclose(matrix, centered.T @ centered, atol=1e-11)


def test_no_origins_no_keys_and_bad_cells(table):
    rows = [r[1:] for r in gappy(3) if r[0] == "a" and r[3] is not None]
    df = table(rows, "Year int, Age int, value double")
    assert rolling.rolling_fits(df, folds.fold_table(df, 50, 2), [], 2).collect() == []
    assert rolling.rolling_fits(df.limit(0), folds.fold_table(df, 5, 2), [], 2).collect() == []
    one = rolling.rolling_fits(df, folds.fold_table(df, 5, 2), [], 2)
    assert one.columns == ["id", "train_to", "Year", "Age", "fitted"] and one.count() > 0
    with_nulls = df.unionByName(table([(None, 1, 1.0), (1990, None, 1.0)], df.schema))
    assert rolling.rolling_fits(with_nulls, folds.fold_table(df, 5, 2), [], 2).count() == one.count()
    with pytest.raises(Exception, match="two rows"):
        rolling.rolling_fits(df.union(df), folds.fold_table(df, 5, 2), [], 2).collect()
