import numpy as np
import pytest

from agestrata.operators import components, curves, gaps, rate_models

SHAPE = "series string, Year int, Age int, value double"


def _flat(rng, years, ages, rank):
    """A table of exactly ``rank`` components beside its mean curve."""
    parts = [np.outer(rng.normal(size=years) * (rank - j), rng.normal(size=ages)) for j in range(rank)]
    return -5 + rng.normal(size=ages) + sum(parts)


def _rows(x, known, name="s"):
    return [(name, 1990 + i, j, float(v) if known[i, j] else None) for (i, j), v in np.ndenumerate(x)]


def _parts(df, keys, count, value="value"):
    fit = gaps.gappy_fit(df, keys, count, value).cache()
    mean = {r.Age: r for r in gaps.gappy_mean(fit, keys).collect()}
    basis = {(r.j, r.Age): r for r in gaps.gappy_basis(fit, keys).collect()}
    return fit, mean, basis, {(r.Year, r.j): r.beta for r in gaps.gappy_scores(fit, keys).collect()}


def test_a_tenth_of_the_cells_of_a_flat_table_missing(spark):
    rng = np.random.default_rng(5)
    x = _flat(rng, 25, 40, 2)
    known = rng.random(x.shape) >= 0.1
    whole = spark.createDataFrame(_rows(x, np.ones_like(known)), SHAPE)
    _, mean, basis, scores = _parts(spark.createDataFrame(_rows(x, known), SHAPE), ["series"], 2)
    centered = curves.center_curves(whole, ["series"])
    plain = components.leading_components(centered, ["series"], 2)
    for r in plain.collect():
        assert basis[r.j, r.Age].phi == pytest.approx(r.phi, abs=1e-6)
        assert basis[r.j, r.Age].share == pytest.approx(r.share, abs=1e-6)
    for r in components.component_scores(centered, plain, ["series"], 2).collect():
        assert scores[r.Year, r.j] == pytest.approx(r.beta, abs=1e-6)
    assert [mean[a].mu for a in range(40)] == pytest.approx(x.mean(axis=0), abs=1e-6)
    assert all(r.residual < 1e-12 for r in mean.values())


def test_complete_curves_have_the_plain_components(spark):
    x = _flat(np.random.default_rng(6), 12, 9, 5)
    df = spark.createDataFrame(_rows(x, np.ones(x.shape, bool)), SHAPE)
    for level in (None, 80):
        plain = rate_models.component_forecast(df, ["series"], 4, 3, level=level)
        filled = rate_models.component_forecast(df, ["series"], 4, 3, level=level, fill=True)
        assert plain.columns == filled.columns
        want = {(r.Year, r.Age): r[3:] for r in plain.collect()}
        got = {(r.Year, r.Age): r[3:] for r in filled.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)


def test_noise_is_not_carried_into_missing_cells(spark):
    rng = np.random.default_rng(1)
    x = _flat(rng, 48, 60, 2)
    noisy, known = x + rng.normal(0, 0.05, x.shape), rng.random(x.shape) >= 0.3
    # More components than there are, so the rest of them follow noise.
    mu, phi, _, scores, fitted = gaps._nearest(np.where(known, noisy, np.nan), 6)
    off = (fitted - x)[~known]
    assert np.sqrt((off**2).mean()) < 0.05
    assert np.allclose(phi.T @ phi, np.eye(6), atol=1e-9)
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(mu + scores @ phi.T, fitted)


def test_fitted_cells_stay_when_filled_again():
    """The end of the fit, by its own definition: components of the filled table, drawn in,
    fill it as it is."""
    rng = np.random.default_rng(8)
    x = _flat(rng, 20, 30, 2) + rng.normal(0, 0.1, (20, 30))
    known = rng.random(x.shape) >= 0.2
    gappy = np.where(known, x, np.nan)
    mu, _, _, _, fitted = gaps._nearest(gappy, 3)
    # Filled cells from the definition, by many plain rounds from the fit.
    filled = np.where(known, x, fitted)
    for _ in range(4000):
        mean = filled.mean(axis=0)
        u, s, v = np.linalg.svd(filled - mean, full_matrices=False)
        drawn = s[:3] * (1 - s[3] ** 2 / s[:3] ** 2)
        again = mean + (u[:, :3] * drawn) @ v[:3]
        if np.abs(again - filled)[~known].max() < 1e-12:
            break
        filled = np.where(known, x, again)
    assert mu == pytest.approx(filled.mean(axis=0), abs=1e-7)


def test_pairwise_moments(spark, monkeypatch):
    monkeypatch.setattr(gaps, "YEARS_PER_BLOCK", 4)
    rng = np.random.default_rng(9)
    x, known = rng.normal(size=(11, 5)), rng.random((11, 5)) >= 0.4
    df = spark.createDataFrame(_rows(x, known), SHAPE)
    got = {(r.Age_i, r.Age_j): r for r in gaps.pairwise_covariance(curves.center_curves(df, ["series"]), ["series"]).collect()}
    c = np.where(known, x - np.where(known, x, 0).sum(axis=0) / known.sum(axis=0), 0)
    n = known.T.astype(int) @ known
    for i in range(5):
        for j in range(5):
            if not n[i, j]:
                assert (i, j) not in got
                continue
            assert got[i, j].years == n[i, j]
            assert got[i, j].moment == pytest.approx((c[:, i] * c[:, j]).sum() / n[i, j])


def test_cells_that_nothing_decides(spark):
    none = float("nan")
    rows = [("a", 2000 + y, a, float(y * (a + 1))) for y in range(5) for a in range(3)]
    rows += [("a", 2000, 7, None), ("a", 2001, 7, none), ("a", 2009, 1, None), ("a", 2002, 8, 4.0)]
    rows += [("one year", 2000, 0, 1.0), ("one year", 2000, 1, 2.0)]
    rows += [("nothing", 2000, 0, None), ("nothing", 2001, 0, none)]
    df = spark.createDataFrame(rows, SHAPE)
    fit = gaps.gappy_fit(df, ["series"], 1)
    mean = {(r.series, r.Age): r.mu for r in gaps.gappy_mean(fit, ["series"]).collect()}
    assert {k for k in mean if k[0] == "a"} == {("a", a) for a in (0, 1, 2, 7, 8)}
    assert mean["a", 7] is None and mean["a", 2] == pytest.approx(6.0, abs=1e-6)
    # One value of an age: nothing says how the age moves beside it.
    assert mean["a", 8] is not None and np.isfinite(mean["a", 8])
    assert mean["one year", 1] == 2.0 and not any(k[0] == "nothing" for k in mean)
    scores = gaps.gappy_scores(fit, ["series"]).collect()
    assert {(r.series, r.Year) for r in scores} == {("a", 2000 + y) for y in range(5)}
    ahead = rate_models.component_forecast(df, ["series"], 2, 1, fill=True).collect()
    assert {r.series for r in ahead} == {"a"}
    assert {r.Age for r in ahead if r.fitted is None} == {7}


def test_no_keys_no_rows_and_clashing_names(spark):
    x = _flat(np.random.default_rng(3), 8, 6, 1)
    known = np.ones(x.shape, bool)
    known[2, 3] = known[5, 0] = False
    df = spark.createDataFrame(_rows(x, known), SHAPE).selectExpr("*", "1 AS mu", "2 AS _ages", "3 AS phi")
    _, mean, basis, scores = _parts(df, [], 1)
    assert len(mean) == len(basis) == 6 and len(scores) == 8
    out = rate_models.component_forecast(df, ["series"], 1, 1, fill=True).collect()
    assert len(out) == 6 and all(r.fitted is not None for r in out)
    empty = rate_models.component_forecast(df.where("false"), ["series"], 1, 1, level=80, fill=True)
    assert empty.columns == ["series", "Year", "Age", "fitted", "lower", "upper"] and not empty.collect()


def test_repeated_and_infinite_cells_are_refused(spark):
    for bad in ([("s", 2000, 1, 1.0)] * 2, [("s", 2000, 1, float("inf"))]):
        with pytest.raises(Exception, match="two rows for one cell|an infinite cell"):
            gaps.gappy_fit(spark.createDataFrame(bad, SHAPE), ["series"], 1).collect()


@pytest.mark.parametrize("log", [True, False])
def test_both_sexes_with_gaps(spark, log):
    """Gaps of tables with one component a part are filled, so the forecast is that of the
    whole tables."""
    rng = np.random.default_rng(11)
    shared, apart = _flat(rng, 15, 8, 1), 0.1 * _flat(rng, 15, 8, 1)
    known = rng.random(shared.shape) >= 0.1
    sexes = {"Male": shared + apart, "Female": shared - apart}
    shape = "Sex string, Year int, Age int, value double"

    def table(there):
        rows = [(s, 1990 + i, j, float(np.exp(v) if log else v)) for s, x in sexes.items()
                for (i, j), v in np.ndenumerate(x) if there[i, j]]
        return spark.createDataFrame(rows, shape)

    want = rate_models.coherent_forecast(table(known | True), horizon=3, components=1, log=log, level=80)
    got = rate_models.coherent_forecast(table(known), horizon=3, components=1, log=log, level=80, fill=True)
    want, got = ({(r.Sex, r.Year, r.Age): r[3:] for r in df.collect()} for df in (want, got))
    assert got.keys() == want.keys() and len(got) == 48
    assert all(got[k] == pytest.approx(want[k], rel=1e-5) for k in want)
