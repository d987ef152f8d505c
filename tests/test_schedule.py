import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agestrata.operators import schedule
from agestrata.operators.report import schedule_report, side_by_side
from agestrata.plans import views
from tests.test_ratio import SIM, by_rows, simulated

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sim(spark):
    return views.sim(spark, SF, F.col("l_orderkey") % 10).cache()


# Known from a month-by-month search written without Spark.
@pytest.mark.parametrize(
    "target, expected", [(0.60, [792, 804, 816, 818, 822, 822, 823])]
)
def test_known_schedule(sim, target, expected):
    got = schedule.schedule_band(sim, 780, 1995, 2001, target).orderBy("Year").collect()
    assert [r.optimal for r in got] == expected


def month_by_month(rows, start, years, target, statistic):
    """Literal search: from last year's age, add a month while above the target, at
    most twelve times."""
    age, out = start, {}
    for year in years:
        reps = {}
        for rep, y, *rest in rows:
            if y == year:
                reps.setdefault(rep, []).append((y, *rest))
        first = age
        while statistic([by_rows(r, age) for r in reps.values()]) > target and age - first < 12:
            age += 1
        out[year] = age
    return out


STATISTICS = {
    "lower": lambda x: np.quantile(x, 0.1),
    "optimal": np.mean,
    "upper": lambda x: np.quantile(x, 0.9),
}


@pytest.mark.parametrize("target", [0.42, 0.5, 0.6, 0.75])
def test_band_equals_the_literal_search(table, target):
    years = range(2024, 2028)
    rows = simulated(5, years, seed=11)
    got = schedule.schedule_band(table(rows, SIM), 804, 2024, 2027, target).toPandas().set_index("Year")
    for name, statistic in STATISTICS.items():
        assert got[name].to_dict() == month_by_month(rows, 804, years, target, statistic)


def test_threshold_test_equals_quantiles(table):
    """``need_months`` decides from counts what the grid decides from quantiles."""
    rows = simulated(7, (2024, 2025), seed=3)
    ratios = schedule.candidate_ratios(table(rows, SIM), 804, 2024, 2025).cache()
    grid = schedule.oadr_grid(ratios).cache()
    levels = grid.toPandas()
    # Targets between and exactly at attained values.
    targets = list(np.linspace(levels.Lo.min(), levels.Hi.max(), 7)) + [levels.OADR.median()]
    for target in targets:
        direct = schedule.need_months(ratios, target).toPandas().set_index("Year")
        for name, statistic in (("lower", "Lo"), ("optimal", "OADR"), ("upper", "Hi")):
            read = schedule.need_month(grid, target, statistic).toPandas().set_index("Year").need
            for year in (2024, 2025):
                a, b = direct[name][year], read[year]
                assert a == b or (np.isnan(a) and np.isnan(b))


def test_grid_equals_the_ratio(table):
    rows = simulated(2, (2024,), seed=5)
    got = schedule.candidate_ratios(table(rows, SIM), 804, 2024, 2024).collect()
    assert len(got) == 2 * 13
    for r in got:
        part = [x[1:] for x in rows if x[0] == r.Rep]
        assert r.OADR == pytest.approx(by_rows(part, r.age_months), rel=1e-12)


NEED = "Year int, need int"


@pytest.mark.parametrize(
    "needs, expected",
    [
        ([700, 700, 700], [780, 780, 780]),  # below the start
        ([None, None, None], [792, 804, 816]),  # out of reach
        ([900, 785, 786], [792, 792, 792]),  # far above, then met
        ([781, 830, 800], [781, 793, 800]),  # the cap binds once
    ],
)
def test_capped_schedule(table, needs, expected):
    need = table([(2000 + i, n) for i, n in enumerate(needs)], NEED)
    got = schedule.capped_schedule(need, 780, 2000, 2002).orderBy("Year").collect()
    assert [r.age_months for r in got] == expected


def test_schedules_per_key(table):
    need = table(
        [("a", 2000, 785), ("a", 2001, 790), ("b", 2000, None), ("b", 2001, 781)],
        "country string, " + NEED,
    )
    got = schedule.capped_schedule(need, 780, 2000, 2001, ["country"]).collect()
    assert {(r.country, r.Year): r.age_months for r in got} == {
        ("a", 2000): 785, ("a", 2001): 790, ("b", 2000): 792, ("b", 2001): 792,
    }


def test_year_without_people_raises(table):
    need = table([(2000, 781), (2002, 781)], NEED)
    with pytest.raises(Exception, match="no simulated population"):
        schedule.capped_schedule(need, 780, 2000, 2002).collect()


def test_steps_stay_within_the_cap_and_bands_are_ordered(table):
    rng = random.Random(2)
    for _ in range(3):
        rows = simulated(4, range(2024, 2030), seed=rng.randint(0, 10_000))
        band = schedule.schedule_band(table(rows, SIM), 804, 2024, 2029, rng.uniform(0.3, 0.8))
        got = band.orderBy("Year").toPandas()
        for name in ("lower", "optimal", "upper"):
            steps = np.diff(np.r_[804, got[name]])
            assert steps.min() >= 0 and steps.max() <= 12
        assert (got.lower <= got.upper).all()


def test_ages_beyond_the_table_leave_no_pensioners(table):
    rows = [r for r in simulated(1, (2024,)) if r[3] <= 60]
    got = schedule.candidate_ratios(table(rows, SIM), 804, 2024, 2024).collect()
    assert {r.OADR for r in got} == {None}


def test_report_layout(table):
    rows = table([(2019 + i, 804 + i) for i in range(12)], "Year int, age_months int")
    labels = schedule_report(rows)
    wide = side_by_side(labels, ["age_months"], 2019, 2030, block=10).orderBy("row").collect()
    assert len(wide) == 10
    assert (wide[0].Year_1, wide[0].age_months_1, wide[0].Year_2, wide[0].age_months_2) == (
        2019, "67Y", 2029, "67Y+10M",
    )
    assert wide[2].Year_2 is None


def test_two_sided_report(table):
    rows = table([(2019, 804, 810)], "Year int, lower int, upper int")
    first = schedule_report(rows, ["lower", "upper"]).first()
    assert (first.lower, first.upper) == ("67Y", "67Y+6M")


def test_a_key_without_a_year_does_not_stop_the_others(table):
    need = table(
        [("a", 2000, 790), ("a", 2001, 795), ("b", 2000, 790)], "country string, Year int, need int"
    )
    got = {(r.country, r.Year): r.age_months for r in schedule.capped_schedule(need, 780, 2000, 2001, ["country"]).collect()}
    assert got == {("a", 2000): 790, ("a", 2001): 795, ("b", 2000): None, ("b", 2001): None}


def _stored(spark, tmp_path, rows):
    path = str(tmp_path / "sim")
    spark.createDataFrame(rows, SIM).write.parquet(path)
    return spark.read.parquet(path)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_search_and_its_ratios_read_the_simulation_once(spark, tmp_path):
    sim = _stored(spark, tmp_path, simulated(3, range(2024, 2026)))
    ratios = schedule.candidate_ratios(sim, 804, 2024, 2025)
    bands = {name: name for name in ("lower", "optimal", "upper")}
    band = schedule.capped_schedule(schedule.need_months(ratios, 0.2), 804, 2024, 2025, columns=bands)
    plan = _final_plan(schedule.searched_ratios(ratios, band))
    assert plan.count("FileScan parquet") == 1


def test_ratios_of_a_search_equal_a_second_pass(table):
    sim = table(simulated(5, range(2024, 2027)), SIM)
    ratios = schedule.candidate_ratios(sim, 804, 2024, 2026)
    band = schedule.schedule_band(sim, 804, 2024, 2026, 0.2)
    once = schedule.searched_ratios(ratios, band).orderBy("Policy", "Year").collect()
    again = schedule.oadr_under_band(sim, band, fill=False).orderBy("Policy", "Year").collect()
    assert [(r.Policy, r.Year) for r in once] == [(r.Policy, r.Year) for r in again]
    for a, b in zip(once, again):
        assert (a.Lo, a.Hi, a.OADR) == pytest.approx((b.Lo, b.Hi, b.OADR))


def test_a_pyramid_reads_the_years_it_shows(spark, tmp_path):
    from agestrata.operators import summary

    sim = _stored(spark, tmp_path, simulated(3, range(2024, 2030)))
    history = sim.where("Rep = 0 AND Year < 2026").drop("Rep")
    df = summary.pyramid_table(history, sim, ahead=3)
    rows = df.where("Mean IS NOT NULL").collect()
    assert {r.Year for r in rows} == {2028}


def test_one_impossible_start_leaves_the_others(spark, table):
    rows = simulated(2, range(2024, 2026))
    sim = table([(c, *r) for c in "abc" for r in rows], "country string, " + SIM)
    starts = spark.createDataFrame([("a", 700), ("b", 804), ("c", 150), ("d", None)], "country string, start_month int")
    one = schedule.candidate_ratios(sim.where("country = 'b'"), 804, 2024, 2025, ["country"])
    by_key = schedule.candidate_ratios(sim, starts, 2024, 2025, ["country"], ages=(60, 80))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, by_key.collect()))
    free = schedule.candidate_ratios(sim, starts, 2024, 2025, ["country"])
    assert {r.country for r in free.select("country").distinct().collect()} == {"a", "b"}
    band = schedule.schedule_band(sim, starts, 2024, 2025, 0.2, keys=["country"], ages=(60, 80)).collect()
    assert {(r.country, r.Year) for r in band} == {(c, y) for c in "abcd" for y in (2024, 2025)}
    assert all((r.optimal is None) == (r.country != "b") for r in band)
    alone = schedule.schedule_band(sim.where("country = 'b'").drop("country"), 804, 2024, 2025, 0.2).collect()
    assert sorted((r.Year, r.optimal) for r in alone) == sorted((r.Year, r.optimal) for r in band if r.country == "b")
