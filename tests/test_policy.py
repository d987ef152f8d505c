import pytest

from agestrata.functions.ages import age_label, months_from_years
from agestrata.operators import filters
from agestrata.operators.policy import attach_scheme, policy_schedule, year_spine
from pyspark.sql import functions as F

POP = "Year int, Sex string, Age int, Population double"


@pytest.fixture(scope="module")
def published(spark):
    rows = policy_schedule(year_spine(spark)).collect()
    return {(r.Policy, r.Year): r.age_months for r in rows}


def test_every_policy_and_year(published):
    assert len(published) == 3 * 131


def test_all_are_65_up_to_2016(published):
    assert {a for (_, y), a in published.items() if y <= 2016} == {780}


def test_current_reaches_67_in_2023(published):
    assert published["Current", 2022] == 66.5 * 12 and published["Current", 2023] == 67 * 12
    assert published["Current", 2050] == 67 * 12


def test_proposed_reaches_70_in_2035(published):
    assert published["Proposed", 2034] < 70 * 12 and published["Proposed", 2035] == 70 * 12
    assert published["Proposed", 2050] == 70 * 12


def test_order_is_the_rank(spark):
    rows = policy_schedule(year_spine(spark, 2020, 2020)).orderBy("policy_rank").collect()
    assert [r.Policy for r in rows] == ["Proposed", "Current", "Age65"]


def test_labels_and_months(table):
    df = table([(804,), (810,), (815,)], "m int").select(age_label(F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == ["67Y", "67Y+6M", "67Y+11M"]
    # Twelve steps of a twelfth fall short of a year in floating point.
    year = 67.0
    for _ in range(12):
        year += 1 / 12
    got = table([(year,)], "a double").select(months_from_years(F.col("a")).alias("m")).first()
    assert got.m == 816


def test_years_outside_the_scheme_get_the_lowest_age_met(table):
    pop = table([(y, "Male", 70, 1.0) for y in (2000, 2001, 2005)], POP)
    scheme = table([(2001, 810), (2005, 804), (2010, 700)], "Year int, age_months int")
    got = {r.Year: r.age_months for r in attach_scheme(pop, scheme).collect()}
    # 2010 is lower still, but no row of the population is from that year.
    assert got == {2000: 804, 2001: 810, 2005: 804}
    bare = {r.Year: r.age_months for r in attach_scheme(pop, scheme, fill=False).collect()}
    assert bare[2000] is None


def test_fill_per_group(table):
    pop = table(
        [("a", 2000, "Male", 70, 1.0), ("a", 2001, "Male", 70, 1.0), ("b", 2000, "Male", 70, 1.0),
         ("b", 2005, "Male", 70, 1.0)],
        "Rep string, " + POP,
    )
    scheme = table([(2001, 810), (2005, 804)], "Year int, age_months int")
    rows = attach_scheme(pop, scheme, fill_keys=["Rep"]).collect()
    assert {(r.Rep, r.Year): r.age_months for r in rows} == {
        ("a", 2000): 810, ("a", 2001): 810, ("b", 2000): 804, ("b", 2005): 804,
    }


def test_two_ages_for_one_year_are_refused(table):
    pop = table([(2000, "Male", 70, 1.0)], POP)
    scheme = table([(2000, 780), (2000, 792)], "Year int, age_months int")
    with pytest.raises(Exception, match="two pension ages"):
        attach_scheme(pop, scheme).collect()


def test_ages_above_the_open_group(table):
    pop = table([(2000, "Male", a, 1.0) for a in (99, 100, 101, 107)], POP)
    collapsed = {r.Age: r.Population for r in filters.collapse_open_age(pop).collect()}
    assert collapsed == {99: 1.0, 100: 3.0}
    assert {r.Age for r in filters.restrict_ages(pop).collect()} == {99, 100}


def test_open_group_with_a_missing_count_is_missing(table):
    pop = table([(2000, "Male", 100, 1.0), (2000, "Male", 101, None)], POP)
    assert filters.collapse_open_age(pop).first().Population is None
    assert filters.collapse_open_age(pop, na_rm=True).first().Population == 1.0


def test_year_filters(table):
    pop = table([(y, "Male", 0, 1.0) for y in range(2000, 2006)], POP)
    assert [r.Year for r in filters.latest_year(pop).collect()] == [2005]
    history = filters.restrict_years(pop, last=2002)
    assert [r.Year for r in filters.at_horizon(pop, history, 2).collect()] == [2004]
    shifted = filters.shift_and_cap_years(pop, 1, 2003)
    assert sorted(r.Year for r in shifted.collect()) == [2001, 2002, 2003]


def test_more_years_than_a_calendar_has_are_refused(spark):
    policy_schedule(year_spine(spark, 1, 2000)).count()
    with pytest.raises(Exception, match="more than 2000 years"):
        policy_schedule(year_spine(spark, 1, 2001)).count()
