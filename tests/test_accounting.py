import math
import random

import pytest

from agestrata.operators import accounting, fertility, reshape

RATES = "series string, Sex string, Year int, Age int, rate double"
POP = "series string, Sex string, Year int, Age int, Population double"


def loop_life_table(m):
    """Ages 0..len(m)-1, the last one open; radix 1."""
    top = len(m) - 1
    l, out = 1.0, []
    for age, rate in enumerate(m):
        q = 1.0 if age == top else min(1.0, rate / (1 + 0.5 * rate))
        d = l * q
        lived = l / rate if age == top else l - 0.5 * d
        out.append([q, l, d, lived])
        l -= d
    for age in range(top + 1):
        lived, nxt = out[age][3], out[age + 1][3] if age < top else None
        if age == top:
            part, whole = lived, out[age - 1][3] + lived
        elif age == top - 1:
            part, whole = nxt, lived + nxt
        else:
            part, whole = nxt, lived
        out[age].append(part / whole if whole else None)
    return out


def random_rates(seed, top=100):
    rng = random.Random(seed)
    return [rng.uniform(0, 0.02) + 0.00005 * math.exp(0.09 * a) for a in range(top + 1)]


@pytest.mark.parametrize("extreme", [False, True])
def test_life_table_against_a_loop(table, extreme):
    m = random_rates(1)
    if extreme:
        m[90] = 3.0  # everybody dies
    df = table([("s", "Male", 2000, a, r) for a, r in enumerate(m)], RATES)
    got = {r.Age: r for r in accounting.life_table(df).collect()}
    for age, (q, l, d, lived, survival) in enumerate(loop_life_table(m)):
        row = got[age]
        assert row.q == pytest.approx(q)
        assert row.l == pytest.approx(l, abs=1e-12)
        assert row.d == pytest.approx(d, abs=1e-12)
        assert row.lived == pytest.approx(lived, abs=1e-12)
        assert row.survival == (None if survival is None else pytest.approx(survival))


def test_unknown_rate_leaves_later_ages_unknown(table):
    df = table([("s", "Male", 2000, a, None if a == 5 else 0.1) for a in range(10)], RATES)
    got = {r.Age: r.l for r in accounting.life_table(df).collect()}
    assert got[5] is not None and got[6] is None and got[9] is None


def test_closed_population_has_no_migration(table):
    """People only age, die by the life table and are born: the balance is zero."""
    top, years, ratio = 100, range(2000, 2004), 1.05
    rng = random.Random(4)
    m = {s: random_rates(i) for i, s in enumerate(("Male", "Female"))}
    life = {s: loop_life_table(m[s]) for s in m}
    pop = {s: [rng.uniform(100, 200) for _ in range(top + 1)] for s in m}
    rows, births = [], []
    for y in years:
        rows += [("s", s, y, a, p) for s in pop for a, p in enumerate(pop[s])]
        mothers = {a: rng.uniform(1, 5) for a in range(15, 50)}
        births += [("s", y, a, b) for a, b in mothers.items()]
        total = sum(mothers.values())
        for s in pop:
            born = total * (ratio if s == "Male" else 1) / (1 + ratio)
            survival = [x[4] for x in life[s]]
            aged = [born * life[s][0][3]]
            aged += [pop[s][a] * survival[a] for a in range(top - 1)]
            aged += [pop[s][top - 1] * survival[top - 1] + pop[s][top] * survival[top]]
            pop[s] = aged
    people = table(rows, POP)
    rates = table([("s", s, y, a, r) for s in m for y in years for a, r in enumerate(m[s])], RATES)
    newborn = accounting.births_by_sex(table(births, "series string, Year int, Age int, births double"), ["series"])
    deaths = accounting.cohort_deaths(people, accounting.life_table(rates), newborn, ["series"])
    got = accounting.net_migration(people, deaths, ["series"]).collect()
    assert len(got) == 2 * 101 * (len(years) - 1)
    assert max(abs(r.net_migration) for r in got) < 1e-9


def test_births_split_by_sex(table):
    df = table([(2000, 20, 41.0), (2000, 30, 164.0)], "Year int, Age int, births double")
    got = {r.Sex: r.births for r in accounting.births_by_sex(df).collect()}
    assert got["Male"] == pytest.approx(105.0) and got["Female"] == pytest.approx(100.0)


def test_central_rates_of_an_empty_cell(table):
    df = table([("s", "Male", 2000, 1, 0.0, 0.0), ("s", "Male", 2000, 2, 1.0, 4.0)],
               "series string, Sex string, Year int, Age int, events double, exposure double")
    got = {r.Age: r.rate for r in accounting.central_rates(df).collect()}
    assert got == {1: None, 2: 0.25}


def test_cohort_join(table):
    rows = [(y, "Male", a, float(100 * y + a)) for y in (1, 2) for a in (0, 1, 3)]
    df = table(rows, "Year int, Sex string, Age int, Population double")
    got = [(r.Year, r.Age, r.next_population) for r in accounting.cohort_join(df).collect()]
    assert got == [(1, 0, 201.0)]


FILE = "Region string, Age string, Time int, Measure string, Value double"
HISTORY = "Year int, Age int, rate double, exposure double"


def test_new_fertility_replaces_old_years(table):
    file = table(
        [
            ("Here", "20", 2001, "Births", 2.0),
            ("Here", "20", 2001, "Female population", 10_000.0),
            ("Here", "20", 2002, "Births", 3.0),
            ("Here", "20", 2002, "Female population", 10_000.0),
            ("Here", "15-19", 2002, "Births", 9.0),
            ("Here", "020", 2002, "Births", 9.0),
            ("Here", "55", 2002, "Births", 9.0),
            ("There", "20", 1990, "Births", 9.0),
            ("Here", "20", 2002, "Rate", 9.0),
        ],
        FILE,
    )
    history = table([(2000, 20, 0.1, 50.0), (2001, 20, 0.9, 50.0), (2003, 20, 0.9, 50.0)], HISTORY)
    got = {r.Year: (r.rate, r.exposure) for r in fertility.merge_fertility(history, file, "Here").collect()}
    assert got.keys() == {2000, 2001, 2002}
    assert got[2000] == (pytest.approx(0.1), 50.0)
    assert got[2001] == (0.2, 10_000.0) and got[2002] == (0.3, 10_000.0)


def test_no_new_year_keeps_all_history(table):
    history = table([(2000, 20, 0.1, 50.0)], HISTORY)
    assert reshape.append_after(history, history.where("Year > 3000")).count() == 1


def test_repeated_fertility_cell_is_refused(table):
    rows = [(2001, 20, "Births", 2.0), (2001, 20, "Births", 2.0)]
    df = table(rows, "Year int, Age int, Measure string, Value double")
    with pytest.raises(Exception, match="two rows for one cell"):
        fertility.births_and_pop(df).collect()


def test_nobody_is_known_after_a_missing_age(table):
    rows = [("a", "Male", 2000, age, 0.5) for age in (0, 1, 2, 4, 5)] + [("b", "Male", 2000, age, 0.5) for age in (1, 2)]
    got = accounting.life_table(table(rows, "series string, Sex string, Year int, Age int, rate double")).collect()
    alive = {(r.series, r.Age): r.l for r in got}
    assert [alive["a", x] for x in (0, 1, 2)] == pytest.approx([1, 0.6, 0.36])
    assert [alive[k] for k in (("a", 4), ("a", 5), ("b", 1), ("b", 2))] == [None] * 4


def test_no_cell_of_the_balance_is_lost(table):
    cell = "Sex string, Year int, Age int, "
    pop = table(
        [("Male", 2000, 1, 10.0), ("Male", 2001, 2, 8.0), ("Male", 2001, 7, 5.0), ("Male", 2000, 3, 4.0)], cell + "Population double"
    )
    life = table([("Male", 2000, 1, 0.9, 1.0, 1.0)], cell + "survival double, lived double, l double")
    births = table([("Male", 2000, 6.0)], "Sex string, Year int, births double")
    deaths = accounting.cohort_deaths(pop, life, births)
    rows = {(r.Year, r.Age): (r.start, r.deaths) for r in deaths.collect()}
    # No survival at age 3 and no age 0 in the life table: who was there stays.
    assert rows[2000, 2] == pytest.approx((10.0, 1.0)) and rows[2000, 4] == (4.0, None) and rows[2000, 0] == (6.0, None)
    got = {(r.Year, r.Age): r.net_migration for r in accounting.net_migration(pop, deaths).collect()}
    assert got == {(2000, 2): pytest.approx(-1.0), (2000, 7): None, (2000, 4): None, (2000, 0): None}
    zero = {(r.Year, r.Age): r.net_migration for r in accounting.net_migration(pop, deaths, absent_is_zero=True).collect()}
    assert zero[2000, 7] == 5.0 and zero[2000, 4] is None and zero[2000, 2] == pytest.approx(-1.0)
