import random

import pandas as pd
import pytest

from agestrata.operators import ratio
from agestrata.operators.policy import attach_scheme, policy_schedule, year_spine

POP = "Year int, Sex string, Age int, Population double"
SIM = "Rep long, " + POP
SCHEME = "Year int, age_months int"


def people(seed, years=(2000,), ages=range(101), whole=True):
    rng = random.Random(seed)
    draw = (lambda: float(rng.randint(1, 500))) if whole else (lambda: rng.uniform(0, 500))
    return [(y, s, a, draw()) for y in years for s in ("Male", "Female") for a in ages]


def by_rows(rows, age_months):
    """The ratio by moving people from row to row: one year, ages in order per sex."""
    whole, part = divmod(age_months, 12)
    work = pension = 0.0
    for sex in ("Male", "Female"):
        counts = {a: p for _, s, a, p in rows if s == sex}
        for age, count in counts.items():
            if part and age == whole:
                count = count * part / 12
            elif part and age == whole + 1:
                count = count + (1 - part / 12) * counts.get(whole, 0.0)
            if age * 12 >= age_months:
                pension += count
            elif age >= 15:
                work += count
    return pension / work


@pytest.mark.parametrize("months", [780, 804, 810, 811, 839, 1199])
@pytest.mark.parametrize("whole", [True, False])
def test_equals_the_row_form(table, months, whole):
    rows = people(months, whole=whole)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    scheme = table([(2000, months)], SCHEME)
    for order in (rows, shuffled):
        got = ratio.oadr(table(order, POP), scheme).first().OADR
        assert got == pytest.approx(by_rows(rows, months), rel=1e-12)


@pytest.mark.parametrize("months", [804, 810])
def test_split_rows_give_the_same_groups(table, months):
    rows = people(5)
    aged = attach_scheme(table(rows, POP), table([(2000, months)], SCHEME))
    split = ratio.split_partial_age(aged).groupBy("Group").sum("Population").toPandas()
    sums = dict(zip(split["Group"], split["sum(Population)"]))
    wide = ratio.group_population(aged).first().asDict()
    for group in ("Child", "Workers", "Pension"):
        assert wide[group] == pytest.approx(sums[group])
    assert sum(sums.values()) == pytest.approx(sum(r[3] for r in rows))


def test_missing_ages(table):
    """Without the pension age's own row nobody is split. Without the next row, the
    pensioners of the split age still count."""
    scheme = table([(2000, 810)], SCHEME)
    rows = people(7)
    without_67 = [r for r in rows if r[2] != 67]
    got = ratio.oadr(table(without_67, POP), scheme).first().OADR
    older = sum(r[3] for r in without_67 if r[2] > 67)
    younger = sum(r[3] for r in without_67 if 15 <= r[2] < 67)
    assert got == pytest.approx(older / younger)

    without_68 = [r for r in rows if r[2] != 68]
    at = sum(r[3] for r in rows if r[2] == 67)
    older = sum(r[3] for r in rows if r[2] > 68)
    younger = sum(r[3] for r in rows if 15 <= r[2] < 67)
    got = ratio.oadr(table(without_68, POP), scheme).first().OADR
    assert got == pytest.approx((older + at / 2) / (younger + at / 2))


def test_no_workers_or_no_pensioners_is_null(table):
    scheme = table([(2000, 780), (2001, 780), (2002, 780)], SCHEME)
    pop = table(
        [(2000, "Male", 80, 5.0), (2001, "Male", 30, 5.0), (2002, "Male", 30, 0.0), (2002, "Male", 80, 1.0)],
        POP,
    )
    got = {r.Year: r.OADR for r in ratio.oadr(pop, scheme).collect()}
    assert got == {2000: None, 2001: None, 2002: None}


def test_no_scheme_year_at_all_is_null(table):
    pop = table(people(1), POP)
    assert ratio.oadr(pop, table([(1990, 780)], SCHEME)).first().OADR is None


def test_missing_population(table):
    rows = people(3)
    scheme = table([(2000, 780)], SCHEME)
    adult = [(y, s, a, None if (s, a) == ("Male", 40) else p) for y, s, a, p in rows]
    child = [(y, s, a, None if (s, a) == ("Male", 4) else p) for y, s, a, p in rows]
    assert ratio.oadr(table(adult, POP), scheme).first().OADR is None
    assert ratio.oadr(table(adult, POP), scheme, na_rm=True).first().OADR is not None
    assert ratio.oadr(table(child, POP), scheme).first().OADR == pytest.approx(by_rows(rows, 780))


def test_keys_run_series_side_by_side(table):
    rows = [(k, *r) for k in ("x", "y") for r in people(k == "x", (2000, 2001))]
    scheme = table([(2000, 790), (2001, 810)], SCHEME)
    got = ratio.oadr(table(rows, "country string, " + POP), scheme, ["country"]).collect()
    assert len(got) == 4
    for r in got:
        part = [x[1:] for x in rows if x[0] == r.country and x[1] == r.Year]
        assert r.OADR == pytest.approx(by_rows(part, {2000: 790, 2001: 810}[r.Year]))


def simulated(reps, years, seed=0):
    return [(rep, *row) for rep in range(reps) for row in people(seed + rep, years)]


def test_all_policies_in_one_pass(spark, table):
    years = range(2015, 2026)
    rows = simulated(9, years)
    sim = table(rows, SIM)
    policy = policy_schedule(year_spine(spark, 2017, 2025))
    ages = {(r.Policy, r.Year): r.age_months for r in policy.collect()}
    got = ratio.oadr_by_policy(sim, policy).toPandas()
    assert len(got) == 3 * len(years)
    for row in got.itertuples():
        lowest = min(a for (p, _), a in ages.items() if p == row.Policy)
        months = ages.get((row.Policy, row.Year), lowest)
        ratios = pd.Series(
            [by_rows([r[1:] for r in rows if r[0] == k and r[1] == row.Year], months) for k in range(9)]
        )
        assert row.OADR == pytest.approx(ratios.mean())
        assert row.Lo == pytest.approx(ratios.quantile(0.1))
        assert row.Hi == pytest.approx(ratios.quantile(0.9))
    single = ratio.oadr_sim(sim, policy.where("Policy = 'Current'")).toPandas()
    both = got[got.Policy == "Current"].merge(single, on="Year")
    assert len(both) == len(years)
    assert both.OADR_x.values == pytest.approx(both.OADR_y.values)
    assert both.Lo_x.values == pytest.approx(both.Lo_y.values)


def test_fill_per_replicate(table):
    """Replicate 1 never meets the low age of 2002, so its 1999 is filled higher."""
    rows = [r for r in simulated(2, (1999, 2001, 2002)) if (r[0], r[1]) != (1, 2002)]
    policy = [(2001, "P", 810), (2002, "P", 790)]
    ages = {(0, 1999): 790, (1, 1999): 810}
    scheme = table([(y, m) for y, _, m in policy], SCHEME)
    named = table(policy, "Year int, Policy string, age_months int")
    sim = table(rows, SIM)
    want = sum(
        by_rows([r[1:] for r in rows if r[:2] == (rep, 1999)], m) for (rep, _), m in ages.items()
    ) / 2
    for out in (
        ratio.oadr_sim(sim, scheme, fill_keys=["Rep"]),
        ratio.oadr_by_policy(sim, named, ["P"], fill_keys=["Rep"]),
    ):
        assert {r.Year: r.OADR for r in out.collect()}[1999] == pytest.approx(want)


def test_policy_without_a_year_is_null_when_not_filled(table):
    sim = table(simulated(2, (2000, 2001)), SIM)
    policy = table([(2000, "P", 780)], "Year int, Policy string, age_months int")
    got = ratio.oadr_by_policy(sim, policy, ["P"], fill=False).collect()
    assert {r.Year: r.OADR is None for r in got} == {2000: False, 2001: True}


def test_policy_with_two_ages_is_refused(table):
    sim = table(simulated(1, (2000,)), SIM)
    policy = table([(2000, "P", 780), (2000, "P", 792)], "Year int, Policy string, age_months int")
    with pytest.raises(Exception, match="two pension ages"):
        ratio.oadr_by_policy(sim, policy, ["P"]).collect()


def test_simulation_is_scanned_once(spark, tmp_path):
    """Both quantile passes share the shuffle behind the ratios."""
    path = str(tmp_path / "sim")
    spark.createDataFrame(simulated(3, (2000, 2001)), SIM).write.parquet(path)
    policy = policy_schedule(year_spine(spark, 2000, 2001))
    df = ratio.oadr_by_policy(spark.read.parquet(path), policy, fill=False)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1
    assert "Sex" not in plan.split("ReadSchema")[1]


def file_scans(plan):
    """Numbers of the file scans that ran; what is reused did not run again."""
    name = plan.getClass().getSimpleName()
    if name.startswith("Reused"):
        return set()
    if name == "AdaptiveSparkPlanExec":
        return file_scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return file_scans(plan.plan())
    below = [of.apply(i) for of in (plan.children(), plan.subqueries()) for i in range(of.size())]
    return {plan.id()} if name == "FileSourceScanExec" else set().union(*map(file_scans, below))


@pytest.mark.parametrize("fill_keys", [[], ["Rep"]])
@pytest.mark.parametrize("many", [False, True])
def test_filling_reads_the_simulation_once(spark, table, tmp_path, fill_keys, many):
    path = str(tmp_path / "sim")
    table(simulated(3, (1999, 2000, 2001)), SIM).write.parquet(path)
    sim, policy = spark.read.parquet(path), policy_schedule(year_spine(spark, 2000, 2001))
    if many:
        df = ratio.oadr_by_policy(sim, policy, fill_keys=fill_keys)
    else:
        df = ratio.oadr_sim(sim, policy.where("Policy = 'Current'"), fill_keys=fill_keys)
    df.collect()
    assert len(file_scans(df._jdf.queryExecution().executedPlan())) == 1


def test_filled_by_sex_and_policy(table):
    """Schemes by sex that lack a year for one sex or one policy: each cell takes its own
    policy's lowest age that the population meets, and the sexes are added after that."""
    rows = simulated(2, (1999, 2000))
    ages = {("P", "Male", 2000): 790, ("P", "Female", 2000): 775, ("P", "Male", 1999): 811,
            ("Q", "Female", 1999): 800, ("Q", "Male", 2000): 826, ("Q", "Male", 1990): 700}
    lowest = {"P": 775, "Q": 800}
    policy = table([(y, s, p, m) for (p, s, y), m in ages.items()], "Year int, Sex string, Policy string, age_months int")
    out = ratio.oadr_by_policy(table(rows, SIM), policy, ["P", "Q"], on=["Year", "Sex"], level=80)
    got = {(r.Policy, r.Year): r.OADR for r in out.collect()}
    for name in ("P", "Q"):
        for year in (1999, 2000):
            of = []
            for rep in (0, 1):
                work = pension = 0.0
                for sex in ("Male", "Female"):
                    m = ages.get((name, sex, year), lowest[name])
                    for _, _, _, age, people_ in (r for r in rows if r[:3] == (rep, year, sex)):
                        share = min(12, max(0, (age + 1) * 12 - m))
                        pension += people_ * share
                        work += people_ * (12 - share) * (age >= 15)
                of.append(pension / work)
            assert got[name, year] == pytest.approx(sum(of) / 2, rel=1e-12)


def test_nothing_to_fill_from(table):
    """No year of the scheme is met, or the scheme is empty: NULL, and every year is there."""
    sim = table(simulated(1, (2000, 2001)), SIM)
    for scheme in ([(1900, 780)], []):
        got = ratio.oadr_sim(sim, table(scheme, SCHEME)).collect()
        assert {r.Year: r.OADR for r in got} == {2000: None, 2001: None}
    named = table([(1900, "P", 780)], "Year int, Policy string, age_months int")
    got = ratio.oadr_by_policy(sim, named, ["P"]).collect()
    assert {r.Year: r.OADR for r in got} == {2000: None, 2001: None}
    assert ratio.oadr_sim(sim.limit(0), table([(2000, 780)], SCHEME)).collect() == []


def test_ratio_does_not_rise_with_pension_age(table):
    """Sixty random populations, each with a random pension age and the next month."""
    rng = random.Random(8)
    cases = [(i, rng.randint(200, 1150)) for i in range(60)]
    pop = table([(i, *row) for i, _ in cases for row in people(i)], "case int, " + POP)
    got = []
    for later in (0, 1):
        scheme = table([(i, 2000, m + later) for i, m in cases], "case int, " + SCHEME)
        out = ratio.oadr(pop, scheme, ["case"], on=["case", "Year"])
        got.append({r.case: r.OADR for r in out.collect()})
    assert len(got[0]) == 60
    assert all(got[1][i] <= got[0][i] for i, _ in cases)


def test_unknown_ages_are_nobody(table):
    rows = people(2)
    scheme = table([(2000, 810)], SCHEME)
    got = ratio.oadr(table(rows + [(2000, "Male", None, 900.0)], POP), scheme).first().OADR
    assert got == pytest.approx(by_rows(rows, 810))
    aged = attach_scheme(table(rows, POP), table([(1990, 780)], SCHEME), fill=False)
    assert ratio.group_population(aged).first().Pension is None
