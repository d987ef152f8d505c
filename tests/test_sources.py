import pytest
from pyspark.sql import functions as F

from agestrata import schema
from agestrata.operators import reshape
from agestrata.sources import tables


def test_fertility_csv(spark, tmp_path):
    path = tmp_path / "fertility.csv"
    path.write_text(
        "Region,Age,Time,Measure,Value\n"
        'Here,15-19,2001,Births,1.5\nHere,20,2001,"Female population",1000\n'
    )
    df = tables.read_fertility_csv(spark, str(path))
    assert df.schema == schema.FERTILITY_CSV
    assert [tuple(r) for r in df.collect()] == [
        ("Here", "15-19", 2001, "Births", 1.5), ("Here", "20", 2001, "Female population", 1000.0),
    ]


def test_misordered_header_is_refused(spark, tmp_path):
    path = tmp_path / "fertility.csv"
    path.write_text("Age,Region,Time,Measure,Value\n20,Here,2001,Births,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_fertility_csv(spark, str(path)).collect()


def test_only_asked_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "pop")
    spark.createDataFrame([(2000, "Male", 1, 2.0)], schema.POPULATION).write.parquet(path)
    df = tables.read_population(spark, path).where("Year >= 2000").select("Age")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Year:int,Age:int>" in plan
    assert "GreaterThanOrEqual(Year,2000)" in plan


def test_stored_by_year_is_pruned(spark, tmp_path):
    rows = [(0, y, "Male", 1, float(y)) for y in range(2000, 2010)]
    df = spark.createDataFrame(rows, schema.SIMULATION)
    tables.save_result(df, "sim", str(tmp_path), ["Year"])
    back = tables.load_result(spark, "sim", str(tmp_path)).where("Year = 2003")
    assert "PartitionFilters: [isnotnull(Year" in back._jdf.queryExecution().executedPlan().toString()
    assert [r.Population for r in back.collect()] == [2003.0]


def test_folders_of_years_hold_few_files(spark, tmp_path):
    rows = [(i, 2000 + i % 3, "Male", i % 50, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, schema.SIMULATION).repartition(30)
    tables.save_result(df, "sim", str(tmp_path), ["Year"], files=4)
    for year in (2000, 2001, 2002):
        assert 1 <= len(list((tmp_path / "sim" / "v1" / f"Year={year}").glob("part-*"))) <= 4
    assert tables.load_result(spark, "sim", str(tmp_path)).count() == 3000


def _years(spark, folder):
    rows = tables.load_result(spark, "sim", str(folder)).groupBy("Year").agg(F.sum("Population").alias("p")).collect()
    return {r.Year: r.p for r in rows}


def test_a_failed_write_keeps_the_earlier_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_result(spark, "sim", str(tmp_path))
    df = spark.createDataFrame([(0, y, "Male", 1, 1.0) for y in (2000, 2001)], schema.SIMULATION)
    tables.save_result(df, "sim", str(tmp_path), ["Year"])
    killed = df.withColumn("Population", F.when(F.col("Year") == 2001, F.raise_error(F.lit("killed"))).otherwise(5.0).cast("double"))
    with pytest.raises(Exception, match="killed"):
        tables.save_result(killed, "sim", str(tmp_path), ["Year"])
    assert _years(spark, tmp_path) == {2000: 1.0, 2001: 1.0}
    # Loading and saving one name in one plan.
    tables.save_result(tables.load_result(spark, "sim", str(tmp_path)).withColumn("Population", F.col("Population") + 1), "sim", str(tmp_path), ["Year"])
    assert _years(spark, tmp_path) == {2000: 2.0, 2001: 2.0}


def test_only_touched_years_are_replaced_and_old_versions_go(spark, tmp_path):
    for i in range(4):
        df = spark.createDataFrame([(0, y, "Male", 1, float(i)) for y in (2000 + i, 2001 + i)], schema.SIMULATION)
        tables.save_result(df, "sim", str(tmp_path), ["Year"], replace=False)
    assert _years(spark, tmp_path) == {2000: 0.0, 2001: 1.0, 2002: 2.0, 2003: 3.0, 2004: 3.0}
    assert sorted(p.name for p in (tmp_path / "sim").iterdir()) == ["v3", "v4"]


def test_bad_lines_are_quarantined(spark, tmp_path):
    path = tmp_path / "fertility.csv"
    lines = ["Here,20,2001,Births,1.5", "Here,21,y2001,Births,2", "Here,22,2001,Births,n/a", "Here,23,2001,Births,-3",
             "Here,24,2001,Births,4", "Here,24,2001,Births,5", ",25,2001,Births,6", "There,20,2001,Births"]
    path.write_text("Region,Age,Time,Measure,Value\n" + "\n".join(lines) + "\n")
    checked = tables.read_checked(
        spark, str(path), schema.FERTILITY_CSV, keys=["Region", "Age", "Time", "Measure"], ranges={"Value": (0, 1e9)}
    )
    assert [tuple(r) for r in tables.accepted(checked, 6).orderBy("Region").collect()] == [
        ("Here", "20", 2001, "Births", 1.5), ("There", "20", 2001, "Births", None),
    ]
    # Whichever columns are asked for.
    assert sorted(r.Age for r in tables.accepted(checked, 6).select("Age").collect()) == ["20", "20"]
    bad = {(r.Age, tuple(r.problems)) for r in tables.quarantined(checked).collect()}
    assert bad == {
        ("21", ("Time is not int",)), ("22", ("Value is not double",)), ("23", ("Value is out of range",)),
        ("24", ("key comes twice",)), ("25", ("Region is missing",)),
    }
    with pytest.raises(Exception, match="6 rows have problems, at most 5"):
        tables.accepted(checked, 5).collect()


def test_results_folder_comes_from_the_session(spark):
    from agestrata.plans.registry import results_folder

    folder = results_folder(spark)
    assert folder == results_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or folder.startswith(named)


def test_arrays_to_rows(table):
    df = table([(1, 30, [10.0, 20.0, 30.0], [1.0, 2.0, 3.0])],
               "Rep int, Age int, male array<double>, female array<double>")
    one = reshape.array_to_long(df, ["Rep", "Age"], "male", 2019).collect()
    assert [(r.Year, r.Population) for r in one] == [(2019, 10.0), (2020, 20.0), (2021, 30.0)]
    both = reshape.simulation_from_arrays(df, 2019, shift=1, last=2021, divisor=10).collect()
    assert {(r.Year, r.Sex): r.Population for r in both} == {
        (2020, "Male"): 1.0, (2021, "Male"): 2.0, (2020, "Female"): 0.1, (2021, "Female"): 0.2,
    }


def test_long_wide_long(table):
    df = table([("a", 2000, 1.0), ("a", 2001, 2.0), ("b", 2001, 3.0)], "k string, Year int, v double")
    wide = reshape.long_to_wide(df, ["k"], "Year", "v", [2000, 2001])
    back = reshape.year_columns_to_long(wide, ["k"], [2000, 2001], "v").where(F.col("v").isNotNull())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="two rows for one cell"):
        reshape.long_to_wide(df.unionAll(df), ["k"], "Year", "v", [2000, 2001]).collect()


def test_labelled_and_missing_unions(table):
    a, b = table([(1,)], "x int"), table([(2,)], "y int")
    assert reshape.union_missing(a, b).columns == ["x", "y"]
    both = reshape.union_labelled({"one": a, "two": a}, "Series").collect()
    assert sorted(r.Series for r in both) == ["one", "two"]
