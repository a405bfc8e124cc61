import pytest
from panelkit.operators.estimators import did_table
from panelkit.sources import files
from pyspark.sql import functions as F


def test_delimited_files_are_read_by_their_schema(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tname\tvalue\n1\t"x\ty"\t2.5\nbad\tz\t\n')
    got = files.read_delimited(spark, str(tmp_path / "a.tsv"), "id long, name string, value double", ["id", "name"]).collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "x\ty"), (None, "z")]
    (tmp_path / "law.csv").write_text("state_fips,year,std_score\n01,1999,0.5\n")
    assert tuple(files.read_csv(spark, str(tmp_path / "law.csv"), "state_fips string, year int, std_score double").first()) == ("01", 1999, 0.5)


def test_price_index_is_at_month_ends(spark, tmp_path):
    (tmp_path / "cpi.csv").write_text("observation_date,value\n2004-12-01,190.3\n2005-02-01,191.8\n")
    got = files.read_price_index(spark, str(tmp_path / "cpi.csv")).collect()
    assert [(str(r["month_end"]), r["cpi"]) for r in got] == [("2004-12-31", 190.3), ("2005-02-28", 191.8)]


def test_stages_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    for rebuild, times in ((False, 1), (False, 1), (True, 2)):
        assert files.cached(spark, path, build, rebuild).count() == 3 and len(built) == times


def test_a_build_that_died_is_not_read(spark, tmp_path):
    path = str(tmp_path / "stage")
    bad = spark.range(4, numPartitions=2).withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("ok")))
    with pytest.raises(Exception, match="lost"):
        files.cached(spark, path, lambda: bad)
    assert sorted(r["id"] for r in files.cached(spark, path, lambda: spark.range(2)).collect()) == [0, 1]
    with pytest.raises(Exception, match="lost"):
        files.cached(spark, path, lambda: bad, rebuild=True)
    assert files.cached(spark, path, lambda: bad).count() == 2  # the build before still stands
    files.cached(spark, path, lambda: spark.range(5), rebuild=True)
    assert len(list((tmp_path / "stage").glob("build-*"))) == 1
    files.drop_cached(spark, path)
    assert not (tmp_path / "stage").exists()


def test_changed_inputs_are_noticed(spark, tmp_path):
    source, path, built = str(tmp_path / "in"), str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("a b", F.col("id") * 2)

    spark.range(3).write.parquet(source)
    for n, times in ((3, 1), (3, 1)):
        assert files.cached(spark, path, build, inputs=[source]).count() == n and len(built) == times
    spark.range(7).write.mode("append").parquet(source)
    got = files.cached(spark, path, build, inputs=[source, str(tmp_path / "absent")])
    assert got.count() == 10 and got.columns == ["id", "a b"] and len(built) == 2


def test_law_panel_has_one_row_per_state_and_year(spark, tmp_path):
    (tmp_path / "law.csv").write_text("state_fips,year,std_score\n1,1999,0.5\n6.0,1999,\n06,2000,-1\nPR,1999,2\nPR,1999,3\n")
    got = {(r["state_fips"], r["filing_year"], r["std_score"]) for r in files.read_law_panel(spark, str(tmp_path / "law.csv")).collect()}
    assert got == {("01", 1999, 0.5), ("06", 1999, None), ("06", 2000, -1.0), (None, 1999, 2.0), (None, 1999, 3.0)}
    (tmp_path / "twice.csv").write_text("state_fips,year,std_score\n1,1999,0.5\n01,1999,0.7\n")
    with pytest.raises(Exception, match="not unique"):
        files.read_law_panel(spark, str(tmp_path / "twice.csv")).collect()


def test_panels_and_results_are_written(spark, tmp_path):
    d = spark.createDataFrame([(1, 1999, 2.0), (2, 2000, None)], "id long, data_year int, v double")
    files.write_panel(d, str(tmp_path / "panel"))
    assert (tmp_path / "panel" / "data_year=1999").is_dir()
    back = files.read_panels(spark, str(tmp_path), ["panel"])["panel"]
    assert sorted(map(tuple, back.select("id", "data_year", "v").collect())) == [(1, 1999, 2.0), (2, 2000, None)]
    plan = back.where("data_year = 2000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_year" in plan
    files.write_result(d, str(tmp_path / "result"))
    assert len(list((tmp_path / "result").glob("part-*.csv"))) == 1


def test_parameters_reach_the_estimators(spark):
    p = files.Parameters(alpha=0.5, seed=3)
    d = spark.range(200).select((F.col("id") % 20).alias("e"), F.floor(F.col("id") / 20).alias("t"), F.rand(p.seed).alias("y"), ((F.col("id") % 20 < 10) & (F.col("id") >= 100)).cast("int").alias("d"))
    got = did_table(d, ["y"], "e", "t", "d", alpha=p.alpha).first()
    assert got["significant"] == (got["p"] < 0.5)
    with pytest.raises(AttributeError):
        p.alpha = 1
