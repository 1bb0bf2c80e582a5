"""Files, streams and registered queries."""

import os

import pytest
from pyspark.sql import functions as F

from arborlake.sources import files
from arborlake.streaming.scoring import score_stream


@pytest.fixture
def harvest(tmp_path):
    """Fields with a soil, an area and a yield, of which one soil is written in three grades."""
    soils, lines = ["clay", "loam", "peat", "sand", "silt"], ["field,soil,area,tons,grade"]
    for i in range(175):
        area = (i * 13 % 47) / 4 + 1
        lines.append(f"f{i:03},{soils[i % 5]},{area},{area * (2 + i % 5)},{'good' if i % 5 > 2 else 'fair' if i % 5 else 'poor'}")
    path = tmp_path / "harvest.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_view_shortens_numbers_and_names_constants(spark, tmp_path, harvest):
    path = tmp_path / "runs.csv"
    path.write_text("run,loss,fit_seconds,host\nfirst,0.98765432,0.456789,north\nsecond,0.0045678,12.3456,north\nthird,0.5,3,north\n")
    assert files.view_csv(spark, str(path)) == "run,loss,fit_seconds\nfirst,0.9877,0.457\nsecond,0.004568,12.3\nthird,0.5,3\nConstants:\nhost=north\n"
    some = files.view_csv(spark, str(path), start=0, end=2)
    assert some.startswith("rows 0..2 from 3\n") and "third" not in some
    assert files.view_csv(spark, harvest, ["soil"], rows=3) == "first 3 rows from 175\nsoil\nclay\nloam\npeat\n"
    drawn = files.view_csv(spark, harvest, sample="12", seed=5)
    assert drawn.startswith("12 randomly sampled rows from 175\n") and drawn == files.view_csv(spark, harvest, sample="12", seed=5)


@pytest.mark.parametrize("bad", [{"rows": 0}, {"rows": 5, "sample": "5"}, {"start": 1, "sample": "3"}, {"start": 9, "end": 4}, {"columns": ["weather"]}, {"sample": "0%"}, {"sample": "many"}])
def test_view_refuses(spark, harvest, bad):
    with pytest.raises(ValueError):
        files.view_csv(spark, harvest, **bad)


def test_files_are_fitted_and_predicted(spark, tmp_path, harvest):
    model = files.fit_file(spark, harvest, "tons", n_trees=5, seed=3)
    files.predict_file(model, harvest, f"{tmp_path}/tons.csv")
    got = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/tons.csv")
    assert got.columns == ["prediction"] and got.count() == 175 and got.filter("prediction < 0 OR prediction > 90").count() == 0
    grades = files.fit_file(spark, harvest, "grade", task="classification", n_trees=5, seed=3)
    files.predict_file(grades, harvest, f"{tmp_path}/grades.parquet", proba=True)
    shares = spark.read.parquet(f"{tmp_path}/grades.parquet")
    assert shares.columns == ["proba_fair", "proba_good", "proba_poor"] and shares.filter("abs(proba_fair + proba_good + proba_poor - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="Arrow"):
        files.predict_file(model, harvest, f"{tmp_path}/tons.arrow")
    with pytest.raises(ValueError, match="unknown target"):
        files.fit_file(spark, harvest, "colour")
    with pytest.raises(ValueError, match="finite"):
        files.fit_file(spark, harvest, "soil")


def test_conversion_finds_numbers(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text("count,share\n" + "".join(f"{i * 3},{i / 8}\n" for i in range(64)) + ",\n12,0.5\n")
    for kind in ("parquet", "arrow"):
        files.convert_csv(spark, str(path), f"{tmp_path}/out.{kind}")
        back = files.read_table(spark, f"{tmp_path}/out.{kind}")
        assert dict(back.dtypes) == {"count": "bigint", "share": "double"} and back.count() == 66
        assert back.filter("count IS NULL AND share IS NULL").count() == 1 and back.agg(F.sum("count")).first()[0] == 3 * 2016 + 12


@pytest.mark.parametrize("text, message", [("v\n1.5\ninf\n", "non-finite"), ("v,w,v\n1,2,3\n", "unique")])
def test_files_that_cannot_be_converted(spark, tmp_path, text, message):
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(ValueError, match=message):
        files.convert_csv(spark, f"{tmp_path}/bad.csv", f"{tmp_path}/bad.parquet")


def test_stream_scores_as_a_table(spark, tmp_path, harvest):
    df = files.read_table(spark, harvest)
    model = files.fit_file(spark, harvest, "tons", n_trees=3, seed=1)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    score_stream(model, stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    streamed = {r.field: r.prediction for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(streamed) == 175 and streamed == {r.field: r.prediction for r in model.transform(df).collect()}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_match_their_sql(spark):
    import duckdb

    from arborlake.plans.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")

    def shown(v):
        return "~" if v is None else f"{v + 0.0:.4f}" if isinstance(v, float) else f"{float(v):.4f}" if hasattr(v, "as_tuple") else str(v)

    assert set(ORACLE_SQL) <= set(QUERIES)
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(tuple(map(shown, r)) for r in got.fetchall())
        assert sorted(tuple(shown(r[c]) for c in names) for r in df.collect()) == want, name


def test_commands_and_export(spark, tmp_path, harvest):
    from arborlake import cli
    from arborlake.operators.export import forest_sql
    from arborlake.operators.forest import ForestModel

    cli.main(["fit", harvest, "--target", "tons", "--output", f"{tmp_path}/m", "--trees", "2", "--seed", "6", "--max-features", "sqrt", "--bootstrap-max", "none"], spark)
    cli.main(["predict", f"{tmp_path}/m", harvest, f"{tmp_path}/p.parquet"], spark)
    assert spark.read.parquet(f"{tmp_path}/p.parquet").count() == 175
    assert cli.main(["view", harvest, "--rows", "2", "--columns", "soil"], spark).startswith("first 2 rows")
    model = ForestModel.load(spark, f"{tmp_path}/m")
    by_sql = model.transform(files.read_table(spark, harvest)).withColumn("by_sql", F.expr(forest_sql(model)))
    assert by_sql.filter("abs(by_sql - prediction) > 1e-3").count() == 0
    with pytest.raises(ValueError):
        cli.pairs(["lonely"])
