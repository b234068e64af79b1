import pytest
from pyspark.sql import functions as F

from marginwise.functions.columns import relabel, uniform
from marginwise.operators import scaling
from marginwise.params import SplitRatios
from marginwise.sources import delimited, tables


def write(tmp_path, text):
    path = tmp_path / "cells.csv"
    path.write_text(text)
    return str(path)


def test_numeric_file(spark, tmp_path):
    path = write(tmp_path, "0, 1.5 ,1\n1,  -2e3,0\n2,3,-1\n")
    df = delimited.scan_numeric(spark, path, 3)
    assert [tuple(r) for r in df.orderBy("c0").collect()] == [(0, 1.5, 1), (1, -2000, 0), (2, 3, -1)]
    assert tuple(delimited.file_shape(spark, path).first()) == (3, 3)


def test_other_separator_and_ragged_shape(spark, tmp_path):
    path = write(tmp_path, "1|2\n3|4|5\n")
    assert tuple(delimited.file_shape(spark, path, "|").first()) == (2, 3)
    assert delimited.scan_numeric(spark, write(tmp_path, "1;2\n"), 2, ";").first() == (1.0, 2.0)


def test_cell_that_is_no_number(spark, tmp_path):
    with pytest.raises(Exception):
        delimited.scan_numeric(spark, write(tmp_path, "1,two\n"), 2).collect()


@pytest.mark.parametrize("class_index,skip_index,want", [(2, 0, [[1.5], 1]), (0, -1, [[1.5, 1.0], -1]), (2, -1, [[0.0, 1.5], 1])])
def test_feature_vector(spark, tmp_path, class_index, skip_index, want):
    df = delimited.scan_numeric(spark, write(tmp_path, "0,1.5,1\n"), 3)
    row = delimited.feature_vector(df, class_index, skip_index).first()
    assert [list(row["x"]), row["label"]] == want


def test_relabel_truncates_first(spark):
    df = spark.createDataFrame([(0.7,), (1.0,), (-0.9,), (0.0,), (3.2,)], "c double")
    assert [r[0] for r in df.select(relabel(F.col("c"))).collect()] == [-1, 1, -1, -1, 1]
    own = df.select(relabel(F.col("c"), lambda c: F.when(c <= 1, -1).otherwise(1)))
    assert [r[0] for r in own.collect()] == [-1, -1, -1, -1, 1]


def test_splits(spark):
    df = spark.range(200).selectExpr("id * 3 AS id", "if(id % 2 = 0, 1, -1) AS label", "array(double(id), 1.0D) AS x")
    split = tables.split_by_ratio(df, SplitRatios(0.5, 0.1), strict=True)
    sizes = {r["split"]: (r["n"], r["d"]) for r in tables.split_sizes(split).collect()}
    assert sizes == {"train": (100, 2), "validation": (80, 2), "test": (20, 2)}
    assert split.where("split = 'train'").agg(F.max("id")).first()[0] == 297
    assert split.where("split = 'test'").agg(F.min("id")).first()[0] == 540
    assert tables.row_lookup(split, "train", 9).first()["x"] == [3.0, 1.0]
    assert tables.row_lookup(split, "test", 9).isEmpty()
    assert tables.labels_of_split(split, "test").count() == 20
    counts = {r["split"]: (r["n_positive"], r["n_negative"], r["n_total"]) for r in tables.label_table(split).collect()}
    assert counts["train"] == (50, 50, 100)
    assert tables.head_rows(df, 5).count() == 5 and tables.head_rows(df, 500).count() == 200


def test_row_lookup_reaches_the_scan(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "'train' AS split", "array(double(id)) AS x", "1 AS label")
    tables.write_table(df, str(tmp_path / "t"), ["split"])
    found = tables.row_lookup(spark.read.parquet(str(tmp_path / "t")), "train", 4).select("label")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,4)" in plan and "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<id:bigint,label:int>" in plan


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = scaling.zscore(df, ["a", "b"]).orderBy("a").collect()
    assert [r["a"] for r in got] == [-1.0, 0.0, 1.0]
    assert [r["b"] for r in got] == [None] * 3
    other = spark.createDataFrame([(4.0, 1.0)], "a double, b double")
    assert scaling.zscore(other, ["a"], df).first()["a"] == 2.0
    vectors = df.selectExpr("array(a, a * 2) AS x")
    assert scaling.zscore_vector(vectors).select("x").orderBy(F.col("x")[0]).first()["x"] == [-1.0, -1.0]


def test_summary_of_line_numbers(spark):
    df = spark.range(12680).selectExpr("double(id) AS line", "array(double(id)) AS x")
    row = scaling.column_summary(df, ["line"]).first()
    assert row["mean"] == 6339.5 and row["variance"] == pytest.approx(12680 * 12681 / 12)
    assert scaling.vector_summary(df).first()["variance"] == pytest.approx(row["variance"])


def test_uniform_is_fixed(spark):
    assert spark.range(1).select(uniform(F.lit(1), F.lit(2))).first()[0] == 0.8709175966214389


def test_small_tools(spark):
    df = spark.createDataFrame([(9, 1.0, "g")], "line int, v double, c string")
    assert tables.drop_and_rename(df, ["line"], ["input1", "class"]).columns == ["input1", "class"]
    folds = spark.createDataFrame([(1, 0), (2, 1)], "id int, fold int")
    assert tables.exclude_fold(folds, 0).first()["id"] == 2
    assert tables.append_splits(folds, folds, folds).count() == 6
    assert {r["split"] for r in delimited.load_splits({"train": folds, "test": folds}).collect()} == {"train", "test"}
