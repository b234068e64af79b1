from types import SimpleNamespace

import pytest

from marginwise import session


def fake(configured=None, current=None, master="spark://host:7077"):
    chosen = []
    context = SimpleNamespace(
        master=master,
        getConf=lambda: {},
        getCheckpointDir=lambda: chosen[-1] if chosen else current,
        setCheckpointDir=chosen.append,
    )
    conf = SimpleNamespace(get=lambda key, default=None: configured or default)
    return SimpleNamespace(sparkContext=context, conf=conf), chosen


def test_configured_folder_is_used():
    spark, chosen = fake("hdfs:///shared")
    assert session.shared_folder(spark) == "hdfs:///shared" and chosen == ["hdfs:///shared"]
    spark, chosen = fake("hdfs:///shared", current="hdfs:///shared/one")
    assert session.scratch_table(spark, "t").startswith("hdfs:///shared/t-") and chosen == []


def test_cluster_without_folder_is_refused():
    spark, chosen = fake()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(spark)
    assert chosen == []


def test_local_session_gets_a_temporary_folder():
    spark, chosen = fake(master="local[2]")
    assert session.shared_folder(spark) == chosen[0]


def test_settled_rows_have_no_lineage(spark):
    df = session.settle(spark.range(100).withColumnRenamed("id", "v"))
    assert df.count() == 100
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_table_joins_without_moving(spark):
    table = session.bucketed(spark.range(1000).selectExpr("id % 50 AS k", "id AS v"), ["k"], 1000)
    assert table.count() == 1000
    plan = table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_discard_deletes_stored_tables_only(spark, tmp_path):
    table, other = session.stored(spark.range(5), "gone"), spark.range(3)
    assert table.count() == 5
    elsewhere = str(tmp_path / f"own-{'0' * 32}")
    spark.range(4).write.parquet(elsewhere)
    kept = spark.read.parquet(elsewhere)
    session.discard(table, other, kept)
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
        table.count()
