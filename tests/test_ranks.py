import numpy as np
import pytest
from helpers import order_quantile, ranks_descending
from pyspark.sql import functions as F

from marginwise.operators import folds, ranks


def scores(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, score double")


DOCUMENTED = [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_documented_rank_example(spark):
    got = ranks.score_quantile(scores(spark, DOCUMENTED)).orderBy("id").collect()
    assert [r["rank"] for r in got] == [9, 9, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
    assert [r["quantile"] for r in got] == pytest.approx([r["rank"] / 9 for r in got])


def test_equal_scores_have_no_quantiles(spark):
    with pytest.raises(Exception, match="all scores are equal"):
        ranks.score_quantile(scores(spark, [3, 3, 3])).collect()


@pytest.mark.parametrize("rows_per_bucket", [7, 100, 10_000])
def test_ranks_over_many_value_ranges(spark, rows_per_bucket):
    rng = np.random.default_rng(0)
    # A third of the rows share one value.
    values = np.where(rng.random(900) < 0.34, 5.0, np.round(rng.normal(size=900), 2))
    got = ranks.score_rank(scores(spark, values), rows_per_bucket=rows_per_bucket).orderBy("id").collect()
    assert [r["rank"] for r in got] == ranks_descending(list(values))


@pytest.mark.parametrize("rows_per_bucket", [5, 10_000])
def test_order_statistics_against_the_definition(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(333) < 0.3, -1.0, rng.exponential(size=333))
    levels = [0.0, 0.003, 0.01, 0.25, 0.5, 0.777, 0.98, 0.999, 1.0]
    found = ranks.order_statistics(scores(spark, values), "score", levels, rows_per_bucket)
    for q in levels:
        assert found[q] == pytest.approx(order_quantile(list(values), q), abs=0)


def test_quantile_level_out_of_range(spark):
    with pytest.raises(ValueError):
        ranks.order_statistics(scores(spark, [1, 2]), "score", [1.5])


def test_single_row(spark):
    assert ranks.order_statistics(scores(spark, [4]), "score", [0.0, 0.3, 1.0]) == {0.0: 4.0, 0.3: 4.0, 1.0: 4.0}


def test_positions_over_many_ranges(spark):
    df = spark.createDataFrame([((i * 37) % 501,) for i in range(501)], "id bigint")
    got = ranks.positions(df, "id", rows_per_bucket=20)
    assert got.where("position <> id").count() == 0 and got.count() == 501


def test_running_totals_of_a_second_column(spark):
    hist = spark.createDataFrame([(float(v), 1, v % 3) for v in range(100)], "v double, n bigint, extra bigint")
    got = ranks.running_totals(hist, "v", ["n", "extra"], descending=True, rows_per_bucket=9).collect()
    for r in got:
        above = [v for v in range(100) if v >= r["v"]]
        assert (r["n_upto"], r["extra_upto"]) == (len(above), sum(v % 3 for v in above))


@pytest.mark.parametrize("rows_per_bucket", [11, 100_000])
def test_folds_are_balanced_by_class(spark, rows_per_bucket):
    df = spark.range(500).selectExpr("id", "if(id % 7 = 0, 1, -1) AS label")
    folded = folds.kfold_assign(df, 10, seed=1, rows_per_bucket=rows_per_bucket)
    one_range = folds.kfold_assign(df, 10, seed=1)
    assert folded.exceptAll(one_range).count() == 0
    counts = folded.groupBy("label").pivot("fold").count().collect()
    for row in counts:
        sizes = [row[str(f)] for f in range(10)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("rows_per_bucket", [2, 100])
def test_rows_without_a_score_have_no_rank(spark, rows_per_bucket):
    scores = [5.0, None, 3.0, 5.0, None, 1.0]
    frame = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    found = {r["id"]: (r["rank"], r["quantile"]) for r in ranks.score_quantile(frame, rows_per_bucket=rows_per_bucket).collect()}
    assert found == {0: (0, 0.0), 1: (None, None), 2: (2, 2 / 3), 3: (0, 0.0), 4: (None, None), 5: (3, 1.0)}


@pytest.mark.parametrize("rows_per_bucket", [2, 100])
def test_order_statistics_skip_nulls(spark, rows_per_bucket):
    frame = spark.createDataFrame([(float(v),) for v in range(1, 9)] + [(None,)] * 2, "v double")
    found = ranks.order_statistics(frame, "v", [0.0, 0.5, 1.0], rows_per_bucket)
    assert found == {0.0: 1.0, 0.5: 4.5, 1.0: 8.0}


@pytest.mark.parametrize("rows_per_bucket", [3, 100])
def test_sorted_rows_with_many_ties(spark, rows_per_bucket):
    values = [0.0] * 12 + [2.0, -1.0, 2.0, 7.0]
    frame = spark.createDataFrame([*enumerate(values), (99, None)], "id bigint, v double")
    got = ranks.sorted_rows(frame, "v", "id", rows_per_bucket).orderBy("position").collect()
    want = sorted(enumerate(values), key=lambda r: (r[1], r[0]))
    assert [(r["id"], r["v"]) for r in got] == want and [r["position"] for r in got] == list(range(len(want)))


@pytest.mark.parametrize("rows_per_bucket", [7, 250_000])
def test_grouped_order_statistics(spark, rows_per_bucket):
    rng = np.random.default_rng(11)
    values = {1: rng.normal(size=90).round(1), 2: np.full(40, 3.0), 3: np.array([2.5]), 4: rng.normal(size=301) * 1e6}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [(1, None), (5, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    levels = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0, 0.5]
    found = ranks.grouped_order_statistics(df, "g", "v", levels, rows_per_bucket)
    got = {r["g"]: r["found"] for r in found.collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        assert got[g] == pytest.approx([order_quantile(vs, q) for q in levels])
    assert ranks.grouped_order_statistics(df.limit(0), "g", "v", levels).count() == 0
    with pytest.raises(ValueError, match="quantile"):
        ranks.grouped_order_statistics(df, "g", "v", [1.5])


def test_jobs_do_not_grow_with_the_groups(spark):
    def jobs(groups):
        df = spark.range(2000).select((F.col("id") % groups).alias("g"), F.col("id").cast("double").alias("v"))
        spark.sparkContext.setJobGroup(f"groups-{groups}", "count jobs")
        ranks.grouped_order_statistics(df, "g", "v", [0.1 * k for k in range(10)]).collect()
        spark.sparkContext.setJobGroup("none", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-{groups}"))

    assert jobs(1) >= jobs(40) - 1
