"""Classifiers on scores, and what is counted from predictions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginwise.operators.ranks import histogram, max_rank, running_totals
from marginwise.session import settle


def classify_sign(score: Column) -> Column:
    """Signum of the score; a score of 0 is class 0 and never correct."""
    return F.signum(score)


def classify_quantile(quantile: Column, threshold: float) -> Column:
    """+1 up to the rank quantile ``threshold`` (high scores), -1 beyond it."""
    if not 0.0 < threshold < 1.0:
        raise ValueError("threshold must lie in (0, 1)")
    return F.when(quantile > threshold, -1.0).otherwise(1.0)


def classify_raw(score: Column, threshold: float) -> Column:
    """+1 below the raw score ``threshold``, -1 otherwise."""
    return F.when(score < threshold, 1.0).otherwise(-1.0)


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Correct and misclassified rows; a missing prediction is a misclassification."""
    correct = F.count_if(F.col(prediction) * F.col(label) > 0)
    return df.agg(correct.alias("correct"), (F.count(F.lit(1)) - correct).alias("misclassified"))


def confusion_counts(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    p, y = F.col(prediction), F.col(label)
    return df.agg(
        F.count_if((y > 0) & (p > 0)).alias("true_positive"),
        F.count_if((y < 0) & (p > 0)).alias("false_positive"),
        F.count_if((y < 0) & (p < 0)).alias("true_negative"),
        F.count_if((y > 0) & (p < 0)).alias("false_negative"),
    )


def class_hits(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Hits of class +1, hits of class -1, and rows wrongly called +1, by the sign of the score."""
    s, y = F.col(score), F.col(label)
    return df.agg(
        F.count_if((s > 0) & (y > 0)).alias("hits_positive"),
        F.count_if((s < 0) & (y < 0)).alias("hits_negative"),
        F.count_if((s > 0) & (y <= 0)).alias("wrongly_positive"),
    )


def class_totals(df: DataFrame, label: str = "label") -> DataFrame:
    y = F.col(label)
    return df.agg(F.count_if(y > 0).alias("n_positive"), F.count_if(y < 0).alias("n_negative"))


def sparsity_pct(df: DataFrame, alpha: str = "alpha") -> DataFrame:
    return df.agg((100.0 * F.avg(F.when(F.col(alpha) == 0, 1.0).otherwise(0.0))).alias("sparsity"))


def delta_l1(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.abs(F.col("alpha") - F.col("alpha_old"))).alias("delta"))


def momentum(df: DataFrame) -> DataFrame:
    """Conjugate-gradient factor max(0, a.(a - a_old) / a_old.a_old); 0 when a_old is near zero."""
    a, old = F.col("alpha"), F.col("alpha_old")
    norm2 = F.sum(old * old)
    ratio = F.sum(a * (a - old)) / norm2
    return df.agg(F.when(norm2 > 0.001, F.greatest(F.lit(0.0), ratio)).otherwise(0.0).alias("momentum"))


def roc_table(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rates for the cut-offs 1 %..99 % of the descending score quantile; positive iff quantile < cut-off.

    One pass: every distinct score falls into the first cut-off that includes it, and the 99
    rows are running sums of at most 100 groups. Ratios without a denominator are NULL.
    """
    y = F.col(label)
    hist = settle(histogram(df, score, pos=F.count_if(y > 0), neg=F.count_if(y < 0)))
    ranked = running_totals(hist, score, ["n"], descending=True).withColumn("rank", F.col("n_upto") - F.col("n"))
    ranked = ranked.withColumn("max_rank", max_rank(hist, score))
    quantile = F.when(F.col("max_rank") > 0, F.col("rank") / F.col("max_rank")).otherwise(
        F.raise_error(F.lit("all scores are equal, quantiles are undefined")).cast("double")
    )
    guess = (F.floor(F.col("q") * 100) + 1).cast("int")
    # The floating product may be off by one step either way; the comparison itself decides.
    first = (
        F.when(F.col("q") < (guess - 1) / F.lit(100.0), guess - 1)
        .when(F.col("q") < guess / F.lit(100.0), guess)
        .otherwise(guess + 1)
    )
    grouped = (
        ranked.withColumn("q", quantile)
        .withColumn("first", first)
        .groupBy("first")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    cutoffs = df.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("cutoff"))
    upto = Window.partitionBy(F.lit(0)).orderBy("cutoff").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = cutoffs.join(F.broadcast(grouped), F.least(F.col("first"), F.lit(100)) == F.col("cutoff"), "left")
    full = full.groupBy("cutoff").agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")
    )
    # 100 rows.
    counted = (
        full.withColumn("tp", F.sum("pos").over(upto))
        .withColumn("fp", F.sum("neg").over(upto))
        .withColumn("p", F.sum("pos").over(Window.partitionBy(F.lit(0))))
        .withColumn("n", F.sum("neg").over(Window.partitionBy(F.lit(0))))
        .where(F.col("cutoff") < 100)
    )
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    precision = F.try_divide(tp, tp + fp)
    false_discovery = F.try_divide(fp, tp + fp)
    return counted.select(
        "cutoff",
        F.col("tp").alias("true_positive"),
        F.col("fp").alias("false_positive"),
        precision.alias("precision"),
        false_discovery.alias("false_discovery_rate"),
        F.when((tp > 0) & (fp > 0), precision / F.sqrt(false_discovery)).otherwise(0.0).alias("q_value"),
        F.try_divide(tp, p).alias("sensitivity"),
        F.try_divide(n - fp, n).alias("specificity"),
        F.try_divide(tp + n - fp, p + n).alias("accuracy"),
    )


def best_cutoff(rates: DataFrame) -> DataFrame:
    """The cut-off of a rate table with the highest accuracy; ties go to the smallest cut-off."""
    return rates.agg(
        F.min_by("cutoff", F.struct(-F.col("accuracy"), F.col("cutoff"))).alias("cutoff"),
        F.max("accuracy").alias("accuracy"),
    )


def confusion_matrix(df: DataFrame, prediction: str, label: str, classes: list[int]) -> DataFrame:
    """Predicted classes as rows, actual classes as columns ``actual_<class>`` (``m`` for minus)."""
    named = {c: f"actual_{c}".replace("-", "m") for c in classes}
    counts = [F.count_if(F.col(label) == c).alias(name) for c, name in named.items()]
    return df.groupBy(F.col(prediction).alias("predicted")).agg(*counts)


def confusion_report(df: DataFrame, prediction: str, label: str, positive: int) -> DataFrame:
    """Accuracy (trace over total), error, and false positives over actual positives and negatives."""
    p, y = F.col(prediction), F.col(label)
    total, agree = F.count(F.lit(1)), F.count_if(p == y)
    false_positive = F.count_if((p == positive) & (y != positive))
    return df.agg(
        F.try_divide(agree, total).alias("accuracy"),
        (1.0 - F.try_divide(agree, total)).alias("error"),
        F.try_divide(false_positive, F.count_if(y == positive)).alias("false_positive_over_actual_positive"),
        F.try_divide(false_positive, F.count_if(y != positive)).alias("false_positive_over_actual_negative"),
    )


def error_mean_by_grid(errors: DataFrame, cell: list[str]) -> DataFrame:
    """Mean error of each grid cell, with the best cell marked (ties: the first in cell order).

    The few errors of a cell are added in their order, so that cells of equal errors tie to the last bit.
    """
    summed = F.aggregate("sorted", F.lit(0.0), lambda total, error: total + error)
    means = errors.groupBy(*cell).agg(F.array_sort(F.collect_list(F.col("error").cast("double"))).alias("sorted"))
    means = means.select(*cell, F.try_divide(summed, F.size("sorted").cast("double")).alias("mean_error"))
    # One row per grid cell.
    best = means.agg(F.min_by(F.struct(*cell), F.struct("mean_error", *cell))).scalar()
    return means.withColumn("is_best", F.struct(*cell) == best)


def best_sparsity(sweep: DataFrame) -> DataFrame:
    """Quantile with most correct predictions per remaining key; ties go to the larger quantile."""
    keys = [c for c in sweep.columns if c not in ("q", "correct")]
    return sweep.groupBy(*keys).agg(
        F.max_by("q", F.struct("correct", "q")).alias("sparsity"), F.max("correct").alias("correct")
    )


def best_iteration(records: DataFrame) -> DataFrame:
    """Iteration with most correct predictions; ties go to the later one."""
    rest = [c for c in records.columns if c not in ("iteration", "correct")]
    pick = F.struct("correct", "iteration")
    return records.agg(
        F.max_by("iteration", pick).alias("iteration"),
        F.max("correct").alias("correct"),
        *[F.max_by(c, pick).alias(c) for c in rest],
    )


def replicate_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Partial results of the replicates added up per key."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))
