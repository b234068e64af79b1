"""The registered queries: every operator on the given tables, with its DuckDB twin.

Fixed settings of the queries: Gaussian kernel with gamma 1, threshold 0.2, class +1 where the
embedding label is below 5, positional split 50 % train, 40 % validation, 10 % test.
"""

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginwise import oracles as sql
from marginwise.functions import columns as fc
from marginwise.functions.kernels import GaussianKernel, Kernel, LinearKernel, PolynomialKernel
from marginwise.operators import folds, matrix, metrics, pairs, ranks, sampling, scaling, selection
from marginwise.params import AlgoParams, ModelParams
from marginwise.plans import evaluation, streaming, training, tuning
from marginwise.plans.problem import prepare, prepare_eval
from marginwise.session import scratch_table, settle
from marginwise.sources import delimited, numeric, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GAUSS = GaussianKernel(sql.GAMMA)
EPS = sql.EPSILON
ALGO = AlgoParams(
    max_iter=sql.ITERATIONS, decline=sql.DECLINE, batch_prob=sql.BATCH, epsilon=sql.EPSILON, min_delta_alpha=0.01
)
MODEL = ModelParams(C=sql.COST, delta=sql.DELTA)


def query(oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def r(col, digits: int = 6, name: str | None = None):
    col = F.col(col) if isinstance(col, str) else col
    # Adding zero turns a rounded -0.0 into 0.0.
    rounded = F.round(col, digits) + F.lit(0.0)
    return rounded.alias(name) if name else rounded


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    source = load(spark, sf, "embeddings")
    label = F.when(F.col("label") < 5, 1).otherwise(-1)
    return tables.instances(source, "vec_id", label, F.col("embedding"))


def split_vectors(spark, sf) -> DataFrame:
    return tables.split_by_ratio(vectors(spark, sf))


def of(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split).drop("split")


def lineitem(spark, sf) -> DataFrame:
    """Numeric features of every line item, class +1 for returned ones, price in thousands."""
    return load(spark, sf, "lineitem").select(
        F.concat_ws(
            ":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").cast("date")
        ).alias("id"),
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("label"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


FEATURES = ["quantity", "price", "discount", "tax"]


def event_types(events: DataFrame) -> DataFrame:
    """(event_type, j): the types numbered in alphabetical order; there are few of them."""
    number = F.row_number().over(Window.orderBy("event_type")) - 1
    return events.select("event_type").distinct().withColumn("j", number.cast("bigint"))


def event_matrix(spark, sf) -> DataFrame:
    """User by event type, summed value; types numbered in alphabetical order."""
    events = load(spark, sf, "events")
    summed = events.groupBy(F.col("user_id").alias("i"), "event_type").agg(F.sum("value").alias("value"))
    return summed.join(event_types(events), "event_type").select("i", "j", "value")


def customer_alphas(spark, sf) -> DataFrame:
    """A coefficient per customer: its positive balance; the old one is the draw of the initialiser."""
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.greatest(F.lit(0.0), F.col("c_acctbal")).alias("balance")
    )
    return training.init_alphas(rows, 1.0).withColumn("alpha", F.col("balance") / 1000).drop("balance")


def judged(spark, sf) -> DataFrame:
    """Quality as prediction and toxicity as class, both -1 / +1."""
    return load(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        fc.relabel(F.col("quality")).alias("prediction"),
        fc.relabel(F.col("toxic")).alias("label"),
    )


def document_scores(spark, sf) -> DataFrame:
    """Document length as score, quality as class."""
    rated = load(spark, sf, "labels").select("doc_id", fc.relabel(F.col("quality")).alias("label"))
    lengths = load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return lengths.join(rated, "doc_id").withColumnRenamed("doc_id", "id")


def start(rows: DataFrame) -> DataFrame:
    return training.init_alphas(rows, MODEL.C, ALGO.seed)


def eval_scores(spark, sf) -> DataFrame:
    """(id, label, score) of the validation rows under the initial coefficients."""
    data = split_vectors(spark, sf)
    train, validation = of(data, "train"), of(data, "validation")
    table = pairs.kernel_pairs_between(train, validation, GAUSS, EPS)
    scores = evaluation.score_join(table, evaluation.signed(start(train)), validation, train.count())
    return validation.select("id", "label").join(scores, "id")


def projected(spark, sf) -> DataFrame:
    """Line items projected with fixed weights."""
    return selection.project(lineitem(spark, sf), ["quantity", "discount"], list(sql.FIXED_WEIGHTS), 6)


# Sources and sinks


def _numeric_file(spark, sf) -> str:
    """The numeric line item columns written as a header-less file by Spark."""
    path = scratch_table(spark, "numeric")
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    load(spark, sf, "lineitem").select(*cols).write.csv(path, header=False)
    return path


@query(sql.SCAN_NUMERIC_CSV)
def scan_numeric_csv(spark, sf):
    return delimited.scan_numeric(spark, _numeric_file(spark, sf), 6)


@query(sql.SCAN_NUMERIC_CSV)
def scan_numeric_source(spark, sf):
    """The same file through a data source of one's own: byte ranges, and no width given beforehand."""
    numeric.register(spark)
    rows = spark.read.format(numeric.NAME).load(_numeric_file(spark, sf))
    return rows.select(*[F.get("x", F.lit(k)).alias(f"c{k}") for k in range(6)])


@query(sql.CSV_SHAPE)
def csv_shape(spark, sf):
    return delimited.file_shape(spark, _numeric_file(spark, sf))


@query(sql.FEATURE_VECTOR)
def feature_vector(spark, sf):
    cells = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_partkey")
    table = delimited.feature_vector(cells, class_index=1, skip_index=0, transform=lambda c: F.when(c > 3, 1).otherwise(-1))
    return table.select("label", *[F.col("x")[k].alias(f"x{k}") for k in range(3)])


@query(sql.LOAD_SPLITS)
def load_splits(spark, sf):
    items = load(spark, sf, "lineitem")
    readers = {}
    for name, flag in (("train", "A"), ("validation", "N"), ("test", "R")):
        path = scratch_table(spark, name)
        items.where(F.col("l_returnflag") == flag).select("l_linenumber", "l_quantity", "l_tax").write.csv(path)
        readers[name] = delimited.feature_vector(
            delimited.scan_numeric(spark, path, 3), 0, transform=lambda c: F.when(c > 3, 1).otherwise(-1)
        )
    stacked = delimited.load_splits(readers)
    return stacked.select("split", "label", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query(sql.SCAN_LABELED)
def scan_labeled(spark, sf):
    return vectors(spark, sf).select("id", "label", F.posexplode("x").alias("dim", "value"))


@query(sql.ROW_LOOKUP)
def row_lookup(spark, sf):
    found = tables.row_lookup(split_vectors(spark, sf), "train", 7)
    return found.select("id", "label", F.posexplode("x").alias("dim", "value"))


@query(sql.LABELS_OF_SPLIT)
def labels_of_split(spark, sf):
    return tables.labels_of_split(split_vectors(spark, sf), "validation")


@query(sql.SPLIT_SIZES)
def split_sizes(spark, sf):
    return tables.split_sizes(split_vectors(spark, sf))


@query(sql.SPLIT_BY_RATIO)
def split_by_ratio(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return tables.split_by_ratio(rows)


@query(sql.UPPER_TRIANGLE)
def upper_triangle_pairs(spark, sf):
    return pairs.upper_triangle(spark, load(spark, sf, "supplier").count())


def _balance_vector(spark, sf) -> DataFrame:
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("value"))


@query(sql.VECTOR_TO_ENTRIES)
def vector_to_entries(spark, sf):
    vector = _balance_vector(spark, sf)
    return matrix.vector_to_entries(vector, True).unionByName(matrix.vector_to_entries(vector, False))


@query(sql.SPARSE_VECTOR_TO_ENTRIES)
def sparse_vector_to_entries(spark, sf):
    return matrix.sparse_vector_to_entries(_balance_vector(spark, sf), 5000.0)


@query(sql.ENTRIES_TO_DENSE_VECTOR)
def entries_to_dense_vector(spark, sf):
    vector = _balance_vector(spark, sf)
    return matrix.entries_to_dense_vector(matrix.sparse_vector_to_entries(vector, 5000.0), vector.count())


@query(sql.MATRIX_ROW)
def matrix_row(spark, sf):
    width = load(spark, sf, "events").select("event_type").distinct().count()
    row = matrix.matrix_row(event_matrix(spark, sf), 3, width)
    return row.select("i", r("value", 2, "value"))


# Projections, filters, predicates


@query(sql.RELABEL)
def relabel(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), fc.relabel(F.col("o_totalprice") / 200000).alias("label")
    )


@query(sql.ZSCORE_TRAIN)
def zscore_train(spark, sf):
    scaled = scaling.zscore(lineitem(spark, sf), FEATURES)
    return scaled.select("l_orderkey", "l_linenumber", *[r(c, 4, c) for c in FEATURES])


@query(sql.ZSCORE_APPLY)
def zscore_apply(spark, sf):
    items = lineitem(spark, sf)
    is_train = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    split = F.when(is_train, "train").otherwise("test").alias("split")
    scaled = scaling.zscore(items.withColumn("split", split), FEATURES, items.where(is_train))
    return scaled.select("split", "l_orderkey", "l_linenumber", *[r(c, 4, c) for c in FEATURES])


@query(sql.EPSILON_FILTER)
def epsilon_filter(spark, sf):
    """A pair table built at one threshold and tightened to another; the root of a negative product is undefined."""
    rooted = pairs.kernel_pairs(vectors(spark, sf), PolynomialKernel(1.0, 0.0, 0.5), 0.35)
    return pairs.epsilon_filter(rooted, 0.4).select("i", "j", r("k", 6, "k"))


@query(sql.CLIP_ALPHAS)
def clip_alphas(spark, sf):
    alphas = customer_alphas(spark, sf)
    threshold = ranks.order_statistics(alphas, "alpha", [0.3])[0.3]
    return training.clip_alphas(alphas, threshold).select("id", r("alpha", 6, "alpha"))


@query(sql.BOX_CONSTRAINT)
def box_constraint(spark, sf):
    rows = load(spark, sf, "customer")
    return rows.select(F.col("c_custkey").alias("id"), training.box(F.col("c_acctbal"), 5000.0).alias("alpha"))


@query(sql.SELECTION_BAND)
def selection_band(spark, sf):
    rows = projected(spark, sf)
    low, high = selection.misclassification_cutoffs(rows, rows.count(), 0.2)
    return selection.selection_band(rows, low, high).select("l_orderkey", "l_linenumber", "label", "projection")


@query(sql.CLASSIFY_SIGN)
def classify_sign(spark, sf):
    return eval_scores(spark, sf).select("id", r("score", 6, "score"), metrics.classify_sign(F.col("score")).alias("prediction"))


@query(sql.CLASSIFY_RANK_THRESHOLD)
def classify_rank_threshold(spark, sf):
    ranked = ranks.score_quantile(document_scores(spark, sf))
    return ranked.select("id", metrics.classify_quantile(F.col("quantile"), 0.7).alias("prediction"))


@query(sql.CLASSIFY_RAW_THRESHOLD)
def classify_raw_threshold(spark, sf):
    return eval_scores(spark, sf).select("id", metrics.classify_raw(F.col("score"), 0.1).alias("prediction"))


@query(sql.DROP_AND_RENAME)
def drop_and_rename(spark, sf):
    cells = load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return tables.drop_and_rename(cells, ["l_orderkey"], ["input1", "input2", "class"])


# Joins


@query(sql.KERNEL_PAIRS_TRAIN)
def kernel_pairs_train(spark, sf):
    return pairs.mirror(pairs.kernel_pairs(vectors(spark, sf), GAUSS, EPS)).select("i", "j", r("k", 6, "k"))


@query(sql.KERNEL_PAIRS_EVAL)
def kernel_pairs_eval(spark, sf):
    data = split_vectors(spark, sf)
    parts = []
    for split in ("validation", "test"):
        part = pairs.kernel_pairs_between(of(data, "train"), of(data, split), GAUSS, EPS)
        parts.append(part.select(F.lit(split).alias("split"), "i", "j", r("k", 6, "k")))
    return parts[0].unionByName(parts[1])


@query(sql.KERNEL_MATRIX_SIGNED)
def kernel_matrix_signed(spark, sf):
    return pairs.kernel_matrix_signed(vectors(spark, sf), GAUSS, EPS).select("i", "j", r("value", 6, "value"))


@query(sql.KERNEL_DIAGONAL)
def kernel_diagonal(spark, sf):
    kernel = PolynomialKernel(2.0, 0.5, 3.0)
    return pairs.kernel_diagonal(vectors(spark, sf), kernel).select("id", r("k", 6, "k"))


@query(sql.KERNEL_PAIRS_BY_BLOCK)
def kernel_pairs_by_block(spark, sf):
    found = pairs.kernel_pairs_by_block(vectors(spark, sf), GAUSS, EPS)
    return found.select("i", "j", r("k", 6, "k"), "block_i", "block_j")


@query(sql.KERNEL_PAIRS_BLOCKED)
def kernel_pairs_blocked(spark, sf):
    data = split_vectors(spark, sf)
    train, validation = of(data, "train"), of(data, "validation")
    inside = pairs.mirror(pairs.kernel_pairs_blocked(train, GAUSS, EPS))
    across = pairs.kernel_pairs_blocked(train, GAUSS, EPS, validation, remainder=True)
    parts = [d.select(F.lit(name).alias("split"), "i", "j", r("k", 6, "k")) for name, d in (("train", inside), ("validation", across))]
    return parts[0].unionByName(parts[1])


@query(sql.MATMUL_SPARSE)
def matmul_sparse(spark, sf):
    m = event_matrix(spark, sf)
    transposed = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return matrix.matmul(m, transposed).select("i", "j", r("value", 4, "value"))


@query(sql.MATMUL_GRAM)
def matmul_gram(spark, sf):
    """Type by type: the users are the inner index, and the product is far smaller than its inputs."""
    m = event_matrix(spark, sf)
    transposed = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return matrix.matmul(transposed, m).select("i", "j", r("value", 4, "value"))


@query(sql.MATVEC_SIGNUM)
def matvec_signum(spark, sf):
    m = event_matrix(spark, sf)
    shifted = m.withColumn("value", F.round("value", 2) - 800.0)
    v = m.groupBy(F.col("j").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    weighted = v.withColumn("value", F.col("value") * (F.col("i") + 1))
    return matrix.matvec_signum(shifted, weighted).select("i", r("value", 4, "value"))


@query(sql.SCORE_JOIN)
def score_join(spark, sf):
    return eval_scores(spark, sf).select("id", r("score", 6, "score"))


@query(sql.ALIGN_BY_ID)
def align_by_id(spark, sf):
    rated = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), fc.relabel(F.col("quality")).alias("label"))
    lengths = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return matrix.align_by_id(lengths, rated).select("id", (F.col("n_chars") * F.col("label")).alias("product"))


@query(sql.KERNEL_RADIUS_JOIN)
def kernel_radius_join(spark, sf):
    customers = load(spark, sf, "customer")
    points = tables.instances(
        customers.withColumn("thousands", F.col("c_acctbal") / 1000), "c_custkey", F.lit(1), ["thousands", "c_nationkey"]
    )
    return pairs.kernel_pairs(points, GAUSS, 0.5, leaf_rows=1024).select("i", "j", r("k", 6, "k"))


# Aggregations


@query(sql.COLUMN_SUMMARY)
def column_summary(spark, sf):
    summary = scaling.column_summary(lineitem(spark, sf), FEATURES)
    return summary.select("dim", r("mean", 8, "mean"), r("variance", 6, "variance"), r("sd", 6, "sd"))


@query(sql.LABEL_TABLE)
def label_table(spark, sf):
    return tables.label_table(split_vectors(spark, sf))


@query(sql.GRADIENT)
def gradient(spark, sf):
    rows = vectors(spark, sf)
    problem = prepare(rows, GAUSS, EPS)
    state = training.initial_state(problem, [training.Cell(0, MODEL)], ALGO)
    return training.gradient(problem, state).select("id", r("gradient", 6, "gradient"))


@query(sql.NONZERO_COUNT_TRAIN)
def nonzero_count_train(spark, sf):
    return pairs.nonzero_count_train(vectors(spark, sf), GAUSS, EPS)


@query(sql.NONZERO_COUNT_EVAL)
def nonzero_count_eval(spark, sf):
    data = split_vectors(spark, sf)
    return pairs.nonzero_count_eval(of(data, "train"), of(data, "validation"), GAUSS, EPS)


@query(sql.DENSITY_SAMPLED)
def density_sampled(spark, sf):
    found = sampling.density_sampled(vectors(spark, sf), GAUSS, EPS, 0.1, seed=11)
    return found.select("n_sampled", r("density", 6, "density"))


@query(sql.ADJACENCY_SETS)
def adjacency_sets(spark, sf):
    sets = pairs.kernel_adjacency(vectors(spark, sf), GAUSS, EPS)
    return sets.select("i", "segment", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"))


@query(sql.DELTA_L1)
def delta_l1(spark, sf):
    return metrics.delta_l1(customer_alphas(spark, sf)).select(r("delta", 6, "delta"))


@query(sql.MOMENTUM)
def momentum(spark, sf):
    return metrics.momentum(customer_alphas(spark, sf)).select(r("momentum", 6, "momentum"))


@query(sql.SPARSITY_PCT)
def sparsity_pct(spark, sf):
    return metrics.sparsity_pct(customer_alphas(spark, sf)).select(r("sparsity", 6, "sparsity"))


@query(sql.ACCURACY)
def accuracy(spark, sf):
    return metrics.accuracy(judged(spark, sf))


@query(sql.CONFUSION_COUNTS)
def confusion_counts(spark, sf):
    return metrics.confusion_counts(judged(spark, sf))


@query(sql.CLASS_HITS)
def class_hits(spark, sf):
    return metrics.class_hits(eval_scores(spark, sf))


@query(sql.CLASS_TOTALS)
def class_totals(spark, sf):
    return metrics.class_totals(lineitem(spark, sf))


@query(sql.ROC_TABLE)
def roc_table(spark, sf):
    rates = metrics.roc_table(document_scores(spark, sf))
    ratios = ["precision", "false_discovery_rate", "q_value", "sensitivity", "specificity", "accuracy"]
    return rates.select("cutoff", "true_positive", "false_positive", *[r(c, 6, c) for c in ratios])


@query(sql.GRAM_MATRIX)
def gram_matrix(spark, sf):
    scaled = scaling.zscore(lineitem(spark, sf), FEATURES)
    return selection.gram_matrix(scaled, FEATURES).select("a", "b", r("value", 4, "value"))


@query(sql.GRAM_MATRIX_WIDE)
def gram_matrix_wide(spark, sf):
    """All products of the 64 components and the class, in strips of columns."""
    found = selection.gram_matrix_vector(vectors(spark, sf), strip=24)
    return found.select("a", "b", r("value", 6, "value"))


@query(sql.RIDGE_WEIGHTS)
def ridge_weights(spark, sf):
    """The weights of two columns; their closed form is the check."""
    gram = selection.gram_matrix(lineitem(spark, sf), ["quantity", "discount"])
    weights = selection.solve_ridge(gram, size=1)
    return spark.createDataFrame(list(enumerate(weights)), "a int, weight double").select("a", r("weight", 9, "weight"))


@query(sql.REPLICATE_SUM)
def replicate_sum(spark, sf):
    scored = settle(eval_scores(spark, sf))
    numbered = pairs.assign_replicates(ranks.positions(scored, "id"), scored.count(), remainder=True)
    partial = numbered.groupBy("replicate").agg(F.count_if(F.col("score") * F.col("label") > 0).alias("correct"))
    return metrics.replicate_sum(partial, [], "correct")


@query(sql.CONFUSION_MATRIX)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(judged(spark, sf), "prediction", "label", [-1, 1])


@query(sql.CONFUSION_REPORT)
def confusion_report(spark, sf):
    report = metrics.confusion_report(judged(spark, sf), "prediction", "label", 1)
    return report.select(*[r(c, 6, c) for c in report.columns])


@query(sql.DOT_AND_NORM)
def dot_and_norm(spark, sf):
    numbers = matrix.dot_and_norm(customer_alphas(spark, sf), "alpha", "alpha_old")
    return numbers.select(*[r(c, 6, c) for c in numbers.columns])


@query(sql.ERROR_MEAN_BY_GRID)
def error_mean_by_grid(spark, sf):
    errors = (
        load(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("kernel"), F.col("l_linenumber").alias("C"), F.col("l_linestatus").alias("fold"))
        .agg(F.avg("l_discount").alias("error"))
    )
    return metrics.error_mean_by_grid(errors, ["kernel", "C"]).select("kernel", "C", r("mean_error", 6, "mean_error"), "is_best")


# Ranks and order


@query(sql.SCORE_RANK)
def score_rank(spark, sf):
    lengths = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return ranks.score_rank(lengths).select("id", "rank")


@query(sql.SCORE_QUANTILE)
def score_quantile(spark, sf):
    prices = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"))
    return ranks.score_quantile(prices).select("l_orderkey", "l_linenumber", "rank", r("quantile", 9, "quantile"))


@query(sql.ORDER_STATISTIC)
def order_statistic(spark, sf):
    balances = load(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    found = ranks.order_statistics(balances, "v", list(sql.LEVELS))
    return spark.createDataFrame(sorted(found.items()), "q double, value double").select("q", r("value", 6, "value"))


@query(sql.ORDER_STATISTICS_GRID)
def order_statistics_grid(spark, sf):
    levels = {q: 0.01 * q for q in range(99)}
    found = ranks.order_statistics(load(spark, sf, "orders"), "o_totalprice", list(levels.values()))
    table = spark.createDataFrame([(q, found[level]) for q, level in levels.items()], "q int, value double")
    return table.select("q", r("value", 6, "value"))


@query(sql.RUNNING_MISCLASSIFICATION)
def running_misclassification(spark, sf):
    rows = projected(spark, sf)
    low, high = selection.misclassification_cutoffs(rows, rows.count(), 0.2)
    return spark.createDataFrame([(low, high)], "low double, high double")


@query(sql.REPLICATE_AND_BLOCK)
def replicate_and_block(spark, sf):
    rows = ranks.positions(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")
    n = rows.count()
    blocks = pairs.assign_blocks(rows, n).select("id", F.col("block").alias("train_block"))
    return pairs.assign_replicates(rows, n, remainder=True).join(blocks, "id").select("id", "train_block", "replicate", "block")


@query(sql.SORTED_ALPHAS)
def sorted_alphas(spark, sf):
    alphas = customer_alphas(spark, sf).select("id", "alpha")
    return ranks.sorted_rows(alphas, "alpha", "id").select("position", "id", r("alpha", 6, "alpha"))


@query(sql.SORTED_PROJECTIONS)
def sorted_projections(spark, sf):
    positive = F.count_if(F.col("label") > 0)
    counted = settle(ranks.histogram(projected(spark, sf), "projection", n_positive=positive))
    up = ranks.running_totals(counted, "projection", ["n"])
    n = counted.agg(F.sum("n")).scalar()
    return up.select(
        "projection",
        "n_positive",
        (F.col("n") - F.col("n_positive")).alias("n_negative"),
        (F.col("n_upto") - F.col("n")).alias("ascending"),
        (n - F.col("n_upto")).alias("descending"),
    )


@query(sql.HEAD_ROWS)
def head_rows(spark, sf):
    return tables.head_rows(vectors(spark, sf), 1000).select("id", "label")


@query(sql.BEST_SPARSITY)
def best_sparsity(spark, sf):
    return metrics.best_sparsity(_sweep(spark, sf)).select("sparsity", "correct")


@query(sql.BEST_ITERATION)
def best_iteration(spark, sf):
    records = load(spark, sf, "events").groupBy(F.hour("ts").alias("iteration")).agg(
        F.countDistinct("event_type").alias("correct")
    )
    return metrics.best_iteration(records)


# Set operations


@query(sql.MERGE_PAIR_MAPS)
def merge_pair_maps(spark, sf):
    """Two tables that overlap in part: near pairs, and less near ones of rows of the same kind."""
    rows = vectors(spark, sf)
    near, less = pairs.kernel_pairs(rows, GAUSS, 0.25), pairs.kernel_pairs(rows.where("label > 0"), GAUSS, EPS)
    return pairs.merge_pair_tables(near, less).select("i", "j")


@query(sql.APPEND_SPLITS)
def append_splits(spark, sf):
    data = split_vectors(spark, sf)
    return tables.append_splits(of(data, "train"), of(data, "validation")).select("id", "label")


@query(sql.EXCLUDE_FOLD)
def exclude_fold(spark, sf):
    folded = folds.kfold_assign(vectors(spark, sf), 10, seed=3)
    return tables.exclude_fold(folded, 4).select("id", "fold")


# Scalar and array functions


def _neighbours(spark, sf) -> DataFrame:
    """Every vector next to its successor."""
    rows = vectors(spark, sf)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return rows.join(after, "id")


def _on_neighbours(spark, sf, value) -> DataFrame:
    return _neighbours(spark, sf).select("id", r(value, 6, "value"))


@query(sql.KERNEL_GAUSSIAN)
def kernel_gaussian(spark, sf):
    return _on_neighbours(spark, sf, GAUSS.expr(F.col("x"), F.col("y")))


@query(sql.KERNEL_POLYNOMIAL)
def kernel_polynomial(spark, sf):
    return _on_neighbours(spark, sf, PolynomialKernel(2.0, 0.5, 3.0).expr(F.col("x"), F.col("y")))


@query(sql.KERNEL_LINEAR)
def kernel_linear(spark, sf):
    return _on_neighbours(spark, sf, LinearKernel().expr(F.col("x"), F.col("y")))


@query(sql.EUCLIDEAN_DISTANCE)
def euclidean_distance(spark, sf):
    return _on_neighbours(spark, sf, fc.euclidean_distance(F.col("x"), F.col("y")))


class LaplaceKernel(Kernel):
    """A kernel of the user's own: exp(-distance)."""

    def expr(self, x, y):
        return F.exp(-fc.euclidean_distance(x, y))

    def block(self, X, Y):
        return np.exp(-np.sqrt(np.maximum((X * X).sum(1)[:, None] + (Y * Y).sum(1)[None, :] - 2.0 * (X @ Y.T), 0.0)))

    def rows(self, X, Y):
        return np.exp(-np.sqrt(((X - Y) ** 2).sum(axis=1)))

    def radius(self, epsilon):
        return max(0.0, -math.log(epsilon)) if epsilon > 0 else None


@query(sql.KERNEL_CUSTOM)
def kernel_custom(spark, sf):
    return pairs.kernel_pairs(vectors(spark, sf), LaplaceKernel(), 0.27).select("i", "j", r("k", 6, "k"))


@query(sql.KERNEL_SCALE)
def kernel_scale(spark, sf):
    gamma = pairs.kernel_scale(vectors(spark, sf))
    return spark.createDataFrame([(gamma,)], "gamma double").select(r("gamma", 6, "gamma"))


@query(sql.ELEMENTWISE)
def elementwise(spark, sf):
    alphas = customer_alphas(spark, sf)
    forms = fc.elementwise(F.col("alpha"), F.col("alpha_old"), 2.5)
    return alphas.select("id", *[r(col, 6, name) for name, col in forms.items()])


# Iterative model operators


@query(sql.INIT_ALPHAS)
def init_alphas(spark, sf):
    return start(vectors(spark, sf)).select("id", r("alpha", 9, "alpha"), r("alpha_old", 9, "alpha_old"))


def _trained(spark, sf, max_iter: int | None = None):
    """A run on all vectors."""
    algo = ALGO if max_iter is None else AlgoParams(
        max_iter=max_iter, decline=sql.DECLINE, batch_prob=sql.BATCH, epsilon=EPS, min_delta_alpha=0.01
    )
    return training.train_one(prepare(vectors(spark, sf), GAUSS, EPS), MODEL, algo)


@query(sql.ALPHA_HISTORY)
def alpha_history(spark, sf):
    return _trained(spark, sf).history().select("iteration", "id", r("alpha", 6, "alpha"))


@query(sql.GRADIENT_STEP)
def gradient_step(spark, sf):
    return _first_step(spark, sf).select("id", r("step", 6, "step"))


def _first_step(spark, sf) -> DataFrame:
    problem = prepare(vectors(spark, sf), GAUSS, EPS)
    state = training.initial_state(problem, [training.Cell(0, MODEL)], ALGO)
    size = MODEL.step_size(ALGO, 1)
    graded = training.gradient(problem, state)
    return settle(graded.withColumn("step", F.col("alpha") - F.lit(size) * F.col("gradient")))


@query(sql.PROJECT_EQUALITY)
def project_equality(spark, sf):
    return training.project_equality(_first_step(spark, sf), "step", "projected").select("id", r("projected", 6, "projected"))


def _mixed_step(spark, sf) -> DataFrame:
    moved = training.project_equality(_first_step(spark, sf), "step", "projected")
    return moved.withColumn(
        "alpha", training.stochastic_mix(training.box(F.col("projected"), MODEL.C), F.col("alpha"), ALGO, training.in_batch(ALGO, 1)),
    )


@query(sql.STOCHASTIC_MIX)
def stochastic_mix(spark, sf):
    return _mixed_step(spark, sf).select("id", r("alpha", 6, "alpha"))


@query(sql.MOMENTUM_UPDATE)
def momentum_update(spark, sf):
    return training.momentum_update(customer_alphas(spark, sf)).select("id", r("alpha", 6, "alpha"), r("alpha_old", 6, "alpha_old"))


@query(sql.TRAIN_ITERATION)
def train_iteration(spark, sf):
    return _trained(spark, sf, 1).final().select("id", r("alpha", 6, "alpha"), r("alpha_old", 6, "alpha_old"))


@query(sql.TRAIN_SVM)
def train_svm(spark, sf):
    return _trained(spark, sf).final().select("id", r("alpha", 6, "alpha"), r("alpha_old", 6, "alpha_old"))


@query(sql.TRAIN_SVM)
def train_svm_resumed(spark, sf):
    """Training that ends after one iteration and is taken up from its tables, as after a lost driver."""
    path = scratch_table(spark, "resumed")
    problem = prepare(vectors(spark, sf), GAUSS, EPS)
    training.train_one(problem, MODEL, replace(ALGO, max_iter=1), path=path)
    final = training.train_one(problem, MODEL, ALGO, path=path).final()
    return final.select("id", r("alpha", 6, "alpha"), r("alpha_old", 6, "alpha_old"))


@query(sql.TRAIN_SVM)
def train_svm_tree(spark, sf):
    """The same training on pairs that a partition tree finds."""
    problem = prepare(vectors(spark, sf), GAUSS, EPS, builder="tree")
    final = training.train_one(problem, MODEL, ALGO).final()
    return final.select("id", r("alpha", 6, "alpha"), r("alpha_old", 6, "alpha_old"))


def _prepared(spark, sf):
    data = split_vectors(spark, sf)
    problem = prepare(of(data, "train"), GAUSS, EPS)
    return problem, prepare_eval(problem, of(data, "validation"))


def _sweep(spark, sf) -> DataFrame:
    problem, evals = _prepared(spark, sf)
    return evaluation.sparsity_sweep(start(problem.rows), evals, 99, problem.n_rows)


@query(sql.SPARSITY_SWEEP)
def sparsity_sweep(spark, sf):
    return _sweep(spark, sf)


@query(sql.VALIDATION_EVAL)
def validation_eval(spark, sf):
    problem, evals = _prepared(spark, sf)
    run = training.train_one(problem, MODEL, ALGO)
    return evaluation.validation_eval(run.final(), evals, 0.001, sql.ITERATIONS, problem.n_vectors)


@query(sql.SELECT_MODEL)
def select_model(spark, sf):
    problem, evals = _prepared(spark, sf)
    run = training.train_one(problem, MODEL, ALGO)
    chosen = evaluation.select_model(run, evaluation.validate_run(run, evals))
    return chosen.select("id", r("alpha", 6, "alpha"))


def _test_scores(spark, sf) -> DataFrame:
    """Test rows scored by the final coefficients of a run on the training split."""
    data = split_vectors(spark, sf)
    problem = prepare(of(data, "train"), GAUSS, EPS)
    run = training.train_one(problem, MODEL, ALGO)
    return evaluation.score_eval(prepare_eval(problem, of(data, "test")), run.final(), problem.n_vectors)


@query(sql.PREDICT)
def predict(spark, sf):
    scored = settle(_test_scores(spark, sf))
    standard = evaluation.predict(scored).select(F.lit("standard").alias("method"), "*")
    threshold = evaluation.predict(scored, "threshold", 0.6).select(F.lit("threshold").alias("method"), "*")
    return standard.unionByName(threshold)


@query(sql.PREDICT_AUC)
def predict_auc(spark, sf):
    rates = evaluation.predict(settle(_test_scores(spark, sf)), "auc")
    ratios = ["precision", "false_discovery_rate", "q_value", "sensitivity", "specificity", "accuracy"]
    return rates.select("cutoff", "true_positive", "false_positive", *[r(c, 6, c) for c in ratios])


def _distributed(spark, sf, threshold=None, clip_quantile=0.0) -> DataFrame:
    data = split_vectors(spark, sf)
    train, test = of(data, "train"), of(data, "test")
    entries = pairs.kernel_pairs_between(train, test, GAUSS, EPS).withColumnRenamed("k", "value")
    called = evaluation.predict_distributed(start(train), entries, test, 0.001, threshold, clip_quantile)
    return called.select("id", "label", r("score", 6, "score"), "prediction")


@query(sql.PREDICT_STREAM)
def predict_stream(spark, sf):
    """Test rows that arrive as files, scored a file at a time against the trained model."""
    data = split_vectors(spark, sf)
    problem = prepare(of(data, "train"), GAUSS, EPS)
    final = training.train_one(problem, MODEL, ALGO).final()
    z = final.groupBy(F.col("vid").alias("id")).agg(F.sum(F.col("alpha") * F.col("label")).alias("z"))
    support = settle(problem.vectors.join(z, "id"))
    arrived, scored = scratch_table(spark, "arrived"), scratch_table(spark, "scored")
    of(data, "test").select("id", "x").repartition(3, "id").write.parquet(arrived)
    run = streaming.score_stream(
        spark, arrived, "id bigint, x array<double>", support, GAUSS, EPS, scored, scratch_table(spark, "offsets"), files_per_batch=1
    )
    run.awaitTermination()
    return spark.read.schema("id bigint, score double").parquet(scored).select("id", r("score", 6, "score"))


@query(sql.PREDICT_DISTRIBUTED)
def predict_distributed(spark, sf):
    return _distributed(spark, sf)


@query(sql.PREDICT_DISTRIBUTED_RAW)
def predict_distributed_raw(spark, sf):
    return _distributed(spark, sf, 0.1)


@query(sql.PREDICT_DISTRIBUTED_CLIPPED)
def predict_distributed_clipped(spark, sf):
    """Coefficients below their 30 % quantile are left out before the product."""
    return _distributed(spark, sf, clip_quantile=0.3)


@query(sql.SELECT_INSTANCES)
def select_instances(spark, sf):
    columns = ["quantity", "discount"]
    scaled = scaling.zscore(lineitem(spark, sf), columns)
    kept = selection.select_instances(scaled, columns, 0.1, 0.2, seed=5, digits=9)
    return kept.select("l_orderkey", "l_linenumber", "label", r("projection", 6, "projection"))


@query(sql.KFOLD_ASSIGN)
def kfold_assign(spark, sf):
    return folds.kfold_assign(lineitem(spark, sf), 10, seed=3).select("id", "label", "fold")


@query(sql.GRID_SEARCH_CV)
def grid_search_cv(spark, sf):
    """Both rounds of costs in one grid, ten folds, every model trained to its last iteration."""
    algo = replace(ALGO, max_iter=sql.GRID_ITERATIONS, min_delta_alpha=0.0)
    found = tuning.grid_search_cv(
        vectors(spark, sf), {"gaussian": GAUSS}, sql.GRID_COSTS, algo, sql.DELTA, sql.GRID_FOLDS, seed=3
    )
    return found.select("kernel", "C", r("mean_error", 6, "mean_error"), "is_best")


@query(sql.FINAL_TEST_REPORT)
def final_test_report(spark, sf):
    data = split_vectors(spark, sf)
    return tuning.final_test_report(
        of(data, "train"), of(data, "validation"), of(data, "test"), GAUSS, MODEL, ALGO
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Train, choose iteration and sparsity on validation rows, and report on the test rows."""
    problem, evals = _prepared(spark, sf)
    run = training.train_one(problem, MODEL, ALGO)
    chosen = evaluation.select_model(run, evaluation.validate_run(run, evals))
    test = prepare_eval(problem, of(split_vectors(spark, sf), "test"))
    return evaluation.predict(evaluation.score_eval(test, chosen, problem.n_vectors))
