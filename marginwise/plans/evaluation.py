"""Scores, validation, model choice and prediction reports."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginwise.functions.kernels import Kernel
from marginwise.operators import metrics
from marginwise.operators.joins import keyed_join
from marginwise.operators.pairs import weighted_sums_between
from marginwise.operators.ranks import grouped_order_statistics, order_statistics, score_quantile
from marginwise.operators.tiles import emit_scores, has_vector, keep_mask, tile_join
from marginwise.plans.problem import EvalSet, Problem
from marginwise.plans.training import Run, clip_alphas, pair_sums, vector_coefficients
from marginwise.session import settle, stored

# A set of support vectors up to this size is sent to every executor.
MODEL_BYTES = 64 * 1024 * 1024
# Sums of a row that are formed at once where no pairs are stored.
SUM_SLOTS = 512
# Kernel cells evaluated at once by one task.
STRIP_CELLS = 4_000_000
_SCORE_DDL = "id bigint, score double"
_SCORE_ARROW = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def score_join(pairs: DataFrame, z: DataFrame, ids: DataFrame, z_rows: int | None = None, bias: float = 0.0) -> DataFrame:
    """(id, score): sum of z_i * k(i, j) per evaluation row j, 0 for rows without a neighbour.

    pairs: (i, j, k); z: (id, z); ids: (id).
    """
    weights = z.where(F.col("z") != 0).select(F.col("id").alias("i"), "z")
    sums = (
        keyed_join(pairs, weights, ["i"], right_rows=z_rows)
        .groupBy(F.col("j").alias("id"))
        .agg(F.sum(F.col("k") * F.col("z")).alias("score"))
    )
    return ids.select("id").join(sums, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.lit(bias))


def signed(alphas: DataFrame) -> DataFrame:
    """(id, z) of one coefficient vector (id, label, alpha)."""
    return alphas.select("id", (F.col("alpha") * F.col("label")).alias("z"))


def score_training(problem: Problem, alphas: DataFrame) -> DataFrame:
    """(id, label, score) of the training rows themselves, diagonal included."""
    state = alphas if "cell" in alphas.columns else alphas.withColumn("cell", F.lit(0))
    z = vector_coefficients(state)
    per_vector = z.join(pair_sums(problem, z), ["cell", "vid"], "left")
    joined = keyed_join(
        state,
        per_vector,
        ["cell", "vid"],
        left_rows=problem.n_rows,
        right_rows=problem.n_vectors,
        right_width=2,
        hot=problem.hot_vectors,
    )
    kxx = F.col("kxx")
    own = F.when((kxx > problem.epsilon) & ~F.isnan(kxx), F.col("z")).otherwise(F.col("alpha") * F.col("label"))
    return joined.select("id", "label", (F.coalesce("s", F.lit(0.0)) + own * kxx).alias("score"))


def _eval_sums(evals: EvalSet, z: DataFrame, slots: int = 1) -> DataFrame:
    """(slot, vid, part): sums of k * z over the training vectors i, without a pair table; z: (i, slot, z), one row for a
    vector and slot, of which there are ``slots``. A training vector carries an array with a place for each."""
    held = z.groupBy(F.col("i").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "z"))).alias("held"))
    weight = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0.0)))
    problem = evals.problem
    left = stored(problem.vectors.join(held.select("id", weight.alias("weight")), "id"), "weighted-vectors")
    sums = weighted_sums_between(left, evals.vectors, problem.kernel, problem.epsilon, slots)
    each = sums.select(F.col("id").alias("vid"), F.posexplode("sums").alias("slot", "part"))
    return each.select("slot", "vid", "part").where("part <> 0")


def score_eval(evals: EvalSet, alphas: DataFrame, n_vectors: int | None = None, bias: float = 0.0) -> DataFrame:
    """(id, label, score) of an evaluation set; alphas: (vid, label, alpha)."""
    z = alphas.groupBy(F.col("vid").alias("i")).agg(F.sum(F.col("alpha") * F.col("label")).alias("z"))
    z = z.where(F.col("z") != 0)
    if evals.pairs is None:
        sums = _eval_sums(evals, z.withColumn("slot", F.lit(0))).select("vid", F.col("part").alias("score"))
    else:
        joined = keyed_join(evals.pairs, z, ["i"], right_rows=n_vectors)
        sums = joined.groupBy(F.col("j").alias("vid")).agg(F.sum(F.col("k") * F.col("z")).alias("score"))
    sizes = {"left_rows": evals.n_rows, "right_rows": evals.n_vectors, "hot": evals.hot_vectors}
    joined = keyed_join(evals.rows, sums, ["vid"], "left", **sizes)
    return joined.select("id", "label", (F.coalesce("score", F.lit(0.0)) + F.lit(bias)).alias("score"))


def score_rows(
    rows: DataFrame, support: DataFrame, kernel: Kernel, epsilon: float, bias: float = 0.0
) -> DataFrame:
    """(id, score) of new rows (id, x) without a stored pair table; support: (id, x, z).

    A model within MODEL_BYTES goes to every executor and the rows are not shuffled; a larger
    one is evaluated tile by tile, each distinct vector once. Both decide alike what exceeds the
    threshold. Support without a whole vector is left out; a row without one scores the bias.
    """
    active = settle(support.where((F.col("z") != 0) & has_vector("x")).select("id", "x", "z"))
    rows = rows.select(F.col("id").cast("bigint"), F.col("x").cast("array<double>"))
    bare = rows.where(~has_vector("x")).select("id", F.lit(float(bias)).alias("score"))
    rows = rows.where(has_vector("x"))
    size = active.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if n == 0:
        return rows.select("id", F.lit(float(bias)).alias("score")).unionByName(bare)
    if n * d * 8 > MODEL_BYTES and rows.isStreaming:
        raise ValueError("a stream is scored by a model that fits MODEL_BYTES")
    if n * d * 8 > MODEL_BYTES:
        weighted = active.select("id", "x", F.col("z").alias("weight"))
        named = rows.withColumn("vector", F.xxhash64("x"))
        vectors = named.select(F.col("vector").alias("id"), "x").dropDuplicates(["id"])
        parts = tile_join(weighted, vectors, kernel, epsilon, emit_scores, _SCORE_DDL, _SCORE_ARROW)
        sums = parts.groupBy(F.col("id").alias("vector")).agg(F.sum("score").alias("score"))
        scored = named.select("id", "vector").join(sums, "vector", "left")
        return scored.select("id", (F.coalesce("score", F.lit(0.0)) + F.lit(bias)).alias("score")).unionByName(bare)
    table = active.toArrow().combine_chunks()
    X = table["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
    model = rows.sparkSession.sparkContext.broadcast((X, table["z"].to_numpy()))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, z = model.value
        strip = max(1, STRIP_CELLS // len(z))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            Y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = np.empty(batch.num_rows)
            for start in range(0, batch.num_rows, strip):
                own = Y[start : start + strip]
                K = kernel.block(own, vectors)
                scores[start : start + strip] = np.where(keep_mask(kernel, epsilon, K, own, vectors), K, 0.0) @ z
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores + bias)], schema=_SCORE_ARROW)

    return rows.mapInArrow(evaluate, _SCORE_DDL).unionByName(bare)


def sparsity_sweep(
    alphas: DataFrame, evals: EvalSet, max_quantile: int = 99, n_rows: int | None = None
) -> DataFrame:
    """(q, correct) for q = 0..max_quantile-1: correct predictions with alphas below the q % quantile set to 0."""
    one = alphas.withColumn("iteration", F.lit(0))
    return sparsity_sweeps(one, [0], evals, max_quantile, n_rows).drop("iteration")


def _levels_upto(levels: Column, value: Column) -> Column:
    """How many of up to 127 ascending numbers are at most the value, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(6, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda n, s: F.when(F.get(levels, n + s - 1) <= value, n + s).otherwise(n)
    )


def _level_sums(evals: EvalSet, z: DataFrame, iterations: list[int], max_quantile: int) -> DataFrame:
    """(iteration, vid, q_max, part) without a pair table: of as many iterations at once as a row of sums may hold."""
    some = max(1, SUM_SLOTS // max_quantile)
    parts = []
    for first in range(0, len(iterations), some):
        numbers = F.array(*[F.lit(n) for n in iterations[first : first + some]])
        place = (F.array_position(numbers, F.col("iteration")).cast("int") - 1) * max_quantile + F.col("q_max")
        own = z.where(F.array_contains(numbers, F.col("iteration"))).select("i", place.alias("slot"), "z")
        found = _eval_sums(evals, own, max_quantile * len(iterations[first : first + some]))
        number = F.get(numbers, F.floor(F.col("slot") / max_quantile).cast("int"))
        parts.append(found.select(number.alias("iteration"), "vid", (F.col("slot") % max_quantile).alias("q_max"), "part"))
    return reduce(DataFrame.unionAll, parts)


def sparsity_sweeps(
    alphas: DataFrame, iterations: list[int], evals: EvalSet, max_quantile: int = 99, n_rows: int | None = None
) -> DataFrame:
    """(iteration, q, correct) for the coefficients (iteration, id, vid, label, alpha) of several iterations.

    Thresholds grow with q, so a coefficient counts for all q up to one largest q. Sums are
    formed per (row, largest q) and added from the top; a row's sign then holds for a range of
    q, recorded by its two ends. One ranking gives the thresholds of all iterations, and the pair
    table is read once. ``n_rows`` is the number of coefficients of one iteration, when known.
    """
    if not 0 < max_quantile < 128:
        raise ValueError("max_quantile must lie between 1 and 127")
    spark = evals.rows.sparkSession
    levels = [0.01 * q for q in range(max_quantile)]
    # At most one row per iteration.
    found = grouped_order_statistics(alphas, "iteration", "alpha", levels)
    if len(iterations) == 1:
        ranked = alphas.withColumn("found", found.select("found").scalar())
    else:
        ranked = alphas.join(F.broadcast(found), "iteration")
    upto = _levels_upto(F.col("found"), F.col("alpha"))
    union = ranked.select(
        "iteration", F.col("vid").alias("i"), (upto - 1).alias("q_max"), (F.col("alpha") * F.col("label")).alias("z")
    )
    z = (
        union.where((F.col("q_max") >= 0) & (F.col("z") != 0))
        .groupBy("iteration", "i", "q_max")
        .agg(F.sum("z").alias("z"))
    )
    z_rows = None if n_rows is None else n_rows * len(iterations)
    if evals.pairs is None:
        sums = _level_sums(evals, z, iterations, max_quantile)
    else:
        sums = (
            keyed_join(evals.pairs, z, ["i"], right_rows=z_rows, right_width=2)
            .groupBy("iteration", F.col("j").alias("vid"), "q_max")
            .agg(F.sum(F.col("k") * F.col("z")).alias("part"))
        )
    # At most max_quantile rows per vector and iteration.
    from_top = Window.partitionBy("iteration", "vid").orderBy(F.col("q_max").desc())
    ranged = sums.select(
        "iteration",
        "vid",
        F.sum("part").over(from_top.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("score"),
        (F.coalesce(F.lead("q_max").over(from_top), F.lit(-1)) + 1).alias("low"),
        F.col("q_max").alias("high"),
    )
    # Rows per evaluation vector and class, so copies are counted, not repeated.
    y = F.col("label")
    classes = evals.rows.groupBy("vid").agg(F.count_if(y > 0).alias("pos"), F.count_if(y < 0).alias("neg"))
    hits = F.when(F.col("score") > 0, F.col("pos")).when(F.col("score") < 0, F.col("neg")).otherwise(F.lit(0))
    ends = F.array(
        F.struct(F.col("low").alias("q"), F.col("hits").alias("change")),
        F.struct((F.col("high") + 1).alias("q"), (-F.col("hits")).alias("change")),
    )
    # At most max_quantile + 1 rows per iteration.
    changes = (
        ranged.join(classes, "vid")
        .withColumn("hits", hits)
        .select("iteration", F.explode(ends).alias("e"))
        .groupBy("iteration", F.col("e.q").alias("q"))
        .agg(F.sum("e.change").alias("change"))
    )
    grid = spark.createDataFrame([(n,) for n in iterations], "iteration int").select("iteration", F.explode(F.sequence(F.lit(0), F.lit(max_quantile - 1))).alias("q"))
    upto = Window.partitionBy("iteration").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(F.broadcast(changes), ["iteration", "q"], "left").select(
        "iteration", "q", F.sum(F.coalesce("change", F.lit(0))).over(upto).alias("correct")
    )


def effective_epsilon(alphas: DataFrame, epsilon: float) -> float:
    """Coefficients up to this size are left out of a distributed product."""
    smallest = alphas.agg(F.min("alpha")).first()[0]
    return max(min(epsilon, smallest), 0.000001)


def validation_eval(alphas: DataFrame, evals: EvalSet, epsilon: float, iteration: int, n_vectors: int | None = None) -> DataFrame:
    """(correct, iteration) of one coefficient vector on an evaluation set."""
    cut = effective_epsilon(alphas, epsilon)
    kept = alphas.where(F.abs(F.col("alpha") * F.col("label")) > cut)
    scored = score_eval(evals, kept, n_vectors)
    counted = metrics.accuracy(scored.withColumn("prediction", metrics.classify_sign(F.col("score"))))
    return counted.select("correct", F.lit(iteration).alias("iteration"))


def validate_run(run: Run, evals: EvalSet, max_quantile: int = 99, cell: int = 0) -> DataFrame:
    """(iteration, sparsity, correct): the best sparsity of every iteration of one cell."""
    history = run.history().where(F.col("cell") == cell)
    alphas = history.select("iteration", "id", "vid", "label", F.col("alpha_after").alias("alpha"))
    iterations = list(range(1, run.last[cell] + 1)) or [0]
    sweeps = sparsity_sweeps(alphas, iterations, evals, max_quantile, run.problem.n_rows)
    return settle(metrics.best_sparsity(sweeps))


def select_model(run: Run, records: DataFrame, cell: int = 0) -> DataFrame:
    """(id, vid, label, alpha) of the best iteration, clipped at its best sparsity."""
    best = metrics.best_iteration(records).first()
    alphas = run.history().where((F.col("cell") == cell) & (F.col("iteration") == best["iteration"]))
    alphas = alphas.select("id", "vid", "label", "alpha")
    if not best["sparsity"]:
        return alphas
    level = 0.01 * best["sparsity"]
    return clip_alphas(alphas, order_statistics(alphas, "alpha", [level])[level])


def predict(scored: DataFrame, method: str = "standard", threshold: float = 0.5) -> DataFrame:
    """Counts for (id, label, score): by sign ("standard") or rank quantile ("threshold"); "auc" is the rate table.

    With a threshold, class counts follow the thresholded prediction; the sign-based counts are
    reported next to them.
    """
    if method == "auc":
        return metrics.roc_table(scored)
    if method == "standard":
        called = scored.withColumn("prediction", metrics.classify_sign(F.col("score")))
    elif method == "threshold":
        called = score_quantile(scored).withColumn(
            "prediction", metrics.classify_quantile(F.col("quantile"), threshold)
        )
    else:
        raise ValueError(f"unknown prediction method {method!r}")
    p, y, s = F.col("prediction"), F.col("label"), F.col("score")
    return called.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p * y > 0).alias("correct"),
        F.count_if((p > 0) & (y > 0)).alias("correct_positive"),
        F.count_if((p < 0) & (y < 0)).alias("correct_negative"),
        F.count_if((s > 0) & (y > 0)).alias("sign_correct_positive"),
        F.count_if((s < 0) & (y < 0)).alias("sign_correct_negative"),
        F.count_if(y > 0).alias("n_positive"),
        F.count_if(y < 0).alias("n_negative"),
    )


def predict_distributed(
    alphas: DataFrame,
    kernel_entries: DataFrame,
    labels: DataFrame,
    epsilon: float,
    threshold: float | None = None,
    clip_quantile: float = 0.0,
) -> DataFrame:
    """Prediction as a product: the row vector alpha * y times the (i, j, value) kernel matrix.

    The vector goes to the entries, which are read once and summed by column.

    Coefficients below their ``clip_quantile`` are left out first. Sign of the score, or +1 below
    the raw ``threshold``.
    """
    if clip_quantile > 0.0:
        alphas = clip_alphas(alphas, order_statistics(alphas, "alpha", [clip_quantile])[clip_quantile])
    cut = effective_epsilon(alphas, epsilon)
    vector = alphas.select(F.col("id").alias("i"), (F.col("alpha") * F.col("label")).alias("z")).where(F.abs("z") > cut)
    joined = keyed_join(kernel_entries, vector, ["i"], right_rows=alphas.count(), right_width=2)
    scores = joined.groupBy(F.col("j").alias("id")).agg(F.sum(F.col("z") * F.col("value")).alias("score"))
    scored = labels.select("id", "label").join(scores, "id", "left").fillna(0.0, ["score"])
    score = F.col("score")
    call = metrics.classify_sign(score) if threshold is None else metrics.classify_raw(score, threshold)
    return scored.withColumn("prediction", call)
