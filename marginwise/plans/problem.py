"""Training and evaluation tables with copies of a vector represented once.

Rows with identical inputs have identical kernel values. Pairs are therefore built between
distinct vectors only, and coefficients of copies are added before they meet the pair table.
The result is the same sum, and a group of copies of any size costs one vector.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.functions.kernels import Kernel
from marginwise.operators.joins import fits_broadcast, hot_keys, salt_left, salts_of
from marginwise.operators.pairs import kernel_pairs, kernel_pairs_between, mirror
from marginwise.operators.sampling import density_sampled
from marginwise.session import bucketed, settle, stored

PairBuilder = Callable[[DataFrame, Kernel, float], DataFrame]
# Ways to build the pair table by name; a function of one's own does as well.
BUILDERS: dict[str, PairBuilder] = {
    "auto": kernel_pairs,
    "full": partial(kernel_pairs, prune=False),
    "tree": partial(kernel_pairs, leaf_rows=128),
}
# More pairs than this, in both directions, are not stored but found again by every pass.
STORED_PAIRS = 50_000_000
# Expected number of sampled pairs behind the estimate of their number.
ESTIMATE_PAIRS = 100_000


@dataclass(frozen=True)
class Collapsed:
    """rows with ``vid`` and without ``x``; distinct vectors (id, x); their counts; hot vectors."""

    rows: DataFrame
    vectors: DataFrame
    n_rows: int
    n_vectors: int
    hot: DataFrame | None


def collapse(rows: DataFrame, distinct: bool = True) -> Collapsed:
    """Name every vector by a hash and count its copies.

    A second hash detects two vectors with one name; they are then hashed anew. Without copies,
    or with ``distinct=False``, every row keeps its own id as vector id. Labels other than -1
    and +1 are refused.
    """
    bad = F.count_if(~F.coalesce(F.col("label").isin(-1, 1), F.lit(False)))
    for salt in range(8):
        named = rows.withColumn("vid", F.xxhash64("x", F.lit(salt)))
        check = F.xxhash64("x", F.lit(salt + 1000))
        counted = settle(
            named.groupBy("vid").agg(
                F.min("id").alias("id"),
                F.count(F.lit(1)).alias("n"),
                bad.alias("bad"),
                (F.min(check) != F.max(check)).alias("clash"),
            )
        )
        found = counted.agg(
            F.count(F.lit(1)).alias("n_vectors"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
            F.count_if("clash").alias("clashes"),
        ).first()
        n_rows, n_vectors = found["n_rows"], found["n_vectors"]
        if found["bad"]:
            raise ValueError("labels must be -1 or +1")
        if not distinct or n_vectors == n_rows:
            return Collapsed(rows.withColumn("vid", F.col("id")).drop("x"), rows.select("id", "x"), n_rows, n_rows, None)
        if not found["clashes"]:
            # The row with the smallest id stands for its copies.
            chosen = counted.select("id", "vid")
            vectors = rows.select("id", "x").join(chosen, "id")
            hot = salts_of(counted, ["vid"])
            return Collapsed(
                named.drop("x"), vectors.select(F.col("vid").alias("id"), "x"), n_rows, n_vectors, hot
            )
    raise RuntimeError("hash collisions between vectors persist")


@dataclass(frozen=True)
class Problem:
    """rows (id, vid, label, kxx, ...), pairs (i, j, k) in both directions between distinct vectors.

    With more vectors than fit a broadcast, the pairs carry a ``salt`` for crowded partners j
    (``hot_partners``) and are stored in buckets of (j, salt), so an iteration does not move them.
    A table of more than STORED_PAIRS pairs is not built (``pairs`` is None): every pass evaluates the tiles again,
    with the options ``search``, and only sums leave them.
    """

    rows: DataFrame
    vectors: DataFrame
    pairs: DataFrame | None
    n_rows: int
    n_vectors: int
    kernel: Kernel
    epsilon: float
    hot_vectors: DataFrame | None = None
    hot_partners: DataFrame | None = None
    search: dict | None = None

    @property
    def has_copies(self) -> bool:
        return self.n_vectors < self.n_rows


@dataclass(frozen=True)
class EvalSet:
    """rows (id, vid, label) and pairs (training vector i, evaluation vector j, k).

    More pairs than STORED_PAIRS are not stored (``pairs`` is None): what is summed over them is formed from the
    training ``problem`` and the evaluation ``vectors`` (id, x), tile by tile.
    """

    rows: DataFrame
    pairs: DataFrame | None
    n_rows: int
    n_vectors: int
    hot_vectors: DataFrame | None = None
    problem: Problem | None = None
    vectors: DataFrame | None = None


def few_pairs(vectors: DataFrame, n: int, kernel: Kernel, epsilon: float) -> bool:
    """Whether a pair table is expected to hold at most STORED_PAIRS rows, from a sample of all pairs."""
    total = n * (n - 1)
    if total <= STORED_PAIRS:
        return True
    density = density_sampled(vectors, kernel, epsilon, min(1.0, 2 * ESTIMATE_PAIRS / total), seed=2).first()["density"]
    return (density or 0.0) * total <= STORED_PAIRS


def prepare(
    train: DataFrame,
    kernel: Kernel,
    epsilon: float,
    builder: PairBuilder | str = "auto",
    distinct: bool = True,
    cells: int = 1,
    broadcast: bool | None = None,
    store: bool | None = None,
) -> Problem:
    """Build and store the pair table of (id, label, x, ...).

    ``builder`` is a name of BUILDERS or a function (rows, kernel, epsilon) -> (i, j, k), i < j.
    ``cells`` models will be trained at once; ``broadcast`` overrides the size check that
    decides how the pairs are laid out, ``store`` the one that decides whether they are stored (those of a
    function of one's own always are).
    """
    kxx = kernel.expr(F.col("x"), F.col("x"))
    found = collapse(train.withColumn("kxx", kxx), distinct)
    build = BUILDERS[builder] if isinstance(builder, str) else builder
    if store is None:
        store = not isinstance(builder, str) or few_pairs(found.vectors, found.n_vectors, kernel, epsilon)
    if not store:
        search = getattr(build, "keywords", {})
        vectors = stored(found.vectors, "vectors")
        sizes = (found.n_rows, found.n_vectors)
        return Problem(settle(found.rows), vectors, None, *sizes, kernel, epsilon, found.hot, search=search)
    pairs = mirror(build(found.vectors, kernel, epsilon))
    hot_partners = None
    if broadcast is None:
        broadcast = fits_broadcast(found.n_vectors * cells, 2)
    # With many models a task has whole rows of the pair matrix, so that its sums are few.
    pairs = stored(pairs.repartition("i") if cells > 1 else pairs, "pairs")
    if not broadcast:
        hot_partners = settle(hot_keys(pairs, ["j"]))
        pairs = bucketed(salt_left(pairs, hot_partners), ["j", "salt"], pairs.count())
    return Problem(
        settle(found.rows), found.vectors, pairs, found.n_rows, found.n_vectors, kernel, epsilon, found.hot, hot_partners
    )


def few_pairs_between(problem: Problem, vectors: DataFrame, n: int) -> bool:
    """The same for the pairs of training and evaluation vectors, from a sample of the pairs of both taken together."""
    total = problem.n_vectors * n
    if total <= STORED_PAIRS:
        return True
    sides = [df.select(F.xxhash64("id", F.lit(k)).alias("id"), "x") for k, df in enumerate((problem.vectors, vectors))]
    both = sides[0].unionAll(sides[1])
    every = (problem.n_vectors + n) ** 2
    density = density_sampled(both, problem.kernel, problem.epsilon, min(1.0, 2 * ESTIMATE_PAIRS / every), seed=2).first()["density"]
    return (density or 0.0) * total <= STORED_PAIRS


def prepare_eval(problem: Problem, evals: DataFrame, distinct: bool = True, store: bool | None = None) -> EvalSet:
    """Build and store the pairs between the training vectors and an evaluation table.

    ``store`` overrides the size check that decides whether they are stored.
    """
    found = collapse(evals, distinct)
    if store is None:
        store = few_pairs_between(problem, found.vectors, found.n_vectors)
    if not store:
        rows, vectors = settle(found.rows.select("id", "vid", "label")), stored(found.vectors, "vectors")
        return EvalSet(rows, None, found.n_rows, found.n_vectors, found.hot, problem, vectors)
    pairs = stored(kernel_pairs_between(problem.vectors, found.vectors, problem.kernel, problem.epsilon), "pairs")
    rows = settle(found.rows.select("id", "vid", "label"))
    return EvalSet(rows, pairs, found.n_rows, found.n_vectors, found.hot)
