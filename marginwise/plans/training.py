"""Projected stochastic gradient descent on a coefficient table.

One run trains any number of cells (cost C, held-out fold) over one shared pair table. Each
iteration is one pass over the pairs, stored as a table of the run, plus two small aggregates.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginwise.functions.columns import uniform
from marginwise.operators.joins import fits_broadcast, keyed_join, salt_right
from marginwise.operators.pairs import weighted_sums
from marginwise.params import AlgoParams, ModelParams
from marginwise.plans.problem import Problem
from marginwise.session import scratch_table


@dataclass(frozen=True)
class Cell:
    """One model of a run: its parameters and the fold it must not see."""

    cell: int
    model: ModelParams
    fold: int | None = None


def init_alphas(rows: DataFrame, C: float | Column, seed: int = 0) -> DataFrame:
    """Adds alpha and alpha_old, each C * (1 - U) with U uniform in [0, 1)."""
    C = C if isinstance(C, Column) else F.lit(float(C))
    draw = {name: C * (1.0 - uniform(F.lit(seed), F.col("id"), F.lit(name))) for name in ("alpha", "alpha_old")}
    return rows.withColumns(draw)


def clip_alphas(df: DataFrame, threshold: float, alpha: str = "alpha") -> DataFrame:
    """Coefficients below the threshold become 0."""
    return df.withColumn(alpha, F.when(F.col(alpha) < threshold, 0.0).otherwise(F.col(alpha)))


def box(alpha: Column, C: Column | float) -> Column:
    C = C if isinstance(C, Column) else F.lit(float(C))
    return F.least(C, F.greatest(F.lit(0.0), alpha))


# Sums of one aggregation: more cells are summed a block at a time, each block reading the pairs once.
BLOCK_CELLS = 32
# Rows of partial sums that a task holds before it adds them up.
HELD_ROWS = 1 << 16


def pair_sums(problem: Problem, z: DataFrame, n_cells: int = 1) -> DataFrame:
    """(cell, vid, s): sum over the pairs of k * z of the partner vector; z is (cell, vid, z).

    The coefficients of all cells are an n x cells matrix. A pair meets its row of it once, however many
    cells there are: in a product of blocks while the matrix fits a broadcast, else as strips of
    columns joined to the pairs, summed up element by element. Pairs that are not stored are products of
    tiles with the rows of the matrix that travel with the vectors.
    """
    if problem.pairs is None:
        return _tile_sums(problem, z, n_cells)
    if n_cells == 1:
        partner = z.where(F.col("z") != 0).select("cell", F.col("vid").alias("j"), "z")
        joined = _with_partners(problem, partner, 2)
        return joined.groupBy("cell", F.col("i").alias("vid")).agg(F.sum(F.col("k") * F.col("z")).alias("s"))
    if problem.hot_partners is None and fits_broadcast(problem.n_vectors * n_cells):
        return _block_sums(problem, z, n_cells)
    blocks = []
    for first in range(0, n_cells, BLOCK_CELLS):
        cells = range(first, min(first + BLOCK_CELLS, n_cells))
        own = z.where((F.col("z") != 0) & F.col("cell").between(cells[0], cells[-1]))
        strip = [F.sum(F.when(F.col("cell") == c, F.col("z")).otherwise(0.0)).alias(f"z{c}") for c in cells]
        joined = _with_partners(problem, own.groupBy(F.col("vid").alias("j")).agg(*strip), 1 + len(cells) // 2)
        sums = joined.groupBy("i").agg(*[F.sum(F.when(F.col(f"z{c}") != 0, F.col("k") * F.col(f"z{c}"))).alias(f"s{c}") for c in cells])
        listed = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"s{c}").alias("s")) for c in cells])
        blocks.append(sums.select(F.col("i").alias("vid"), F.explode(listed).alias("o")).select("o.cell", "vid", "o.s").where("s IS NOT NULL"))
    return reduce(DataFrame.unionAll, blocks)


def _tile_sums(problem: Problem, z: DataFrame, n_cells: int) -> DataFrame:
    """The sums without a pair table."""
    strip = [F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("z"))), F.lit(0.0)) for c in range(n_cells)]
    own = z.where(F.col("z") != 0).groupBy(F.col("vid").alias("id")).agg(F.array(*strip).alias("weight"))
    none = F.array(*[F.lit(0.0)] * n_cells)
    rows = problem.vectors.join(own, "id", "left").withColumn("weight", F.coalesce("weight", none))
    sums = weighted_sums(rows, problem.kernel, problem.epsilon, n_cells, **problem.search)
    each = sums.select(F.col("id").alias("vid"), F.posexplode("sums").alias("cell", "s"))
    return each.select("cell", "vid", "s").where("s <> 0")


def _block_sums(problem: Problem, z: DataFrame, n_cells: int) -> DataFrame:
    """The sums as products of the stored pairs with the matrix of coefficients, which goes to every executor.

    A task emits one row per vector, not per pair.
    """
    table = z.where(F.col("z") != 0).select("cell", "vid", "z").toArrow()
    vids, place = np.unique(table["vid"].to_numpy(), return_inverse=True)
    coefficients = np.zeros((len(vids), n_cells))
    coefficients[place, table["cell"].to_numpy()] = table["z"].to_numpy()
    model = problem.pairs.sparkSession.sparkContext.broadcast((vids, coefficients))

    def add_up(i: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(i, kind="stable")
        own, first = np.unique(i[order], return_index=True)
        return own, np.add.reduceat(values[order], first, axis=0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = model.value
        held, rows = [], 0
        for batch in batches:
            i, j, k = (batch.column(c).to_numpy() for c in range(3))
            at = np.minimum(np.searchsorted(known, j), len(known) - 1) if len(known) else j[:0]
            met = np.flatnonzero(known[at] == j) if len(known) else at
            if not len(met):
                continue
            strip = matrix[at[met]]
            # A zero coefficient takes no part, whatever the kernel value.
            with np.errstate(invalid="ignore"):
                strip = np.where(strip != 0, k[met][:, None] * strip, 0.0)
            held.append(add_up(i[met], strip))
            rows += len(held[-1][0])
            if rows > HELD_ROWS:
                held = [add_up(*map(np.concatenate, zip(*held)))]
                rows = len(held[0][0]) // 2
        if held:
            own, sums = add_up(*map(np.concatenate, zip(*held)))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(own), listed], names=["vid", "sums"])

    found = problem.pairs.select("i", "j", "k").mapInArrow(products, "vid bigint, sums array<double>")
    each = found.select("vid", F.posexplode("sums").alias("cell", "part"))
    return each.groupBy("cell", "vid").agg(F.sum("part").alias("s")).where("s <> 0")


def _with_partners(problem: Problem, partner: DataFrame, width: int) -> DataFrame:
    """The pairs with what ``partner`` has for j."""
    if problem.hot_partners is None:
        return keyed_join(problem.pairs, partner, ["j"], right_rows=problem.n_vectors, right_width=width)
    return problem.pairs.join(salt_right(partner, problem.hot_partners), ["j", "salt"])


def vector_coefficients(state: DataFrame) -> DataFrame:
    """(cell, vid, z): signed coefficients of all copies of a vector added up."""
    return state.groupBy("cell", "vid").agg(F.sum(F.col("alpha") * F.col("label")).alias("z"))


def gradient(problem: Problem, state: DataFrame, linear_term: bool = True, n_cells: int = 1) -> DataFrame:
    """State with ``gradient``: sum_j alpha_j y_i y_j k(i, j), minus 1 with the linear term.

    The diagonal always counts; other copies of the same vector count when k(x, x) exceeds the
    threshold, like any other pair.
    """
    y, kxx, s = F.col("label"), F.col("kxx"), F.coalesce("s", F.lit(0.0))
    sizes = {"left_rows": problem.n_rows * n_cells, "right_rows": problem.n_vectors * n_cells, "right_width": 2}
    sizes["hot"] = problem.hot_vectors
    if problem.has_copies:
        z = vector_coefficients(state)
        per_vector = z.join(pair_sums(problem, z, n_cells), ["cell", "vid"], "left")
        joined = keyed_join(state, per_vector, ["cell", "vid"], **sizes)
        own = F.when((kxx > problem.epsilon) & ~F.isnan(kxx), F.col("z")).otherwise(F.col("alpha") * y)
    else:
        z = state.select("cell", "vid", (F.col("alpha") * y).alias("z"))
        joined = keyed_join(state, pair_sums(problem, z, n_cells), ["cell", "vid"], "left", **sizes)
        own = F.col("alpha") * y
    value = y * (s + own * kxx)
    if linear_term:
        value = value - 1.0
    return joined.withColumn("gradient", value)


def gradient_from_pairs(
    alphas: DataFrame, pairs: DataFrame, diagonal: DataFrame, linear_term: bool = True, n_rows: int | None = None
) -> DataFrame:
    """The gradient (id, gradient) straight from mirrored id pairs, for one coefficient vector."""
    z = alphas.select(F.col("id").alias("j"), (F.col("alpha") * F.col("label")).alias("z"))
    sums = keyed_join(pairs, z, ["j"], right_rows=n_rows).groupBy(F.col("i").alias("id"))
    s = sums.agg(F.sum(F.col("k") * F.col("z")).alias("s"))
    y = F.col("label")
    value = y * (F.coalesce("s", F.lit(0.0)) + F.col("alpha") * y * F.col("k"))
    if linear_term:
        value = value - 1.0
    return alphas.join(diagonal, "id").join(s, "id", "left").select("id", value.alias("gradient"))


def project_equality(df: DataFrame, value: str, output: str) -> DataFrame:
    """Projects onto sum(y * value) = 0."""
    y = F.col("label")
    shift = df.agg((F.sum(y * F.col(value)) / F.sum(y * y)).alias("shift")).scalar()
    return df.withColumn(output, F.col(value) - y * shift)


def in_batch(algo: AlgoParams, iteration: int) -> Column:
    """Whether the row takes part in the batch of this iteration."""
    return uniform(F.lit(algo.seed), F.col("id"), F.lit(iteration)) < algo.batch_prob


def stochastic_mix(updated: Column, alpha: Column, algo: AlgoParams, batch: Column) -> Column:
    """The updated coefficient for rows of the batch, the shrunken old one for the others."""
    return F.when(batch, updated).otherwise(algo.decline * alpha)


def momentum_update(df: DataFrame) -> DataFrame:
    """alpha + m * alpha_old and the previous alpha, unless alpha_old is near zero."""
    a, old = F.col("alpha"), F.col("alpha_old")
    norm2 = F.sum(old * old)
    factor = F.greatest(F.lit(0.0), F.sum(a * (a - old)) / norm2)
    m = df.agg(F.when(norm2 > 0.001, factor).alias("m")).scalar()
    return (
        df.withColumn("_m", m)
        .withColumn("_next", F.coalesce(a + F.col("_m") * old, a))
        .withColumn("alpha_old", F.when(F.col("_m").isNull(), old).otherwise(a))
        .withColumn("alpha", F.col("_next"))
        .drop("_m", "_next")
    )


def _per_cell(values: list[float | None], index: Column) -> Column:
    """The value at ``index`` of a short constant list; a fixed array needs no join."""
    listed = ", ".join("NULL" if v is None else f"{v!r}D" for v in values)
    return F.element_at(F.expr(f"CAST(array({listed}) AS array<double>)"), index + 1)


_LOG = "cell int, shift double, momentum double, delta double, sparsity double"
_STEP_COLUMNS = [T.StructField("step", T.DoubleType()), T.StructField("in_batch", T.BooleanType())]


@dataclass
class Run:
    """Stored steps of a training run and the few numbers that turn a step into coefficients.

    Step ``n`` is the table ``path/steps/iteration=n``: the coefficients before the iteration, the
    gradient step, and whether the row is in the batch. Cells are numbered 0, 1, ... An iteration
    counts once its numbers are in ``path/log/iteration=n``, written last: from these tables a new
    driver goes on.
    """

    problem: Problem
    cells: list[Cell]
    algo: AlgoParams
    path: str
    initial: DataFrame
    # Per iteration: {cell: shift} and {cell: momentum}; no momentum when the old norm was near zero.
    shifts: list[dict[int, float]] = field(default_factory=list)
    momenta: list[dict[int, float | None]] = field(default_factory=list)
    # Per cell: last iteration that ran.
    last: dict[int, int] = field(default_factory=dict)

    def _column(self, per_iteration: list[dict], index: Column) -> Column:
        return _per_cell([numbers.get(c.cell) for numbers in per_iteration for c in self.cells], index)

    def _pre(self, shifts: list[dict], index: Column) -> Column:
        """The coefficient before momentum."""
        C = _per_cell([c.model.C for c in self.cells], F.col("cell"))
        moved = box(F.col("step") - F.col("label") * self._column(shifts, index), C)
        return stochastic_mix(moved, F.col("alpha"), self.algo, F.col("in_batch"))

    def _after(self, pre: Column, momenta: list[dict], index: Column) -> tuple[Column, Column]:
        """alpha and alpha_old after momentum."""
        m, old = self._column(momenta, index), F.col("alpha_old")
        return F.coalesce(pre + m * old, pre), F.when(m.isNull(), old).otherwise(pre)

    def step(self, iteration: int | None = None) -> DataFrame:
        """The stored step of one iteration, or of all with an ``iteration`` column."""
        fields = [*self.initial.schema.fields, *_STEP_COLUMNS]
        if iteration is None:
            fields.append(T.StructField("iteration", T.IntegerType()))
        path = f"{self.path}/steps" if iteration is None else f"{self.path}/steps/iteration={iteration}"
        return self.initial.sparkSession.read.schema(T.StructType(fields)).parquet(path)

    def restore(self) -> dict[int, tuple[float, float]]:
        """Takes over the finished iterations below ``path``; gives the health of the cells of the last one."""
        try:
            log = self.initial.sparkSession.read.schema(f"{_LOG}, iteration int").parquet(f"{self.path}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        # One row per cell and iteration.
        found: dict[int, list] = {}
        for r in log.collect():
            found.setdefault(r["iteration"], []).append(r)
        health = {}
        for iteration in range(1, len(found) + 1):
            rows = found[iteration]
            self.shifts.append({r["cell"]: r["shift"] for r in rows})
            self.momenta.append({r["cell"]: r["momentum"] for r in rows})
            self.last |= {r["cell"]: iteration for r in rows}
            health = {r["cell"]: (r["delta"], r["sparsity"]) for r in rows}
        return health

    def history(self) -> DataFrame:
        """(cell, iteration, id, vid, label, alpha, alpha_after): before and after momentum."""
        keys = ["cell", "iteration", "id", "vid", "label"]
        if not self.shifts:
            initial = self.initial.withColumn("iteration", F.lit(0))
            return initial.select(*keys, "alpha", F.col("alpha").alias("alpha_after"))
        index = (F.col("iteration") - 1) * len(self.cells) + F.col("cell")
        pre = self._pre(self.shifts, index)
        after, _ = self._after(F.col("pre"), self.momenta, index)
        # A step without its numbers is of an iteration that did not finish.
        mixed = self.step().where(F.col("iteration") <= len(self.shifts)).withColumn("pre", pre)
        return mixed.select(*keys, F.col("pre").alias("alpha"), after.alias("alpha_after"))

    def state(self, iteration: int) -> DataFrame:
        """Coefficients after ``iteration`` for the cells that took part in it."""
        if iteration == 0:
            return self.initial
        index = F.col("cell")
        mixed = self.step(iteration).withColumn("pre", self._pre(self.shifts[iteration - 1 : iteration], index))
        alpha, old = self._after(F.col("pre"), self.momenta[iteration - 1 : iteration], index)
        computed = {"alpha": alpha.alias("alpha"), "alpha_old": old.alias("alpha_old")}
        return mixed.select(*[computed.get(c, F.col(c)) for c in self.initial.columns])

    def final(self) -> DataFrame:
        """The last state of every cell."""
        parts = []
        for iteration in sorted(set(self.last.values())):
            done = [c for c, last in self.last.items() if last == iteration]
            state = self.state(iteration)
            parts.append(state if len(done) == len(self.last) else state.where(F.col("cell").isin(done)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def advance(self, state: DataFrame, active: list[int], iteration: int) -> dict[int, tuple[float, float]]:
        """One iteration of the active cells: store the gradient step, then fix its constants.

        Gives the L1 change and the share of zero coefficients (percent) of each cell afterwards.
        """
        sizes = [c.model.step_size(self.algo, iteration) for c in self.cells]
        size = F.lit(sizes[0]) if len(set(sizes)) == 1 else _per_cell(sizes, F.col("cell"))
        graded = gradient(self.problem, state, self.algo.linear_term, len(self.cells))
        stored = graded.select(
            *self.initial.columns,
            (F.col("alpha") - size * F.col("gradient")).alias("step"),
            in_batch(self.algo, iteration).alias("in_batch"),
        )
        # Overwriting makes a repeated write of the same iteration harmless.
        stored.write.mode("overwrite").parquet(f"{self.path}/steps/iteration={iteration}")

        step = self.step(iteration)
        y = F.col("label")
        sums = step.groupBy("cell").agg((F.sum(y * F.col("step")) / F.sum(y * y)).alias("shift")).collect()
        shifts = {r["cell"]: r["shift"] for r in sums}
        mixed = step.select("cell", "alpha_old", self._pre([shifts], F.col("cell")).alias("pre"))
        a, old = F.col("pre"), F.col("alpha_old")
        numbers = (
            mixed.groupBy("cell")
            .agg(
                F.sum(a * (a - old)).alias("along"),
                F.sum(old * old).alias("norm2"),
                F.sum(F.abs(a - old)).alias("delta"),
                F.sum(F.abs(old)).alias("old_l1"),
                F.avg(F.when(a == 0, 1.0).otherwise(0.0)).alias("zero"),
                F.avg(F.when((a == 0) & (old == 0), 1.0).otherwise(0.0)).alias("both_zero"),
            )
            .collect()
        )
        momenta: dict[int, float | None] = {}
        health = {}
        for r in numbers:
            m = max(0.0, r["along"] / r["norm2"]) if r["norm2"] > 0.001 else None
            momenta[r["cell"]] = m
            # After a momentum step the change is m * alpha_old; coefficients are never negative.
            delta = r["delta"] if m is None else m * r["old_l1"]
            health[r["cell"]] = (delta, 100.0 * (r["both_zero"] if m else r["zero"]))
        rows = [(c, shifts[c], momenta[c], *health[c]) for c in sorted(health)]
        log = self.initial.sparkSession.createDataFrame(rows, _LOG).coalesce(1)
        log.write.mode("overwrite").parquet(f"{self.path}/log/iteration={iteration}")
        self.shifts.append(shifts)
        self.momenta.append(momenta)
        for c in active:
            self.last[c] = iteration
        return health


def initial_state(problem: Problem, cells: list[Cell], algo: AlgoParams) -> DataFrame:
    """Coefficients of every cell; rows of the held-out fold do not take part."""
    if len(cells) == 1 and cells[0].fold is None:
        rows = problem.rows.withColumn("cell", F.lit(cells[0].cell))
    else:
        entries = F.array(
            *[F.struct(F.lit(c.cell).alias("cell"), F.lit(c.fold).cast("int").alias("held_out")) for c in cells]
        )
        rows = problem.rows.withColumn("_cell", F.explode(entries)).select("*", "_cell.*").drop("_cell")
        if "fold" in problem.rows.columns:
            rows = rows.where(F.col("held_out").isNull() | (F.col("fold") != F.col("held_out")))
        rows = rows.drop("held_out")
    return init_alphas(rows, _per_cell([c.model.C for c in cells], F.col("cell")), algo.seed)


def _health(state: DataFrame) -> dict[int, tuple[float, float]]:
    """Per cell: L1 change and share of zero coefficients in percent."""
    a, old = F.col("alpha"), F.col("alpha_old")
    zero = F.avg(F.when(a == 0, 1.0).otherwise(0.0))
    rows = state.groupBy("cell").agg(F.sum(F.abs(a - old)).alias("delta"), (100.0 * zero).alias("sparsity")).collect()
    return {r["cell"]: (r["delta"], r["sparsity"]) for r in rows}


def _same_settings(spark, path: str, cells: list[Cell], algo: AlgoParams) -> None:
    """Keeps the settings beside a run's tables and refuses to go on with others; max_iter may change."""
    said = [str(replace(algo, max_iter=1)), *map(str, cells)]
    try:
        known = [r["value"] for r in spark.read.parquet(f"{path}/settings").orderBy("n").collect()]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = said
        table = spark.createDataFrame(list(enumerate(said)), "n int, value string").coalesce(1)
        table.write.mode("overwrite").parquet(f"{path}/settings")
    if known != said:
        raise ValueError(f"the run at {path} has other settings")


def train(
    problem: Problem,
    cells: list[Cell],
    algo: AlgoParams,
    initial: DataFrame | None = None,
    strict: bool = True,
    path: str | None = None,
) -> Run:
    """Iterate until max_iter, or until a cell changes less than min_delta_alpha.

    A run with a ``path`` of its own is taken up where it ended, also by another driver: finished
    iterations are read, not repeated.

    ``strict`` stops with an error when 99 % of the coefficients of a cell are zero; otherwise
    the cell keeps its last state.
    """
    if [c.cell for c in cells] != list(range(len(cells))):
        raise ValueError("cells must be numbered 0, 1, ...")
    state = initial if initial is not None else initial_state(problem, cells, algo)
    spark = problem.rows.sparkSession
    run = Run(problem, cells, algo, path or scratch_table(spark, "training"), state)
    run.last = {c.cell: 0 for c in cells}
    if path is not None:
        _same_settings(spark, path, cells, algo)
    health = run.restore() if path is not None else {}
    if health:
        state = run.state(len(run.shifts))
    else:
        health = _health(state)
    active = sorted(health)
    for iteration in range(len(run.shifts) + 1, algo.max_iter + 1):
        going = []
        for c in active:
            delta, sparsity = health[c]
            if delta < algo.min_delta_alpha:
                continue
            if sparsity >= 99.0:
                if strict:
                    raise RuntimeError(f"cell {c}: {sparsity:.1f} % of the coefficients are zero")
                continue
            going.append(c)
        if not going:
            break
        if len(going) < len(active):
            state = state.where(F.col("cell").isin(going))
        active = going
        health = run.advance(state, active, iteration)
        state = run.state(iteration)
    return run


def train_one(
    problem: Problem, model: ModelParams, algo: AlgoParams, initial: DataFrame | None = None, path: str | None = None
) -> Run:
    return train(problem, [Cell(0, model)], algo, initial, path=path)
