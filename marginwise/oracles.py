"""DuckDB statements that compute what the registered queries compute, by the plain definition."""

import math

GAMMA = 1.0
EPSILON = 0.2
COST = 0.5
DELTA = 0.1
DECLINE = 0.8
BATCH = 0.9
ITERATIONS = 3
# Both rounds of the reference's search, its folds, and the iterations of its training on the same data.
GRID_COSTS = (0.01, 0.1, 1.0, 10.0, 60.0, 80.0, 100.0, 120.0)
GRID_FOLDS = 10
GRID_ITERATIONS = 10
FIXED_WEIGHTS = (0.03, -7.0)
LEVELS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def d(value: float) -> str:
    return f"{value!r}::DOUBLE"


def u(*parts: str) -> str:
    """Uniform number from a hash of the parts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0::DOUBLE)"


INST = """inst AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS label,
  embedding::DOUBLE[] AS x FROM embeddings)"""


def split_case(pos: str, n: str) -> str:
    train = f"floor({n} * 0.5::DOUBLE)"
    validation = f"floor({n} * (1.0::DOUBLE - (0.5::DOUBLE + 0.1::DOUBLE)))"
    return f"CASE WHEN {pos} < {train} THEN 'train' WHEN {pos} < {train} + {validation} THEN 'validation' ELSE 'test' END"


SPLIT = f"""{INST}, data AS MATERIALIZED (SELECT id, label, x, {split_case('pos', 'n')} AS split FROM (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM inst))"""
TRAIN = "tr AS MATERIALIZED (SELECT id, label, x FROM data WHERE split = 'train')"
VALID = "va AS MATERIALIZED (SELECT id, label, x FROM data WHERE split = 'validation')"
TEST = "te AS MATERIALIZED (SELECT id, label, x FROM data WHERE split = 'test')"


def gauss(a: str = "a.x", b: str = "b.x") -> str:
    return f"exp(-{d(GAMMA)} * pow(list_distance({a}, {b}), 2))"


def upper(source: str = "inst", eps: float = EPSILON, name: str = "up") -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT a.id AS i, b.id AS j, {gauss()} AS k
  FROM {source} a JOIN {source} b ON a.id < b.id) WHERE k > {d(eps)})"""


def across(left: str, right: str, name: str, eps: float = EPSILON) -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT a.id AS i, b.id AS j, {gauss()} AS k
  FROM {left} a CROSS JOIN {right} b) WHERE k > {d(eps)})"""


BOTH = "pairs AS MATERIALIZED (SELECT i, j, k FROM up UNION ALL SELECT j, i, k FROM up)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Line items.

ITEM_ID = "concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE)"
ITEMS = f"""items AS MATERIALIZED (SELECT {ITEM_ID} AS id, l_orderkey, l_linenumber, l_shipdate,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS label, l_quantity AS quantity,
  l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""
FEATURES = ("quantity", "price", "discount", "tax")


def scaled(columns, reference: str = "items", extra: str = "") -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns)
    parts = ", ".join(f"({c} - m_{c}) / nullif(s_{c}, 0) AS {c}" for c in columns)
    return f"""stats AS (SELECT {stats} FROM {reference}),
scaled AS MATERIALIZED (SELECT id, l_orderkey, l_linenumber, label, {extra}{parts} FROM items, stats)"""


def rounded(columns, digits: int) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


PROJECTED = f"""proj AS MATERIALIZED (SELECT *, {r(f'quantity * {d(FIXED_WEIGHTS[0])} + discount * {d(FIXED_WEIGHTS[1])}')}
  AS projection FROM items)"""


def cutoffs(source: str, max_error: float) -> str:
    return f"""m AS (SELECT floor(count(*) * {d(max_error)} * 0.5::DOUBLE) AS m FROM {source}),
cut AS (SELECT coalesce((SELECT projection FROM (SELECT projection, row_number() OVER (ORDER BY projection) AS rn
    FROM {source} WHERE label = 1), m WHERE rn = m.m), 0::DOUBLE) AS low,
  coalesce((SELECT projection FROM (SELECT projection, row_number() OVER (ORDER BY projection DESC) AS rn
    FROM {source} WHERE label = -1), m WHERE rn = m.m), 1::DOUBLE) AS high)"""


# Order statistics.


def at_levels(source: str, value: str, levels: str) -> str:
    """CTEs giving ``found (q, level, value)`` for the rows (q, level) of ``levels``."""
    return f"""levels AS ({levels}),
sorted AS MATERIALIZED (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) AS rn, count(*) OVER () AS n FROM {source}),
size AS (SELECT count(*) AS n FROM {source}),
wanted AS (SELECT q, level,
  CASE WHEN level = 0 THEN 1 WHEN level = 1 THEN n ELSE least(ceil((n + 1) * level), n) END::BIGINT AS hi,
  CASE WHEN level = 0 THEN 1 WHEN level = 1 THEN n ELSE greatest(floor((n + 1) * level), 1) END::BIGINT AS lo
  FROM levels, size),
found AS MATERIALIZED (SELECT q, level, 0.5::DOUBLE * (h.v + l.v) AS value FROM wanted
  JOIN sorted h ON h.rn = hi JOIN sorted l ON l.rn = lo)"""


def percent_levels(count: int) -> str:
    return f"SELECT q::INTEGER AS q, 0.01::DOUBLE * q AS level FROM range({count}) t(q)"


# Coefficients.


def draw(cost: str, name: str, seed: int = 0) -> str:
    return f"{cost} * (1.0::DOUBLE - {u(str(seed), 'id', repr(name))})"


CUSTOMER_ALPHAS = f"""al AS MATERIALIZED (SELECT c_custkey AS id, greatest(0::DOUBLE, c_acctbal) / 1000 AS alpha,
  {draw('1.0::DOUBLE', 'alpha_old').replace('id', 'c_custkey')} AS alpha_old FROM customer)"""


def started(source: str, name: str = "s0", cost: float = COST) -> str:
    return f"""{name} AS MATERIALIZED (SELECT 0 AS cell, id, label, {d(cost)} AS C,
  {draw(d(cost), 'alpha')} AS alpha, {draw(d(cost), 'alpha_old')} AS alpha_old FROM {source})"""


def iteration(n: int, decline: float = DECLINE, batch: float = BATCH, delta: float = DELTA) -> str:
    """CTEs taking s<n-1> to s<n>; the kernel is 1 on the diagonal."""
    prev, size = f"s{n - 1}", delta * decline**n
    return f"""g{n} AS MATERIALIZED (SELECT s.cell, s.id, s.label, s.C, s.alpha, s.alpha_old,
  s.label * (coalesce(t.s, 0) + s.alpha * s.label) - 1 AS gradient
  FROM {prev} s LEFT JOIN (SELECT z.cell, p.i AS id, sum(p.k * z.alpha * z.label) AS s
    FROM pairs p JOIN {prev} z ON p.j = z.id GROUP BY 1, 2) t ON s.cell = t.cell AND s.id = t.id),
t{n} AS MATERIALIZED (SELECT *, alpha - {d(size)} * gradient AS step FROM g{n}),
h{n} AS (SELECT cell, sum(label * step) / sum(label * label) AS shift FROM t{n} GROUP BY cell),
e{n} AS MATERIALIZED (SELECT t.*, step - label * shift AS projected FROM t{n} t JOIN h{n} h ON t.cell = h.cell),
x{n} AS MATERIALIZED (SELECT *, CASE WHEN {u('0', 'id', str(n))} < {d(batch)}
  THEN least(C, greatest(0::DOUBLE, projected)) ELSE {d(decline)} * alpha END AS pre FROM e{n}),
f{n} AS (SELECT cell, CASE WHEN sum(alpha_old * alpha_old) > 0.001
  THEN greatest(0::DOUBLE, sum(pre * (pre - alpha_old)) / sum(alpha_old * alpha_old)) END AS m FROM x{n} GROUP BY cell),
s{n} AS MATERIALIZED (SELECT x.cell, id, label, C, pre, CASE WHEN m IS NULL THEN pre ELSE pre + m * alpha_old END AS alpha,
  CASE WHEN m IS NULL THEN alpha_old ELSE pre END AS alpha_old FROM x{n} x JOIN f{n} f ON x.cell = f.cell)"""


def iterations(count: int = ITERATIONS, **kwargs) -> str:
    return ",\n".join(iteration(n, **kwargs) for n in range(1, count + 1))


def scores(pair_table: str, state: str, rows: str, name: str = "sc", where: str = "TRUE") -> str:
    return f"""{name} AS MATERIALIZED (SELECT v.id, v.label, coalesce(s, 0::DOUBLE) AS score FROM {rows} v LEFT JOIN
  (SELECT p.j AS id, sum(p.k * z.alpha * z.label) AS s FROM {pair_table} p JOIN {state} z ON p.i = z.id
   WHERE {where} GROUP BY 1) t ON v.id = t.id)"""


EVAL_SCORES = with_(SPLIT, TRAIN, VALID, across("tr", "va", "pv"), started("tr"), scores("pv", "s0", "va"))
ALL_START = with_(INST, upper(), BOTH, started("inst"))
TRAINED = with_(SPLIT, TRAIN, VALID, TEST, upper("tr"), BOTH, across("tr", "va", "pv"), across("tr", "te", "pt"),
                started("tr"), iterations())


def sweep(state: str, suffix: str = "", alpha: str = "alpha") -> str:
    """CTE ``sweep<suffix> (q, correct)`` by clipping and scoring at every level."""
    inner = at_levels(f"{state}", alpha, percent_levels(99))
    for name in ("levels", "sorted", "size", "wanted", "found"):
        inner = inner.replace(f"{name} AS", f"{name}{suffix} AS").replace(f"FROM {name},", f"FROM {name}{suffix},")
        inner = inner.replace(f", {name})", f", {name}{suffix})").replace(f"FROM {name}\n", f"FROM {name}{suffix}\n")
        inner = inner.replace(f"JOIN {name} ", f"JOIN {name}{suffix} ")
    inner = inner.replace("FROM levels" + suffix + ", size)", "FROM levels" + suffix + ", size" + suffix + ")")
    return f"""{inner},
sweep{suffix} AS MATERIALIZED (SELECT f.q, count(*) FILTER (WHERE s * v.label > 0) AS correct FROM found{suffix} f
  CROSS JOIN va v LEFT JOIN (SELECT q, p.j AS id, sum(p.k * z.{alpha} * z.label) AS s FROM found{suffix} f
    JOIN {state} z ON NOT (z.{alpha} < f.value) JOIN pv p ON p.i = z.id GROUP BY 1, 2) t
  ON f.q = t.q AND v.id = t.id GROUP BY f.q)"""


# --- sources

SCAN_NUMERIC_CSV = """SELECT l_orderkey::DOUBLE AS c0, l_linenumber::DOUBLE AS c1, l_quantity AS c2,
  l_extendedprice AS c3, l_discount AS c4, l_tax AS c5 FROM lineitem"""
CSV_SHAPE = "SELECT count(*) AS n_lines, 6::BIGINT AS n_columns FROM lineitem"
FEATURE_VECTOR = """SELECT CASE WHEN l_linenumber > 3 THEN 1 ELSE -1 END AS label, l_quantity AS x0, l_tax AS x1,
  l_partkey::DOUBLE AS x2 FROM lineitem"""
LOAD_SPLITS = """SELECT CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN l_linenumber > 3 THEN 1 ELSE -1 END AS label, l_quantity AS x0, l_tax AS x1 FROM lineitem"""
_LONG = "unnest(x) AS value, (generate_subscripts(x, 1) - 1)::INTEGER AS dim"
SCAN_LABELED = with_(INST) + f"SELECT id, label, {_LONG} FROM inst"
ROW_LOOKUP = with_(SPLIT) + f"SELECT id, label, {_LONG} FROM data WHERE split = 'train' AND id = 7"
LABELS_OF_SPLIT = with_(SPLIT) + "SELECT id, label FROM data WHERE split = 'validation'"
SPLIT_SIZES = with_(SPLIT) + "SELECT split, count(*) AS n, max(len(x))::BIGINT AS d FROM data GROUP BY split"
SPLIT_BY_RATIO = f"""SELECT id, {split_case('pos', 'n')} AS split FROM (SELECT o_orderkey AS id,
  row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"""
UPPER_TRIANGLE = """WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier)
SELECT a.n AS i, b.n AS j FROM r a JOIN r b ON a.n < b.n"""
VECTOR_TO_ENTRIES = """SELECT 0::BIGINT AS i, c_custkey AS j, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer"""
SPARSE_VECTOR_TO_ENTRIES = "SELECT 0::BIGINT AS i, c_custkey AS j, c_acctbal AS value FROM customer WHERE abs(c_acctbal) > 5000"
ENTRIES_TO_DENSE_VECTOR = """SELECT c_custkey AS i, CASE WHEN abs(c_acctbal) > 5000 THEN c_acctbal ELSE 0::DOUBLE END AS value
FROM customer"""
EVENTS_MATRIX = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM events)),
m AS MATERIALIZED (SELECT user_id AS i, j, sum(value) AS value FROM events JOIN kinds USING (event_type) GROUP BY 1, 2)"""
MATRIX_ROW = with_(EVENTS_MATRIX) + f"""SELECT t.i, {r("coalesce(m.value, 0::DOUBLE)", 2)} AS value
FROM (SELECT j AS i FROM kinds) t LEFT JOIN m ON m.i = 3 AND m.j = t.i WHERE EXISTS (SELECT 1 FROM m WHERE i = 3)"""

# --- projections, filters, predicates

RELABEL = """SELECT o_orderkey AS id, CASE WHEN trunc(o_totalprice / 200000)::INTEGER > 0 THEN 1 ELSE -1 END AS label
FROM orders"""
ZSCORE_TRAIN = with_(ITEMS, scaled(FEATURES)) + f"SELECT l_orderkey, l_linenumber, {rounded(FEATURES, 4)} FROM scaled"
ZSCORE_APPLY = with_(
    ITEMS,
    "base AS (SELECT * FROM items WHERE l_shipdate < TIMESTAMP '1999-01-01')",
    scaled(FEATURES, "base", "CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split, "),
) + f"SELECT split, l_orderkey, l_linenumber, {rounded(FEATURES, 4)} FROM scaled"
EPSILON_FILTER = with_(INST) + f"""SELECT i, j, {r('sqrt(dot)')} AS k FROM (SELECT a.id AS i, b.id AS j,
  list_dot_product(a.x, b.x) AS dot FROM inst a JOIN inst b ON a.id < b.id)
WHERE CASE WHEN dot < 0 THEN FALSE ELSE sqrt(dot) > 0.4::DOUBLE END"""
_THRESHOLD = at_levels("al", "alpha", "SELECT 0 AS q, 0.3::DOUBLE AS level")
CLIP_ALPHAS = with_(CUSTOMER_ALPHAS, _THRESHOLD) + f"""SELECT id, {r('CASE WHEN alpha < value THEN 0 ELSE alpha END')} AS alpha
FROM al, found"""
BOX_CONSTRAINT = "SELECT c_custkey AS id, least(5000::DOUBLE, greatest(0::DOUBLE, c_acctbal)) AS alpha FROM customer"
SELECTION_BAND = with_(ITEMS, PROJECTED, cutoffs("proj", 0.2)) + """SELECT l_orderkey, l_linenumber, label, projection
FROM proj, cut WHERE projection > low AND projection < high"""
CLASSIFY_SIGN = EVAL_SCORES + f"SELECT id, {r('score')} AS score, sign(score)::DOUBLE AS prediction FROM sc"
DOCUMENT_SCORES = """ds AS MATERIALIZED (SELECT d.doc_id AS id, n_chars::DOUBLE AS score,
  CASE WHEN quality > 0 THEN 1 ELSE -1 END AS label FROM documents d JOIN labels USING (doc_id))"""


def quantiles(source: str, name: str = "qs") -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, rank::DOUBLE / max(rank) OVER () AS quantile FROM
  (SELECT *, rank() OVER (ORDER BY score DESC) - 1 AS rank FROM {source}))"""


CLASSIFY_RANK_THRESHOLD = with_(DOCUMENT_SCORES, quantiles("ds")) + """SELECT id,
  CASE WHEN quantile > 0.7::DOUBLE THEN -1::DOUBLE ELSE 1::DOUBLE END AS prediction FROM qs"""
CLASSIFY_RAW_THRESHOLD = EVAL_SCORES + """SELECT id,
  CASE WHEN score < 0.1::DOUBLE THEN 1::DOUBLE ELSE -1::DOUBLE END AS prediction FROM sc"""
DROP_AND_RENAME = "SELECT l_quantity AS input1, l_extendedprice AS input2, l_returnflag AS class FROM lineitem"

# --- joins

KERNEL_PAIRS_TRAIN = with_(INST, upper(), BOTH) + f"SELECT i, j, {r('k')} AS k FROM pairs"
KERNEL_PAIRS_EVAL = with_(SPLIT, TRAIN, VALID, TEST, across("tr", "va", "pv"), across("tr", "te", "pt")) + f"""
SELECT 'validation' AS split, i, j, {r('k')} AS k FROM pv UNION ALL SELECT 'test', i, j, {r('k')} FROM pt"""
KERNEL_MATRIX_SIGNED = with_(INST) + f"""SELECT i, j, {r('y * k')} AS value FROM (SELECT a.id AS i, b.id AS j,
  a.label * b.label AS y, {gauss()} AS k FROM inst a CROSS JOIN inst b) WHERE k > {d(EPSILON)}"""
KERNEL_DIAGONAL = with_(INST) + f"""SELECT id, {r('pow(0.5::DOUBLE + 2.0::DOUBLE * list_dot_product(x, x), 3)')} AS k FROM inst"""


def block_case(pos: str, n: str) -> str:
    """Block number by position: the ends are the roots of the quarters of the area."""
    ends = [f"floor({n} * sqrt({k} / 4::DOUBLE) + 0.5::DOUBLE)" for k in (1, 2, 3)]
    return "(CASE " + " ".join(f"WHEN {pos} < {end} THEN {k}" for k, end in enumerate(ends)) + " ELSE 3 END)"


KERNEL_PAIRS_BY_BLOCK = with_(
    INST,
    f"""bt AS MATERIALIZED (SELECT *, {block_case('pos', 'n')} AS block FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos,
  count(*) OVER () AS n FROM inst))""",
) + f"""SELECT i, j, {r('k')} AS k, block_i, block_j FROM (SELECT a.id AS i, b.id AS j, {gauss()} AS k, a.block AS block_i,
  b.block AS block_j FROM bt a JOIN bt b ON a.id < b.id) WHERE k > {d(EPSILON)}"""
KERNEL_PAIRS_BLOCKED = with_(
    SPLIT,
    f"""bt AS MATERIALIZED (SELECT *, {block_case('pos', 'n')} AS block FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos,
  count(*) OVER () AS n FROM data WHERE split = 'train'))""",
    f"""bv AS MATERIALIZED (SELECT *, {block_case('(pos % quarter)', 'quarter')} AS block FROM (SELECT *, n // 4 AS quarter FROM
  (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM data WHERE split = 'validation')))""",
) + f"""SELECT split, i, j, {r('k')} AS k FROM (
  SELECT 'train' AS split, a.id AS i, b.id AS j, {gauss()} AS k FROM bt a JOIN bt b ON a.block = b.block AND a.id <> b.id
  UNION ALL SELECT 'validation', a.id, b.id, {gauss()} FROM bt a JOIN bv b ON a.block = b.block) WHERE k > {d(EPSILON)}"""
MATMUL_SPARSE = with_(EVENTS_MATRIX) + f"""SELECT a.i, b.i AS j, {r('sum(a.value * b.value)', 4)} AS value
FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i"""
MATMUL_GRAM = with_(EVENTS_MATRIX) + f"""SELECT a.j AS i, b.j, {r('sum(a.value * b.value)', 4)} AS value
FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j"""
MATVEC_SIGNUM = with_(EVENTS_MATRIX, "v AS (SELECT j, count(*) * (j + 1)::DOUBLE AS w FROM m GROUP BY j)") + f"""
SELECT i, {r('sum(sign(round(value, 2) - 800) * w)', 4)} AS value FROM m JOIN v USING (j) GROUP BY i"""
SCORE_JOIN = EVAL_SCORES + f"SELECT id, {r('score')} AS score FROM sc"
ALIGN_BY_ID = """SELECT doc_id AS id, n_chars * (CASE WHEN quality > 0 THEN 1 ELSE -1 END) AS product
FROM documents JOIN labels USING (doc_id)"""
KERNEL_RADIUS_JOIN = f"""WITH c AS (SELECT c_custkey AS id, [c_acctbal / 1000, c_nationkey::DOUBLE] AS x FROM customer)
SELECT i, j, {r('k')} AS k FROM (SELECT a.id AS i, b.id AS j, {gauss()} AS k FROM c a JOIN c b ON a.id < b.id)
WHERE k > 0.5::DOUBLE"""

# --- aggregations

COLUMN_SUMMARY = with_(ITEMS) + " UNION ALL ".join(
    f"SELECT {k} AS dim, {r(f'avg({c})', 8)} AS mean, {r(f'var_samp({c})')} AS variance, {r(f'stddev_samp({c})')} AS sd FROM items"
    for k, c in enumerate(FEATURES)
)
LABEL_TABLE = with_(SPLIT) + """SELECT split, count(*) FILTER (WHERE label > 0) AS n_positive,
  count(*) FILTER (WHERE label < 0) AS n_negative, count(*) AS n_total FROM data GROUP BY split"""
GRADIENT = ALL_START.rstrip() + ",\n" + iteration(1) + f"\nSELECT id, {r('gradient')} AS gradient FROM g1"
NONZERO_COUNT_TRAIN = with_(INST, upper()) + "SELECT (SELECT count(*) FROM inst) + 2 * (SELECT count(*) FROM up) AS nonzero"
NONZERO_COUNT_EVAL = with_(SPLIT, TRAIN, VALID, across("tr", "va", "pv")) + "SELECT count(*) AS nonzero FROM pv"
_P = 2147483647
# Blocks of 10,000 pair numbers; of the jumps of a block, of mean 10, some 1,000 stay inside, never 2,000.
DENSITY_SAMPLED = with_(
    INST,
    "pos AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS p, x FROM inst)",
    "size AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM inst)",
    f"""h0 AS (SELECT b, k, ((b % {_P}) * 48271 + (k % {_P}) * 69621 + 11) % {_P} AS h
  FROM (SELECT unnest(range((total + 9999) // 10000)) AS b FROM size), range(2000) t(k))""",
    f"h1 AS (SELECT b, k, (h * ((h + 12345) % {_P})) % {_P} AS h FROM h0)",
    f"h2 AS (SELECT b, k, (h * ((h + 12345) % {_P})) % {_P} AS h FROM h1)",
    f"""t0 AS (SELECT b, b * 10000 - 1 + sum(1 + least(10000, floor(ln(1 - h / {_P}::DOUBLE) / ln(0.9::DOUBLE))))
  OVER (PARTITION BY b ORDER BY k) AS t FROM h2)""",
    "t1 AS (SELECT t::BIGINT AS t FROM t0, size WHERE t < least(total, (b + 1) * 10000))",
    "t2 AS (SELECT t, floor((1 + sqrt(1 + 8 * t::DOUBLE)) / 2)::BIGINT AS j FROM t1)",
    "t3 AS (SELECT t - j * (j - 1) // 2 AS i, j FROM t2)",
) + f"""SELECT count(*) AS n_sampled, {r(f'avg(CASE WHEN {gauss()} > {d(EPSILON)} THEN 1.0::DOUBLE ELSE 0 END)')} AS density
FROM t3 JOIN pos a ON a.p = t3.i JOIN pos b ON b.p = t3.j"""
ADJACENCY_SETS = with_(INST, upper(), BOTH) + """SELECT i, j // 65536 AS segment,
  string_agg(j::VARCHAR, ',' ORDER BY j) AS columns FROM pairs GROUP BY 1, 2"""
DELTA_L1 = with_(CUSTOMER_ALPHAS) + f"SELECT {r('sum(abs(alpha - alpha_old))')} AS delta FROM al"
MOMENTUM = with_(CUSTOMER_ALPHAS) + f"""SELECT {r('''CASE WHEN sum(alpha_old * alpha_old) > 0.001 THEN
  greatest(0::DOUBLE, sum(alpha * (alpha - alpha_old)) / sum(alpha_old * alpha_old)) ELSE 0::DOUBLE END''')} AS momentum FROM al"""
SPARSITY_PCT = with_(CUSTOMER_ALPHAS) + f"""SELECT {r('100::DOUBLE * avg(CASE WHEN alpha = 0 THEN 1::DOUBLE ELSE 0 END)')} AS sparsity FROM al"""
JUDGED = """ju AS (SELECT doc_id AS id, CASE WHEN quality > 0 THEN 1 ELSE -1 END AS prediction,
  CASE WHEN toxic > 0 THEN 1 ELSE -1 END AS label FROM labels)"""
ACCURACY = with_(JUDGED) + """SELECT count(*) FILTER (WHERE prediction * label > 0) AS correct,
  count(*) - count(*) FILTER (WHERE prediction * label > 0) AS misclassified FROM ju"""
CONFUSION_COUNTS = with_(JUDGED) + """SELECT count(*) FILTER (WHERE label > 0 AND prediction > 0) AS true_positive,
  count(*) FILTER (WHERE label < 0 AND prediction > 0) AS false_positive,
  count(*) FILTER (WHERE label < 0 AND prediction < 0) AS true_negative,
  count(*) FILTER (WHERE label > 0 AND prediction < 0) AS false_negative FROM ju"""
CLASS_HITS = EVAL_SCORES + """SELECT count(*) FILTER (WHERE score > 0 AND label > 0) AS hits_positive,
  count(*) FILTER (WHERE score < 0 AND label < 0) AS hits_negative,
  count(*) FILTER (WHERE score > 0 AND label <= 0) AS wrongly_positive FROM sc"""
CLASS_TOTALS = """SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n_positive,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS n_negative FROM lineitem"""
_RATES = """c AS (SELECT t.c::INTEGER AS cutoff, count(*) FILTER (WHERE quantile < t.c / 100::DOUBLE AND label > 0) AS tp,
  count(*) FILTER (WHERE quantile < t.c / 100::DOUBLE AND label < 0) AS fp,
  count(*) FILTER (WHERE label > 0) AS p, count(*) FILTER (WHERE label < 0) AS n
  FROM range(1, 100) t(c) CROSS JOIN qs GROUP BY t.c),
rates AS (SELECT cutoff, tp, fp, p, n, tp::DOUBLE / nullif(tp + fp, 0) AS tpr, fp::DOUBLE / nullif(tp + fp, 0) AS fpr FROM c)"""
_RATE_TABLE = f"""SELECT cutoff, tp AS true_positive, fp AS false_positive, {r('tpr')} AS precision, {r('fpr')} AS false_discovery_rate,
  {r('CASE WHEN tpr > 0 AND fpr > 0 THEN tpr / sqrt(fpr) ELSE 0::DOUBLE END')} AS q_value,
  {r('tp::DOUBLE / nullif(p, 0)')} AS sensitivity, {r('(n - fp)::DOUBLE / nullif(n, 0)')} AS specificity,
  {r('(tp + n - fp)::DOUBLE / nullif(p + n, 0)')} AS accuracy FROM rates"""
ROC_TABLE = with_(DOCUMENT_SCORES, quantiles("ds"), _RATES) + _RATE_TABLE
_GRAM = " UNION ALL ".join(
    [
        f"SELECT {a} AS a, {b} AS b, {r(f'sum({x} * {y})' + (' + 0.5::DOUBLE' if a == b else ''), 4)} AS value FROM scaled"
        for a, x in enumerate(FEATURES)
        for b, y in enumerate((*FEATURES, "label"))
    ]
)
GRAM_MATRIX = with_(ITEMS, scaled(FEATURES)) + _GRAM
GRAM_MATRIX_WIDE = with_(INST) + f"""SELECT a, b, {r('sum(u * v) + CASE WHEN a = b THEN 0.5::DOUBLE ELSE 0 END')} AS value
FROM (SELECT id, a::INTEGER AS a, x[a + 1] AS u FROM inst, range(64) t(a)) JOIN
  (SELECT id, b::INTEGER AS b, CASE WHEN b < 64 THEN x[b + 1] ELSE label END AS v FROM inst, range(65) t(b)) USING (id)
GROUP BY a, b"""
RIDGE_WEIGHTS = with_(ITEMS, """g AS (SELECT sum(quantity * quantity) + 0.5::DOUBLE AS a, sum(quantity * discount) AS b,
  sum(discount * discount) + 0.5::DOUBLE AS c, sum(quantity * label) AS e, sum(discount * label) AS f FROM items)""") + f"""
SELECT 0 AS a, {r('(c * e - b * f) / (a * c - b * b)', 9)} AS weight FROM g
UNION ALL SELECT 1, {r('(a * f - b * e) / (a * c - b * b)', 9)} FROM g"""
REPLICATE_SUM = EVAL_SCORES + "SELECT count(*) FILTER (WHERE score * label > 0) AS correct FROM sc"
CONFUSION_MATRIX = with_(JUDGED) + """SELECT prediction AS predicted, count(*) FILTER (WHERE label = -1) AS actual_m1,
  count(*) FILTER (WHERE label = 1) AS actual_1 FROM ju GROUP BY prediction"""
_FP = "count(*) FILTER (WHERE prediction = 1 AND label <> 1)::DOUBLE"
CONFUSION_REPORT = with_(JUDGED) + f"""SELECT {r('avg(CASE WHEN prediction = label THEN 1::DOUBLE ELSE 0 END)')} AS accuracy,
  {r('1 - avg(CASE WHEN prediction = label THEN 1::DOUBLE ELSE 0 END)')} AS error,
  {r(f'{_FP} / nullif(count(*) FILTER (WHERE label = 1), 0)')} AS false_positive_over_actual_positive,
  {r(f'{_FP} / nullif(count(*) FILTER (WHERE label <> 1), 0)')} AS false_positive_over_actual_negative FROM ju"""
DOT_AND_NORM = with_(CUSTOMER_ALPHAS) + f"""SELECT {r('sum(alpha * alpha_old)')} AS dot, {r('sum(alpha * alpha)')} AS norm2_a,
  {r('sum(alpha_old * alpha_old)')} AS norm2_b, {r('min(alpha)')} AS min_a, {r('max(alpha)')} AS max_a FROM al"""
ERROR_MEAN_BY_GRID = f"""WITH e AS (SELECT l_returnflag AS kernel, l_linenumber AS C, l_linestatus AS fold, avg(l_discount) AS error
  FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT kernel, C, avg(error) AS mean_error FROM e GROUP BY 1, 2)
SELECT kernel, C, {r('mean_error')} AS mean_error, row_number() OVER (ORDER BY mean_error, kernel, C) = 1 AS is_best FROM g"""

# --- ranks and order

SCORE_RANK = "SELECT doc_id AS id, rank() OVER (ORDER BY n_chars DESC) - 1 AS rank FROM documents"
SCORE_QUANTILE = with_(
    "li AS (SELECT l_orderkey, l_linenumber, l_quantity AS score FROM lineitem)", quantiles("li")
) + f"SELECT l_orderkey, l_linenumber, rank, {r('quantile', 9)} AS quantile FROM qs"
_LEVEL_ROWS = " UNION ALL ".join(f"SELECT {k} AS q, {d(v)} AS level" for k, v in enumerate(LEVELS))
ORDER_STATISTIC = with_(
    at_levels("customer", "c_acctbal", _LEVEL_ROWS)
) + f"SELECT level AS q, {r('value')} AS value FROM found"
ORDER_STATISTICS_GRID = with_(at_levels("orders", "o_totalprice", percent_levels(99))) + f"SELECT q, {r('value')} AS value FROM found"
RUNNING_MISCLASSIFICATION = with_(ITEMS, PROJECTED, cutoffs("proj", 0.2)) + "SELECT low, high FROM cut"
REPLICATE_AND_BLOCK = f"""SELECT id, {block_case('pos', 'n')} AS train_block, (pos // (n // 4))::INTEGER AS replicate,
  {block_case('(pos % (n // 4))', '(n // 4)')} AS block FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
  count(*) OVER () AS n FROM orders)"""
SORTED_ALPHAS = with_(CUSTOMER_ALPHAS) + f"""
SELECT row_number() OVER (ORDER BY alpha, id) - 1 AS position, id, {r('alpha')} AS alpha FROM al"""
SORTED_PROJECTIONS = with_(ITEMS, PROJECTED) + """
SELECT projection, count(*) FILTER (WHERE label > 0) AS n_positive, count(*) FILTER (WHERE label <= 0) AS n_negative,
  (sum(count(*)) OVER (ORDER BY projection) - count(*))::BIGINT AS ascending,
  (sum(count(*)) OVER (ORDER BY projection DESC) - count(*))::BIGINT AS descending FROM proj GROUP BY projection"""
HEAD_ROWS = with_(INST) + "SELECT id, label FROM inst ORDER BY id LIMIT 1000"
SWEEP_START = with_(SPLIT, TRAIN, VALID, across("tr", "va", "pv"), started("tr"), sweep("s0"))
BEST_SPARSITY = SWEEP_START + "SELECT q AS sparsity, correct FROM sweep ORDER BY correct DESC, q DESC LIMIT 1"
BEST_ITERATION = """WITH e AS (SELECT extract(hour FROM ts)::INTEGER AS iteration, count(DISTINCT event_type) AS correct
  FROM events GROUP BY 1) SELECT iteration, correct FROM e ORDER BY correct DESC, iteration DESC LIMIT 1"""

# --- set operations

MERGE_PAIR_MAPS = with_(INST, upper(), "pos AS (SELECT * FROM inst WHERE label > 0)", upper("pos", name="same")) + """
SELECT i, j FROM up WHERE k > 0.25::DOUBLE UNION SELECT i, j FROM same"""
APPEND_SPLITS = with_(SPLIT) + "SELECT id, label FROM data WHERE split <> 'test'"


def folded(source: str, k: int, seed: int, columns: str = "*") -> str:
    order = u(str(seed), "id")
    return f"""folded AS MATERIALIZED (SELECT {columns}, ((row_number() OVER (PARTITION BY label ORDER BY {order}, id) - 1) % {k})::INTEGER
  AS fold FROM {source})"""


EXCLUDE_FOLD = with_(INST, folded("inst", 10, 3)) + "SELECT id, fold FROM folded WHERE fold <> 4"

# --- scalar and array functions


def on_neighbours(expr: str) -> str:
    return with_(INST) + f"SELECT a.id, {r(expr)} AS value FROM inst a JOIN inst b ON b.id = a.id + 1"


KERNEL_GAUSSIAN = on_neighbours(gauss())
KERNEL_POLYNOMIAL = on_neighbours("pow(0.5::DOUBLE + 2.0::DOUBLE * list_dot_product(a.x, b.x), 3)")
KERNEL_LINEAR = on_neighbours("list_dot_product(a.x, b.x)")
EUCLIDEAN_DISTANCE = on_neighbours("list_distance(a.x, b.x)")
KERNEL_CUSTOM = with_(INST) + f"""SELECT i, j, {r('k')} AS k FROM (SELECT a.id AS i, b.id AS j,
  exp(-list_distance(a.x, b.x)) AS k FROM inst a JOIN inst b ON a.id < b.id) WHERE k > 0.27::DOUBLE"""
KERNEL_SCALE = with_(
    INST,
    "dist AS (SELECT sqrt(list_distance(a.x, b.x)) AS v FROM inst a JOIN inst b ON a.id < b.id)",
    at_levels("dist", "v", "SELECT 0 AS q, 0.01::DOUBLE AS level"),
) + f"SELECT {r(f'1.0::DOUBLE / (2 * pow(value * {d(math.e / 4)}, 2))')} AS gamma FROM found"
ELEMENTWISE = with_(CUSTOMER_ALPHAS) + f"""SELECT id, {r('alpha * 2.5')} AS scaled, {r('alpha * alpha_old')} AS product, {r('alpha - alpha_old')} AS difference,
  {r('abs(alpha)')} AS magnitude, {r('sign(alpha)::DOUBLE')} AS sign, {r('floor(alpha)')} AS whole, {r('exp(alpha)')} AS exponential,
  {r('pow(alpha, alpha_old)')} AS power FROM al"""

# --- iterative model operators

INIT_ALPHAS = with_(INST, started("inst")) + f"SELECT id, {r('alpha', 9)} AS alpha, {r('alpha_old', 9)} AS alpha_old FROM s0"
ALL_TRAINED = ALL_START.rstrip() + ",\n" + iterations() + "\n"
ALPHA_HISTORY = ALL_TRAINED + " UNION ALL ".join(
    f"SELECT {n} AS iteration, id, {r('pre')} AS alpha FROM s{n}" for n in range(1, ITERATIONS + 1)
)
_ONE = ALL_START.rstrip() + ",\n" + iteration(1) + "\n"
GRADIENT_STEP = _ONE + f"SELECT id, {r('step')} AS step FROM t1"
PROJECT_EQUALITY = _ONE + f"SELECT id, {r('projected')} AS projected FROM e1"
STOCHASTIC_MIX = _ONE + f"SELECT id, {r('pre')} AS alpha FROM x1"
MOMENTUM_UPDATE = with_(
    CUSTOMER_ALPHAS,
    """f AS (SELECT CASE WHEN sum(alpha_old * alpha_old) > 0.001
  THEN greatest(0::DOUBLE, sum(alpha * (alpha - alpha_old)) / sum(alpha_old * alpha_old)) END AS m FROM al)""",
) + f"""SELECT id, {r('CASE WHEN m IS NULL THEN alpha ELSE alpha + m * alpha_old END')} AS alpha,
  {r('CASE WHEN m IS NULL THEN alpha_old ELSE alpha END')} AS alpha_old FROM al, f"""
TRAIN_ITERATION = _ONE + f"SELECT id, {r('alpha')} AS alpha, {r('alpha_old')} AS alpha_old FROM s1"
TRAIN_SVM = ALL_TRAINED + f"SELECT id, {r('alpha')} AS alpha, {r('alpha_old')} AS alpha_old FROM s{ITERATIONS}"
SPARSITY_SWEEP = SWEEP_START + "SELECT q, correct FROM sweep"
VALIDATION_EVAL = TRAINED.rstrip() + f""",
cut AS (SELECT greatest(least(0.001::DOUBLE, min(alpha)), 0.000001::DOUBLE) AS e FROM s{ITERATIONS}),
kept AS (SELECT * FROM s{ITERATIONS}, cut WHERE abs(alpha * label) > e),
{scores('pv', 'kept', 'va')}
SELECT count(*) FILTER (WHERE score * label > 0) AS correct, {ITERATIONS} AS iteration FROM sc"""
_SWEEPS = ",\n".join(sweep(f"s{n}", f"_{n}") for n in range(1, ITERATIONS + 1))
_RECORDS = " UNION ALL ".join(f"SELECT {n} AS iteration, q, correct FROM sweep_{n}" for n in range(1, ITERATIONS + 1))
_HISTORY = " UNION ALL ".join(f"SELECT {n} AS iteration, id, pre FROM s{n}" for n in range(1, ITERATIONS + 1))
SELECT_MODEL = TRAINED.rstrip() + f""",
{_SWEEPS},
records AS MATERIALIZED ({_RECORDS}),
best AS MATERIALIZED (SELECT iteration, q FROM records ORDER BY correct DESC, iteration DESC, q DESC LIMIT 1),
picked AS MATERIALIZED (SELECT id, pre AS alpha FROM ({_HISTORY}) h JOIN best USING (iteration)),
{at_levels('picked', 'alpha', 'SELECT q, 0.01::DOUBLE * q AS level FROM best')}
SELECT id, {r('CASE WHEN q > 0 AND alpha < value THEN 0 ELSE alpha END')} AS alpha FROM picked, found"""
_REPORT = """count(*) AS n, count(*) FILTER (WHERE p * label > 0) AS correct,
  count(*) FILTER (WHERE p > 0 AND label > 0) AS correct_positive, count(*) FILTER (WHERE p < 0 AND label < 0) AS correct_negative,
  count(*) FILTER (WHERE score > 0 AND label > 0) AS sign_correct_positive,
  count(*) FILTER (WHERE score < 0 AND label < 0) AS sign_correct_negative,
  count(*) FILTER (WHERE label > 0) AS n_positive, count(*) FILTER (WHERE label < 0) AS n_negative"""
PREDICT = TRAINED.rstrip() + f""",
{scores('pt', f's{ITERATIONS}', 'te')}, {quantiles('sc')}
SELECT 'standard' AS method, {_REPORT} FROM (SELECT *, sign(score) AS p FROM sc)
UNION ALL SELECT 'threshold', {_REPORT} FROM (SELECT *, CASE WHEN quantile > 0.6::DOUBLE THEN -1 ELSE 1 END AS p FROM qs)"""
PREDICT_AUC = TRAINED.rstrip() + f""",
{scores('pt', f's{ITERATIONS}', 'te')}, {quantiles('sc')}, {_RATES}
{_RATE_TABLE}"""
_DISTRIBUTED = with_(
    SPLIT, TRAIN, TEST, across("tr", "te", "pt"), started("tr"),
    "cut AS (SELECT greatest(least(0.001::DOUBLE, min(alpha)), 0.000001::DOUBLE) AS e FROM s0)",
    "kept AS (SELECT * FROM s0, cut WHERE abs(alpha * label) > e)",
    scores("pt", "kept", "te"),
)
PREDICT_STREAM = TRAINED.rstrip() + f""",
{scores('pt', f's{ITERATIONS}', 'te')} SELECT id, {r('score')} AS score FROM sc"""
PREDICT_DISTRIBUTED = _DISTRIBUTED + f"SELECT id, label, {r('score')} AS score, sign(score)::DOUBLE AS prediction FROM sc"
PREDICT_DISTRIBUTED_RAW = _DISTRIBUTED + f"""SELECT id, label, {r('score')} AS score,
  CASE WHEN score < 0.1::DOUBLE THEN 1::DOUBLE ELSE -1::DOUBLE END AS prediction FROM sc"""
PREDICT_DISTRIBUTED_CLIPPED = with_(
    SPLIT, TRAIN, TEST, across("tr", "te", "pt"), started("tr"),
    at_levels("s0", "alpha", "SELECT 0 AS q, 0.3::DOUBLE AS level"),
    "c0 AS MATERIALIZED (SELECT s0.* REPLACE (CASE WHEN alpha < value THEN 0::DOUBLE ELSE alpha END AS alpha) FROM s0, found)",
    "cut AS (SELECT greatest(least(0.001::DOUBLE, min(alpha)), 0.000001::DOUBLE) AS e FROM c0)",
    "kept AS (SELECT * FROM c0, cut WHERE abs(alpha * label) > e)",
    scores("pt", "kept", "te"),
) + f"SELECT id, label, {r('score')} AS score, sign(score)::DOUBLE AS prediction FROM sc"
_SELECT_COLUMNS = ("quantity", "discount")
SELECT_INSTANCES = with_(
    ITEMS,
    scaled(_SELECT_COLUMNS),
    "size AS (SELECT count(*) AS n, greatest(count(*) // 10000, 1) AS reps FROM scaled)",
    f"drawn AS (SELECT *, {u('5', 'id')} AS u FROM scaled)",
    "sampled AS (SELECT *, least(floor(u / 0.1::DOUBLE * reps), reps - 1) AS replicate FROM drawn, size WHERE u < 0.1::DOUBLE)",
    """gram AS (SELECT replicate, sum(quantity * quantity) + 0.5::DOUBLE AS a, sum(quantity * discount) AS b,
  sum(discount * discount) + 0.5::DOUBLE AS c, sum(quantity * label) AS e, sum(discount * label) AS f FROM sampled GROUP BY replicate)""",
    "w AS (SELECT sum((c * e - b * f) / (a * c - b * b)) AS w0, sum((a * f - b * e) / (a * c - b * b)) AS w1 FROM gram)",
    f"proj AS MATERIALIZED (SELECT scaled.*, {r('quantity * (w0 / reps) + discount * (w1 / reps)', 9)} AS projection FROM scaled, w, size)",
    cutoffs("proj", 0.2),
) + f"""SELECT l_orderkey, l_linenumber, label, {r('projection')} AS projection FROM proj, cut
WHERE projection > low AND projection < high"""
KFOLD_ASSIGN = with_(ITEMS, folded("items", 10, 3, "id, label")) + "SELECT id, label, fold FROM folded"
_CELLS = ", ".join(f"({n}, {d(c)}, {f})" for n, (c, f) in enumerate((c, f) for c in GRID_COSTS for f in range(GRID_FOLDS)))
GRID_SEARCH_CV = with_(
    INST,
    folded("inst", GRID_FOLDS, 3),
    upper(),
    BOTH,
    f"cells AS (SELECT * FROM (VALUES {_CELLS}) t(cell, C, held_out))",
    f"""s0 AS MATERIALIZED (SELECT cell, id, label, C, {draw('C', 'alpha')} AS alpha, {draw('C', 'alpha_old')} AS alpha_old
  FROM folded CROSS JOIN cells WHERE fold <> held_out)""",
    iterations(GRID_ITERATIONS),
    f"""asked AS (SELECT c.cell, c.C, f.fold, f.id, f.label, coalesce(t.s, 0) AS score FROM folded f JOIN cells c ON f.fold = c.held_out
  LEFT JOIN (SELECT z.cell, p.i AS id, sum(p.k * z.alpha * z.label) AS s FROM pairs p JOIN s{GRID_ITERATIONS} z ON p.j = z.id GROUP BY 1, 2) t
  ON t.cell = c.cell AND t.id = f.id)""",
    "errors AS (SELECT C, fold, avg(CASE WHEN sign(score) * label > 0 THEN 0::DOUBLE ELSE 1 END) AS error FROM asked GROUP BY 1, 2)",
    "g AS (SELECT 'gaussian' AS kernel, C, avg(error) AS mean_error FROM errors GROUP BY C)",
) + f"""SELECT kernel, C, {r('mean_error')} AS mean_error, row_number() OVER (ORDER BY mean_error, kernel, C) = 1 AS is_best FROM g"""
FINAL_TEST_REPORT = with_(
    SPLIT,
    "tr AS MATERIALIZED (SELECT id, label, x FROM data WHERE split <> 'test')",
    TEST,
    upper("tr"),
    BOTH,
    across("tr", "te", "pt"),
    started("tr"),
    iterations(),
    scores("pt", f"s{ITERATIONS}", "te"),
) + """SELECT sign(score)::INTEGER AS predicted, count(*) FILTER (WHERE label = -1) AS actual_m1,
  count(*) FILTER (WHERE label = 1) AS actual_1 FROM sc GROUP BY 1"""
