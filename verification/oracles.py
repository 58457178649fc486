"""SQL for another engine that must give the same rows as the queries of the same name."""

from __future__ import annotations

FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linenumber"]
CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
LINES = f"SELECT *, {CHARGE} AS charge FROM lineitem"
ERRORS = (
    "SELECT *, CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_error, "
    "(value - 50) / 4 AS margin FROM events"
)
FIXED_SCORE = (
    "(CAST(0.95 AS DOUBLE) * l_extendedprice + CAST(-51000.5 AS DOUBLE) * l_discount "
    "+ CAST(48000.25 AS DOUBLE) * l_tax + CAST(1.5 AS DOUBLE) * l_linenumber + CAST(120.5 AS DOUBLE))"
)
PASSES = 40  # per penalty, well past convergence on these tables


def r(expression: str, digits: int) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0::DOUBLE"


def line_cells(folds: list[int]) -> str:
    """Standardized cross-products of every training set, as lists."""
    names = [f"x{i}" for i in range(1, 6)]
    source = ", ".join(f"CAST({f} AS DOUBLE) AS {n}" for f, n in zip(FEATURES, names))
    train = ", ".join(f"({k})" for k in folds)

    def each(call: str) -> str:
        return "[" + ", ".join(call.format(n) for n in names) + "]"

    pairs = "[" + ", ".join(each(f"corr({a}, {{}})") for a in names) + "]"
    return f"""
d AS MATERIALIZED (SELECT l_orderkey % 3 AS f, {CHARGE} AS y, {source} FROM lineitem),
raw AS MATERIALIZED (
  SELECT fold, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, stddev_samp(y) AS sy,
    {each('avg({})')} AS mx, {each('stddev_samp({})')} AS sx, {each('corr(y, {})')} AS cy, {pairs} AS cx
  FROM d, (VALUES {train}) AS t(fold) WHERE d.f <> t.fold GROUP BY fold),
cells AS MATERIALIZED (
  SELECT *, list_transform(cy, lambda c: c * (n - 1) / n) AS xy,
    list_transform(cx, lambda row: list_transform(row, lambda c: c * (n - 1) / n)) AS xx,
    list_max(list_transform(cy, lambda c: abs(c * (n - 1) / n))) AS top
  FROM raw)"""


def line_path(alphas: list[float], folds: list[int] = [-1], lambdas: int = 20, shrink: float = 1e-3) -> str:
    """CTEs up to ``path(fold, alpha, lambda_idx, lam, intercept, weights, beta)``.

    Coordinate descent as a recursion over (penalty, pass, coordinate).
    """
    p = len(FEATURES)
    values = ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas)
    last = lambdas * PASSES * p
    lam = f"(c.top / c.alpha * exp((s.t // {PASSES * p} + 1) * ln({shrink}) / {lambdas}))"
    z = "(c.xy[s.t % 5 + 1] - list_dot_product(c.xx[s.t % 5 + 1], s.b) + s.b[s.t % 5 + 1])"
    return f"""WITH RECURSIVE {line_cells(folds)},
grid AS MATERIALIZED (SELECT cells.*, alpha FROM cells, (VALUES {values}) AS a(alpha)),
steps AS (
  SELECT fold, alpha, 0 AS t, [0, 0, 0, 0, 0]::DOUBLE[] AS b FROM grid
  UNION ALL
  SELECT fold, alpha, t + 1, list_concat(list_concat(b[1:t % 5], [v]), b[t % 5 + 2:])
  FROM (
    SELECT s.fold, s.alpha, s.t, s.b,
      sign({z}) * greatest(abs({z}) - {lam} * c.alpha, 0) / (1 + {lam} * (1 - c.alpha)) AS v
    FROM steps s JOIN grid c ON s.fold = c.fold AND s.alpha = c.alpha
    WHERE s.t < {last})),
points AS MATERIALIZED (
  SELECT s.fold, s.alpha, s.t // {PASSES * p} - 1 AS lambda_idx, s.b AS beta,
    g.top / g.alpha * exp((s.t // {PASSES * p}) * ln({shrink}) / {lambdas}) AS lam,
    g.my, g.mx, list_transform([1, 2, 3, 4, 5], lambda i: s.b[i] * g.sy / g.sx[i]) AS weights
  FROM steps s JOIN grid g ON s.fold = g.fold AND s.alpha = g.alpha
  WHERE s.t > 0 AND s.t % {PASSES * p} = 0),
path AS MATERIALIZED (SELECT *, my - list_dot_product(weights, mx) AS intercept FROM points)"""


def tidy(where: str = "true") -> str:
    return f"""
SELECT CAST(fold AS INTEGER) AS fold, alpha, CAST(lambda_idx AS INTEGER) AS lambda_idx,
  CAST(i - 1 AS INTEGER) AS feature, {r('lam', 8)} AS "lambda", {r('intercept', 2)} AS intercept,
  {r('weights[i]', 3)} AS weight, {r('beta[i]', 7)} AS beta
FROM path, range(1, 6) AS t(i) WHERE {where}"""


def held_out() -> str:
    """Held-out error of every path point, from the rows."""
    score = " + ".join(f"p.weights[{i}] * d.x{i}" for i in range(1, 6))
    return f""",
errors AS MATERIALIZED (
  SELECT p.fold, p.alpha, p.lambda_idx, avg((d.y - p.intercept - ({score})) ** 2) AS mse, var_pop(d.y) AS var
  FROM path p JOIN d ON d.f = p.fold GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT alpha, CAST(lambda_idx AS INTEGER) AS lambda_idx, avg(sqrt(mse)) AS rmse, avg(1 - mse / var) AS r2
  FROM errors GROUP BY alpha, lambda_idx)"""


def statistic(table: str, columns: list[str], call: str) -> str:
    parts = [
        f"SELECT '{c}' AS feature, {call.format('CAST(' + c + ' AS DOUBLE)')} AS value FROM {table}" for c in columns
    ]
    return " UNION ALL ".join(parts)


def profile_columns(value: str, digits: int) -> str:
    parts = {
        "mean": f"avg({value})",
        "variance": f"var_samp({value})",
        "std": f"stddev_samp({value})",
        "max": f"max({value})",
        "min": f"min({value})",
        "l2": f"sqrt(sum({value} * {value}))",
        "l1": f"sum(abs({value}))",
    }
    rounded = ", ".join(f"{r(e, digits)} AS {n}" for n, e in parts.items())
    return f"count({value}) AS n, count(*) FILTER (WHERE {value} <> 0) AS nnz, {rounded}"


def document_path(lambdas: int = 5, shrink: float = 0.05, alpha: float = 0.9, sweeps: int = 1500) -> str:
    """Penalized logistic minimiser by coordinate steps of a fixed upper bound on the curvature."""
    lam = f"(c.top / {alpha} * exp((s.t // {sweeps * 3} + 1) * ln({shrink}) / {lambdas}))"
    residual = (
        "list_transform(range(1, c.rows + 1), "
        "lambda i: c.y[i] - 1 / (1 + exp(-(s.b[1] + s.b[2] * c.x1[i] + s.b[3] * c.x2[i]))))"
    )
    # coordinate 0 is the intercept; standardized columns have mean square (n - 1) / n
    bound = "((c.n - 1) / c.n / 4)"
    z = f"(list_dot_product({residual}, CASE WHEN s.t % 3 = 1 THEN c.x1 ELSE c.x2 END) / c.n + {bound} * s.b[s.t % 3 + 1])"
    step = f"""CASE WHEN s.t % 3 = 0 THEN s.b[1] + 4 * list_sum({residual}) / c.n
      ELSE sign({z}) * greatest(abs({z}) - {lam} * {alpha}, 0) / ({bound} + {lam} * (1 - {alpha})) END"""
    return f"""WITH RECURSIVE
text_stats AS MATERIALIZED (
  SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS y, ln(CAST(length(d.text) AS DOUBLE)) AS f1,
    CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) / length(d.text) AS f2
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
stats AS MATERIALIZED (
  SELECT count(*) AS rows, avg(y) AS my, avg(f1) AS m1, avg(f2) AS m2, stddev_samp(f1) AS s1, stddev_samp(f2) AS s2
  FROM text_stats),
c AS MATERIALIZED (
  SELECT any_value(rows) AS rows, CAST(any_value(rows) AS DOUBLE) AS n, list(y ORDER BY doc_id) AS y,
    list((f1 - m1) / s1 ORDER BY doc_id) AS x1, list((f2 - m2) / s2 ORDER BY doc_id) AS x2,
    greatest(abs(avg((y - my) * (f1 - m1) / s1)), abs(avg((y - my) * (f2 - m2) / s2))) AS top,
    any_value([m1, m2]) AS m, any_value([s1, s2]) AS sd
  FROM text_stats, stats),
steps AS (
  SELECT 0 AS t, [0, 0, 0]::DOUBLE[] AS b
  UNION ALL
  SELECT t + 1, list_concat(list_concat(b[1:t % 3], [v]), b[t % 3 + 2:])
  FROM (SELECT s.t, s.b, {step} AS v FROM steps s, c WHERE s.t < {lambdas * sweeps * 3})),
path AS MATERIALIZED (
  SELECT s.t // {sweeps * 3} - 1 AS lambda_idx, s.b[1] AS beta0, s.b[2:3] AS beta, c.m, c.sd,
    c.top / {alpha} * exp((s.t // {sweeps * 3}) * ln({shrink}) / {lambdas}) AS lam
  FROM steps s, c WHERE s.t > 0 AND s.t % {sweeps * 3} = 0)"""


EMBEDDED = """SELECT vec_id AS k, vec_id % 3 AS f, CASE WHEN label = 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"""
JUDGED = """SELECT l.doc_id AS k, l.doc_id % 3 AS f, CAST(l.quality AS DOUBLE) AS y, [ln(CAST(length(d.text) AS DOUBLE)),
  CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) / length(d.text)] AS v
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def array_columns(rows: str, width: int, folds: list[int]) -> str:
    """CTEs up to ``z``: the standardized values of every feature of every training set, as a list."""
    train = ", ".join(f"({k})" for k in folds)
    return f"""WITH RECURSIVE d AS MATERIALIZED ({rows}),
cols AS (
  SELECT t.fold, i, avg(v[i]) AS m, stddev_samp(v[i]) AS s, CAST(count(*) AS DOUBLE) AS n, avg(y) AS my, stddev_samp(y) AS sy,
    list(v[i] ORDER BY k) AS vs, list(y ORDER BY k) AS ys
  FROM d, (VALUES {train}) AS t(fold), range(1, {width + 1}) AS g(i) WHERE d.f <> t.fold GROUP BY t.fold, i),
z AS MATERIALIZED (SELECT * EXCLUDE (vs), list_transform(vs, lambda x: (x - m) / s) AS z FROM cols)"""


def array_path(rows: str, width: int, alphas: list[float], folds: list[int], lambdas: int, shrink: float, steps: int, momentum: float) -> str:
    """CTEs up to ``path`` as in ``line_path``, for array features: accelerated proximal steps of all coefficients."""
    values = ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas)
    lam = f"(c.top / c.alpha * exp((s.t // {steps} + 1) * ln({shrink}) / {lambdas}))"
    return f"""{array_columns(rows, width, folds)},
gram AS (
  SELECT a.fold, a.i, list(list_dot_product(a.z, b.z) / a.n ORDER BY b.i) AS line FROM z a JOIN z b ON a.fold = b.fold GROUP BY a.fold, a.i),
cells AS MATERIALIZED (
  SELECT z.fold, any_value(z.my) AS my, any_value(z.sy) AS sy, list(z.m ORDER BY z.i) AS mx, list(z.s ORDER BY z.i) AS sx,
    list(list_dot_product(z.z, list_transform(z.ys, lambda y: (y - z.my) / z.sy)) / z.n ORDER BY z.i) AS xy, list(line ORDER BY z.i) AS xx,
    max(list_sum(list_transform(line, lambda x: abs(x)))) AS bound
  FROM z JOIN gram g ON z.fold = g.fold AND z.i = g.i GROUP BY z.fold),
grid AS MATERIALIZED (SELECT *, list_max(list_transform(xy, lambda x: abs(x))) AS top FROM cells, (VALUES {values}) AS a(alpha)),
steps AS (
  SELECT fold, alpha, 0 AS t, list_transform(xy, lambda x: CAST(0 AS DOUBLE)) AS b, list_transform(xy, lambda x: CAST(0 AS DOUBLE)) AS o FROM grid
  UNION ALL
  SELECT fold, alpha, t + 1, list_transform(g, lambda v: sign(v) * greatest(abs(v) - lam * alpha / bound, 0) / (1 + lam * (1 - alpha) / bound)), b
  FROM (
    SELECT fold, alpha, t, b, lam, bound, list_transform(range(1, {width + 1}), lambda i: y[i] + (xy[i] - list_dot_product(xx[i], y)) / bound) AS g
    FROM (
      SELECT s.fold, s.alpha, s.t, s.b, {lam} AS lam, c.bound, c.xy, c.xx,
        list_transform(list_zip(s.b, s.o), lambda p: p[1] + {momentum} * (p[1] - p[2])) AS y
      FROM steps s JOIN grid c ON s.fold = c.fold AND s.alpha = c.alpha WHERE s.t < {lambdas * steps}))),
points AS MATERIALIZED (
  SELECT s.fold, s.alpha, s.t // {steps} - 1 AS lambda_idx, s.b AS beta, g.top / g.alpha * exp((s.t // {steps}) * ln({shrink}) / {lambdas}) AS lam,
    g.my, g.mx, list_transform(range(1, {width + 1}), lambda i: s.b[i] * g.sy / g.sx[i]) AS weights
  FROM steps s JOIN grid g ON s.fold = g.fold AND s.alpha = g.alpha WHERE s.t > 0 AND s.t % {steps} = 0),
path AS MATERIALIZED (SELECT *, my - list_dot_product(weights, mx) AS intercept FROM points)"""


def array_held_out() -> str:
    """Held-out error of every point of ``array_path``, from the rows."""
    return """,
errors AS MATERIALIZED (
  SELECT p.fold, p.alpha, p.lambda_idx, avg((d.y - p.intercept - list_dot_product(p.weights, d.v)) ** 2) AS mse, var_pop(d.y) AS var
  FROM path p JOIN d ON d.f = p.fold GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT alpha, CAST(lambda_idx AS INTEGER) AS lambda_idx, avg(sqrt(mse)) AS rmse, avg(1 - mse / var) AS r2
  FROM errors GROUP BY alpha, lambda_idx)"""


def array_logistic(
    rows: str, width: int, alphas: list[float], folds: list[int], lambdas: int, ratio: float, steps: int, momentum: float
) -> str:
    """CTEs up to ``path`` of logistic minimisers; ``ratio`` is the step of the penalty grid."""
    values = ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas)
    lam = f"(c.top / c.alpha * pow({ratio}::DOUBLE, s.t // {steps} + 1))"
    zeros = "list_transform(range(1, {n}), lambda i: CAST(0 AS DOUBLE))".format(n=width + 2)
    return f"""{array_columns(rows, width, folds)},
pairs AS (SELECT a.fold, a.i, list_sum(list(abs(list_dot_product(a.z, b.z) / a.n))) AS line FROM z a JOIN z b ON a.fold = b.fold GROUP BY a.fold, a.i),
cells AS MATERIALIZED (
  SELECT z.fold, any_value(n) AS n, any_value(ys) AS ys, list(z.z ORDER BY z.i) AS zc, list(m ORDER BY z.i) AS mx, list(s ORDER BY z.i) AS sx,
    max(abs(list_dot_product(z.z, list_transform(ys, lambda y: y - my)) / n)) AS top, greatest(max(line), 1) / 4 AS bound
  FROM z JOIN pairs p ON z.fold = p.fold AND z.i = p.i GROUP BY z.fold),
grid AS MATERIALIZED (
  SELECT *, list_transform(range(1, len(ys) + 1), lambda r: list_concat([CAST(1 AS DOUBLE)], list_transform(zc, lambda c: c[r]))) AS zr
  FROM cells, (VALUES {values}) AS a(alpha)),
steps AS (
  SELECT fold, alpha, 0 AS t, {zeros} AS b, {zeros} AS o FROM grid
  UNION ALL
  SELECT fold, alpha, t + 1, list_concat([g[1]], list_transform(g[2:], lambda v: sign(v) * greatest(abs(v) - lam * alpha / bound, 0) / (1 + lam * (1 - alpha) / bound))), b
  FROM (
    SELECT fold, alpha, t, b, lam, bound,
      list_concat([y[1] + list_sum(res) / n / bound], list_transform(range(1, {width + 1}), lambda i: y[i + 1] + list_dot_product(zc[i], res) / n / bound)) AS g
    FROM (
      SELECT fold, alpha, t, b, y, lam, bound, n, zc, list_transform(range(1, len(ys) + 1), lambda r: ys[r] - 1 / (1 + exp(-list_dot_product(zr[r], y)))) AS res
      FROM (
        SELECT s.fold, s.alpha, s.t, s.b, {lam} AS lam, c.bound, c.n, c.zc, c.zr, c.ys,
          list_transform(list_zip(s.b, s.o), lambda p: p[1] + {momentum} * (p[1] - p[2])) AS y
        FROM steps s JOIN grid c ON s.fold = c.fold AND s.alpha = c.alpha WHERE s.t < {lambdas * steps})))),
points AS MATERIALIZED (
  SELECT s.fold, s.alpha, s.t // {steps} - 1 AS lambda_idx, s.b[1] AS beta0, s.b[2:] AS beta, g.top / g.alpha * pow({ratio}::DOUBLE, s.t // {steps}) AS lam,
    g.mx, list_transform(range(1, {width + 1}), lambda i: s.b[i + 1] / g.sx[i]) AS weights
  FROM steps s JOIN grid g ON s.fold = g.fold AND s.alpha = g.alpha WHERE s.t > 0 AND s.t % {steps} = 0),
path AS MATERIALIZED (SELECT *, beta0 - list_dot_product(weights, mx) AS intercept FROM points)"""


def logistic_held_out(bins: int = 64) -> str:
    """Log loss and hits of every point on its held-out rows, and how many pairs of margin bins a positive wins."""
    return f""",
margins AS MATERIALIZED (
  SELECT p.fold, p.alpha, p.lambda_idx, d.y, p.intercept + list_dot_product(p.weights, d.v) AS m FROM path p JOIN d ON d.f = p.fold),
scores AS MATERIALIZED (
  SELECT fold, alpha, lambda_idx, count(*) AS n, sum(y) AS positives, avg(ln(1 + exp(m)) - y * m) AS log_loss,
    avg(CASE WHEN (m > 0) = (y > 0.5) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy FROM margins GROUP BY ALL),
binned AS MATERIALIZED (
  SELECT fold, alpha, lambda_idx, least(greatest(floor((m + 16) * {bins} / 32), 0), {bins - 1}) AS bin, sum(y) AS p, sum(1 - y) AS q
  FROM margins GROUP BY ALL),
areas AS MATERIALIZED (
  SELECT a.fold, a.alpha, a.lambda_idx, sum(a.p * b.q * CASE WHEN b.bin < a.bin THEN 1 ELSE 0.5 END) AS wins
  FROM binned a JOIN binned b ON a.fold = b.fold AND a.alpha = b.alpha AND a.lambda_idx = b.lambda_idx AND b.bin <= a.bin GROUP BY ALL)"""


def weighted_products() -> str:
    slots = ["CAST(1 AS DOUBLE)", "x1", "x2", "z"]
    margin = "(-0.75::DOUBLE + 0.5::DOUBLE * x1 - 0.25::DOUBLE * x2)"
    pairs = [(i, j) for i in range(3) for j in range(i, 4)]
    sums = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, "
        f"{r(f'sum(w * {slots[i]} * {slots[j]})', 5)} AS value FROM e"
        for i, j in pairs
    )
    return f"""WITH a AS (SELECT is_error AS y, value / 100 AS x1, user_id / 1000.0::DOUBLE AS x2 FROM ({ERRORS})),
b AS (SELECT *, {margin} AS m, 1 / (1 + exp(-{margin})) AS p FROM a),
e AS MATERIALIZED (SELECT *, p * (1 - p) AS w, (y - p) / (p * (1 - p)) + m AS z FROM b) {sums}"""


def start_sums() -> str:
    return f"""WITH e AS ({ERRORS}),
s AS (SELECT count(*) AS n, avg(is_error) AS p, avg(value) AS m1, stddev_samp(value) AS s1,
  avg(user_id) AS m2, stddev_samp(user_id) AS s2 FROM e),
v AS MATERIALIZED (
  SELECT 'value' AS feature, is_error - p AS wr, p * (1 - p) AS w, (value - m1) / s1 AS x FROM e, s
  UNION ALL SELECT 'user_id', is_error - p, p * (1 - p), (user_id - m2) / s2 FROM e, s)"""


CLAMPED = (
    "CASE WHEN p < 1e-5 THEN CAST(0 AS DOUBLE) WHEN 1 - p < 1e-5 THEN CAST(1 AS DOUBLE) ELSE p END"
)
WEIGHT = "CASE WHEN p < 1e-5 OR 1 - p < 1e-5 THEN CAST(1e-5 AS DOUBLE) ELSE p * (1 - p) END"
RECODED = "CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
SPLIT_ALPHAS = "(SELECT DISTINCT round(l_discount + 0.1::DOUBLE, 6) + 0.0::DOUBLE AS alpha FROM lineitem)"
DOT = " + ".join(f"({((i * 7) % 11 - 5) / 4})::DOUBLE * embedding[{i + 1}]::DOUBLE" for i in range(64))

WIDE_SCORE = "0.25::DOUBLE + " + " + ".join(
    f"({((i * 7) % 11 - 5) / 8})::DOUBLE * embedding[{64 - (i - 64) if 64 <= i < 128 else i % 64 + 1}]::DOUBLE" for i in range(192)
)


def all_oracles() -> dict[str, str]:
    folds3 = "(VALUES (0), (1), (2)) AS t(fold)"
    scaled = ", ".join(
        f"{r(f'(({c}) - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', 6)} AS {c}" for c in ["charge", *FEATURES]
    )
    by_fold = "WITH " + line_cells([-1]).replace("(VALUES (-1)) AS t(fold) WHERE d.f <> t.fold", f"{folds3} WHERE d.f = t.fold")
    both = [0.5, 1.0]
    all_folds = [-1, 0, 1, 2]
    embedded = array_path(EMBEDDED, 64, both, all_folds, 10, 0.05, 400, 0.8)
    gram64 = """WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i)),
s AS (SELECT *, (v - avg(v) OVER (PARTITION BY i)) / stddev_samp(v) OVER (PARTITION BY i) AS z FROM e)"""
    return {
        "s1_labeled_text": f"SELECT o_orderkey, {RECODED} AS label, o_totalprice AS total FROM orders",
        "s2_text_min_partitions": f"SELECT CAST(count(*) AS BIGINT) AS n, sum({RECODED}) AS positives, "
        "true AS at_least_four FROM orders",
        "s4_synthetic_rows": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS far, "
        "true AS variance_is_third, true AS noise_is_eps FROM orders",
        "s5_result_sink": line_path([0.5]) + tidy(),
        "p1_select": f"SELECT {r('charge', 7)} AS label, l_extendedprice AS price, "
        f"CAST(l_linenumber AS DOUBLE) AS linenumber FROM ({LINES})",
        "p2_flat_row": f"SELECT CAST(6 AS INTEGER) AS slots, {r('charge', 7)} AS label, l_extendedprice AS price, "
        f"CAST(l_linenumber AS DOUBLE) AS linenumber FROM ({LINES})",
        "p3_recode_label": f"SELECT o_orderkey, {RECODED} AS label FROM orders",
        "p4_standardize_all": f"SELECT l_orderkey, {scaled} FROM ({LINES})",
        "p5_standardize_features": "SELECT event_id, is_error, "
        + ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', 6)} AS {c}" for c in ("value", "user_id"))
        + f" FROM ({ERRORS})",
        "p6_slice_columns": "SELECT vec_id, CAST(embedding[6] AS DOUBLE) AS value0, "
        "CAST(embedding[1] AS DOUBLE) AS value1, CAST(embedding[64] AS DOUBLE) AS value2 FROM embeddings",
        "p7_start_set": f"WITH {line_cells([-1])} SELECT CAST(i - 1 AS INTEGER) AS feature, {r('xy[i]', 7)} AS xy "
        "FROM cells, range(1, 6) AS t(i) WHERE abs(xy[i]) > top * exp(ln(0.001) / 20)",
        "p8_new_features": line_path([0.5])
        + f""" SELECT CAST(i - 1 AS INTEGER) AS feature, {r('b.beta[i]', 7)} AS beta
FROM path a, path b, range(1, 6) AS t(i)
WHERE a.lambda_idx = 0 AND b.lambda_idx = 19 AND a.beta[i] = 0 AND b.beta[i] <> 0""",
        "p9_residual": f"SELECT l_orderkey, {r(f'charge - {FIXED_SCORE}', 6)} AS residual FROM ({LINES})",
        "p10_dot_product": f"SELECT vec_id, {r(f'0.25::DOUBLE + {DOT}', 7)} AS score FROM embeddings",
        "p11_soft_threshold": "SELECT event_id, "
        f"{r('sign(value - 50) * greatest(abs(value - 50) - 10, 0)', 6)} AS shrunk FROM events",
        "p12_logistic_probability": f"SELECT event_id, {r('1 / (1 + exp(-greatest(margin * 12, -100)))', 9)} AS probability "
        f"FROM ({ERRORS})",
        "p13_irls_weight": f"SELECT event_id, {r(CLAMPED, 9)} AS p, {r(WEIGHT, 9)} AS w "
        f"FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM ({ERRORS}))",
        "p14_working_response": f"""WITH e AS (SELECT event_id, is_error, margin / 8 AS m FROM ({ERRORS})),
f AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM e), g AS (SELECT *, (is_error - ({CLAMPED})) / ({WEIGHT}) + m AS z FROM f)
SELECT event_id, {r('z', 6)} AS z, {r('z - (m * 0.75::DOUBLE + 0.1::DOUBLE)', 6)} AS r FROM g""",
        "u1_grow_active_set": line_path([0.5])
        + """ SELECT CAST(i - 1 AS INTEGER) AS feature, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS position
FROM path a, path b, range(1, 6) AS t(i)
WHERE a.lambda_idx = 2 AND b.lambda_idx = 12 AND (a.beta[i] <> 0 OR b.beta[i] <> 0)""",
        "u2_ever_active": line_path([0.5])
        + " SELECT DISTINCT CAST(i - 1 AS INTEGER) AS feature FROM path, range(1, 6) AS t(i) WHERE beta[i] <> 0",
        "u3_grid_points": f"SELECT alpha, CAST(i AS INTEGER) AS lambda_idx FROM {SPLIT_ALPHAS}, range(20) AS t(i)",
        "a1_mean": statistic("lineitem", FEATURES, r("avg({})", 6)),
        "a2_variance": statistic("part", ["p_size", "p_retailprice"], r("var_samp({})", 5)),
        "a3_count": statistic("events", ["value", "user_id"], "count({})"),
        "a4_num_nonzeros": statistic("lineitem", ["l_discount", "l_tax"], "CAST(sum(({} <> 0)::INTEGER) AS BIGINT)"),
        "a5_max": statistic("customer", ["c_acctbal", "c_nationkey"], "max({})"),
        "a6_min": statistic("customer", ["c_acctbal", "c_nationkey"], "min({})"),
        "a7_norm_l2": statistic("supplier", ["s_acctbal", "s_nationkey"], r("sqrt(sum({0} * {0}))", 4)),
        "a8_norm_l1": statistic("orders", ["o_totalprice", "o_custkey"], r("sum(abs({}))", 1)),
        "a9_column_profile": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {profile_columns(c, 5)} FROM lineitem"
            for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
        ),
        "a9_merged_profile": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {profile_columns(c, 5)} FROM lineitem"
            for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
        ),
        "a9_array_profile": f"""WITH e AS (
  SELECT i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))
SELECT CAST(feature AS INTEGER) AS feature, {profile_columns('v', 7)} FROM e GROUP BY feature""",
        "a10_label_stats": f"SELECT count(charge) AS n, {r('avg(charge)', 5)} AS mean, "
        f"{r('stddev_samp(charge)', 5)} AS std FROM ({LINES})",
        "a11_row_count": "SELECT count(*) AS n FROM lineitem",
        "a12_entry_order": line_path([0.5])
        + """, firsts AS (SELECT i - 1 AS feature, min(lambda_idx) AS first_idx
  FROM path, range(1, 6) AS t(i) WHERE beta[i] <> 0 GROUP BY i)
SELECT CAST(feature AS INTEGER) AS feature, CAST(first_idx AS INTEGER) AS first_idx,
  CAST(row_number() OVER (ORDER BY first_idx, feature) - 1 AS INTEGER) AS position FROM firsts""",
        "a12_entry_order_cells": line_path(both, all_folds)
        + """, firsts AS (SELECT fold, alpha, i - 1 AS feature, min(lambda_idx) AS first_idx
  FROM path, range(1, 6) AS t(i) WHERE beta[i] <> 0 GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, alpha, CAST(feature AS INTEGER) AS feature, CAST(first_idx AS INTEGER) AS first_idx,
  CAST(row_number() OVER (PARTITION BY fold, alpha ORDER BY first_idx, feature) - 1 AS INTEGER) AS position FROM firsts""",
        "p8_new_features_cells": line_path(both, all_folds)
        + f""" SELECT CAST(b.fold AS INTEGER) AS fold, b.alpha, CAST(i - 1 AS INTEGER) AS feature, {r('b.beta[i]', 7)} AS beta
FROM path a JOIN path b ON a.fold = b.fold AND a.alpha = b.alpha, range(1, 6) AS t(i)
WHERE a.lambda_idx = 4 AND b.lambda_idx = 19 AND a.beta[i] = 0 AND b.beta[i] <> 0""",
        "u1_grow_active_set_cells": line_path(both, all_folds)
        + """ SELECT CAST(a.fold AS INTEGER) AS fold, a.alpha, CAST(i - 1 AS INTEGER) AS feature,
  CAST(row_number() OVER (PARTITION BY a.fold, a.alpha ORDER BY i) - 1 AS INTEGER) AS position
FROM path a JOIN path b ON a.fold = b.fold AND a.alpha = b.alpha, range(1, 6) AS t(i)
WHERE a.lambda_idx = 2 AND b.lambda_idx = 12 AND (a.beta[i] <> 0 OR b.beta[i] <> 0)""",
        "u2_ever_active_cells": line_path(both, all_folds)
        + " SELECT DISTINCT CAST(fold AS INTEGER) AS fold, alpha, CAST(i - 1 AS INTEGER) AS feature FROM path, range(1, 6) AS t(i) WHERE beta[i] <> 0",
        "m10_transform_wide": f"SELECT vec_id, {r(WIDE_SCORE, 6)} AS prediction FROM embeddings",
        "a13_label_products": by_fold
        + f" SELECT CAST(fold AS INTEGER) AS fold, CAST(i - 1 AS INTEGER) AS feature, {r('xy[i]', 9)} AS xy "
        "FROM cells, range(1, 6) AS t(i)",
        "a14_gram_columns": by_fold
        + f" SELECT CAST(fold AS INTEGER) AS fold, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, "
        f"{r('xx[i][j]', 9)} AS xx FROM cells, range(1, 6) AS t(i), range(1, 6) AS u(j) WHERE i <= j",
        "a14_gram_blocks": gram64
        + f" SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, {r('sum(a.z * b.z) / count(*)', 9)} AS xx "
        "FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i",
        "a14_gram_sparse": """WITH e AS (
  SELECT vec_id % 2 AS fold, vec_id, i, CASE WHEN abs(embedding[i]) > CAST(0.15 AS FLOAT) THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END AS v
  FROM embeddings, range(1, 65) AS t(i)),
s AS (SELECT fold, i, avg(v) AS m, stddev_samp(v) AS s, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY fold, i),
pairs AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) AS s FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL)"""
        + f""" SELECT CAST(p.fold AS INTEGER) AS fold, CAST(p.i - 1 AS INTEGER) AS i, CAST(p.j - 1 AS INTEGER) AS j,
  {r('(p.s / a.n - a.m * b.m) / (a.s * b.s)', 9)} AS xx FROM pairs p JOIN s a ON p.fold = a.fold AND p.i = a.i JOIN s b ON p.fold = b.fold AND p.j = b.i""",
        "a15_largest_product": by_fold + f" SELECT CAST(fold AS INTEGER) AS fold, {r('top', 9)} AS top FROM cells",
        "a16_logistic_start_sums": start_sums()
        + " SELECT feature, "
        + ", ".join(
            f"{r(e, 5)} AS {n}"
            for n, e in {"wxr": "sum(wr * x)", "wxx": "sum(w * x * x)", "wr": "sum(wr)", "w": "sum(w)"}.items()
        )
        + " FROM v GROUP BY feature",
        "a17_weighted_products": weighted_products(),
        "o1_order_of_weights": line_path([0.5])
        + """, w AS (SELECT lambda_idx, i - 1 AS feature, abs(weights[i]) AS size FROM path, range(1, 6) AS t(i))
SELECT CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(feature AS INTEGER) AS feature,
  CAST(row_number() OVER (PARTITION BY lambda_idx ORDER BY size DESC, feature) - 1 AS INTEGER) AS position FROM w""",
        "o1_order_wide": array_path(EMBEDDED, 64, [0.5], all_folds, 10, 0.05, 400, 0.8)
        + """ SELECT CAST(fold AS INTEGER) AS fold, CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(i - 1 AS INTEGER) AS feature,
  CAST(row_number() OVER (PARTITION BY fold, lambda_idx ORDER BY abs(weights[i]) DESC, i) - 1 AS INTEGER) AS position
FROM path, range(1, 65) AS t(i) WHERE beta[i] <> 0""",
        "o2_pick_point": line_path([0.5]) + tidy("lambda_idx = 7"),
        "o3_best_point": line_path(both, all_folds)
        + held_out()
        + f" SELECT alpha, lambda_idx, {r('rmse', 4)} AS rmse FROM scores ORDER BY scores.rmse, alpha, lambda_idx LIMIT 1",
        "m1_linear_grid": by_fold
        + f" SELECT CAST(fold AS INTEGER) AS fold, CAST(k AS INTEGER) AS lambda_idx, "
        f"{r('top / 0.2::DOUBLE * exp((k + 1) * ln(0.001) / 100)', 8)} AS \"lambda\" FROM cells, range(100) AS t(k)",
        "m2_logistic_grid": start_sums()
        + """, t AS (SELECT max(a) AS top FROM (SELECT abs(avg(wr * x)) AS a FROM v GROUP BY feature))"""
        + f" SELECT CAST(k AS INTEGER) AS lambda_idx, {r('top / 0.8::DOUBLE * pow(0.93::DOUBLE, k + 1)', 10)} AS \"lambda\" "
        "FROM t, range(30) AS g(k)",
        "m5_path": line_path([0.5]) + tidy(),
        "m5_path_folds": line_path(both, all_folds) + tidy(),
        "m5_path_incremental": line_path([0.5], all_folds) + tidy(),
        "m5_path_blocks": line_path([0.2], all_folds) + tidy(),
        "m5_path_lazy": line_path([0.5]) + tidy(),
        "m6_fit_one": line_path([0.5])
        + f" SELECT CAST(0 AS INTEGER) AS model, CAST(i - 1 AS INTEGER) AS feature, {r('weights[i]', 3)} AS weight, "
        f"{r('intercept', 2)} AS intercept FROM path, range(1, 6) AS t(i) WHERE lambda_idx = 7",
        "m7_fit_many": line_path(both)
        + " SELECT CAST((CASE WHEN alpha = 1 THEN 20 ELSE 0 END) + lambda_idx AS INTEGER) AS model, "
        f"CAST(i - 1 AS INTEGER) AS feature, {r('weights[i]', 3)} AS weight, {r('intercept', 2)} AS intercept "
        "FROM path, range(1, 6) AS t(i)",
        "m8_input_scale": line_path([0.5]) + tidy(),
        "m9_constant_label": "SELECT CAST(k AS INTEGER) AS lambda_idx, CAST(7.25 AS DOUBLE) AS intercept, "
        "CAST(0 AS DOUBLE) AS weight_sum, n FROM (SELECT count(*) AS n FROM lineitem), range(20) AS t(k)",
        "m10_transform": line_path([0.5])
        + " SELECT l_orderkey, l_linenumber, "
        + r(
            "intercept + " + " + ".join(f"weights[{i + 1}] * {c}" for i, c in enumerate(FEATURES)),
            3,
        )
        + " AS prediction FROM lineitem, path WHERE lambda_idx = 7",
        "m11_logistic_path": document_path()
        + " SELECT CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(i - 1 AS INTEGER) AS feature, "
        f"{r('lam', 8)} AS \"lambda\", {r('beta0', 5)} AS beta0, {r('beta[i]', 5)} AS beta FROM path, range(1, 3) AS t(i)",
        "m13_logistic_model": document_path()
        + f" SELECT CAST(i - 1 AS INTEGER) AS feature, "
        f"{r('beta0 - beta[1] * m[1] / sd[1] - beta[2] * m[2] / sd[2]', 4)} AS intercept, "
        f"{r('beta[i] / sd[i]', 4)} AS weight FROM path, range(1, 3) AS t(i) WHERE lambda_idx = 4",
        "m15_key_split": "SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, "
        f"min(l_orderkey) AS first_key, {r('avg(charge)', 5)} AS mean_charge FROM ({LINES}) GROUP BY 1",
        "m16_cross_validation": line_path(both, all_folds)
        + held_out()
        + f" SELECT alpha, lambda_idx, {r('rmse', 4)} AS rmse, {r('r2', 8)} AS r2 FROM scores",
        "m16_cross_validation_mae": line_path(both, all_folds)
        + f""", errors AS MATERIALIZED (SELECT p.fold, p.alpha, p.lambda_idx,
  avg(abs(d.y - p.intercept - ({' + '.join(f'p.weights[{i}] * d.x{i}' for i in range(1, 6))}))) AS mae
  FROM path p JOIN d ON d.f = p.fold GROUP BY ALL)
SELECT alpha, CAST(lambda_idx AS INTEGER) AS lambda_idx, {r('avg(mae)', 4)} AS mae FROM errors GROUP BY alpha, lambda_idx""",
        "m16_cross_validation_lazy": embedded
        + array_held_out()
        + f" SELECT alpha, lambda_idx, {r('rmse', 7)} AS rmse, {r('r2', 7)} AS r2 FROM scores",
        "m5_path_lazy_folds": embedded
        + f""" SELECT CAST(fold AS INTEGER) AS fold, alpha, CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(i - 1 AS INTEGER) AS feature,
  {r('lam', 8)} AS "lambda", {r('intercept', 6)} AS intercept, {r('weights[i]', 5)} AS weight, {r('beta[i]', 6)} AS beta
FROM path, range(1, 65) AS t(i)""",
        "m11_logistic_embeddings": array_logistic(EMBEDDED, 64, [0.9], [-1], 5, 0.05**0.2, 600, 0.85)
        + f""" SELECT CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(i - 1 AS INTEGER) AS feature,
  {r('lam', 8)} AS "lambda", {r('beta0', 5)} AS beta0, {r('beta[i]', 5)} AS beta FROM path, range(1, 65) AS t(i)""",
        "m11_logistic_default_grid": array_logistic(JUDGED, 2, [0.8], [-1], 30, 0.93, 300, 0.9)
        + f""" SELECT CAST(lambda_idx AS INTEGER) AS lambda_idx, CAST(i - 1 AS INTEGER) AS feature,
  {r('lam', 8)} AS "lambda", {r('weights[i]', 5)} AS weight FROM path, range(1, 3) AS t(i)""",
        "m16_logistic_cv": array_logistic(JUDGED, 2, [0.5, 0.9], all_folds, 5, 0.05**0.2, 500, 0.9)
        + logistic_held_out()
        + f""" SELECT CAST(s.fold AS INTEGER) AS fold, s.alpha, CAST(s.lambda_idx AS INTEGER) AS lambda_idx, n, {r('log_loss', 6)} AS log_loss,
  {r('accuracy', 6)} AS accuracy, {r('wins / (positives * (n - positives))', 4)} AS auc FROM scores s JOIN areas USING (fold, alpha, lambda_idx)""",
        "m16_logistic_cv_best": array_logistic(EMBEDDED, 64, [0.9], all_folds, 5, 0.05**0.2, 600, 0.85)
        + logistic_held_out()
        + f""", averaged AS (SELECT alpha, lambda_idx, avg(log_loss) AS log_loss FROM scores GROUP BY alpha, lambda_idx),
best AS (SELECT * FROM averaged ORDER BY log_loss, alpha, lambda_idx LIMIT 1)
SELECT b.alpha, CAST(b.lambda_idx AS INTEGER) AS lambda_idx, {r('b.log_loss', 6)} AS log_loss, {r('p.intercept', 4)} AS intercept,
  CAST(len(list_filter(p.beta, lambda x: x <> 0)) AS INTEGER) AS features
FROM best b JOIN path p ON p.fold = -1 AND p.alpha = b.alpha AND p.lambda_idx = b.lambda_idx""",
        "m16_refit_model": line_path(both, all_folds)
        + held_out()
        + ", best AS (SELECT alpha AS a, lambda_idx AS k FROM scores ORDER BY rmse, alpha, lambda_idx LIMIT 1)"
        + tidy("fold = -1 AND alpha = (SELECT a FROM best) AND lambda_idx = (SELECT k FROM best)"),
        "m17_regression_metrics": f"""WITH e AS (SELECT l_orderkey % 3 AS fold, charge AS y, charge - {FIXED_SCORE} AS r FROM ({LINES}))
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, {r('avg(r * r)', 2)} AS mse, {r('sqrt(avg(r * r))', 4)} AS rmse,
  {r('avg(abs(r))', 4)} AS mae, {r('1 - avg(r * r) / var_pop(y)', 9)} AS r2 FROM e GROUP BY fold""",
        "m19_differences": f"""WITH a AS (
  SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_acctbal + 0.5::DOUBLE ELSE c_acctbal END AS v
  FROM customer WHERE c_custkey % 7 <> 3),
e AS (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 13 <> 5)
SELECT c_custkey, {r('a.v', 4)} AS actual, {r('e.v', 4)} AS expected,
  CASE WHEN a.c_custkey IS NULL THEN 'missing' WHEN e.c_custkey IS NULL THEN 'unexpected' ELSE 'differs' END AS problem
FROM a FULL JOIN e USING (c_custkey)
WHERE a.v IS NULL OR e.v IS NULL OR abs(a.v - e.v) > 1e-6""",
    }
