"""DuckDB SQL for the queries of the expression engine, written from the operators' definitions."""

from __future__ import annotations

INPUTS = """(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, (l_quantity::DOUBLE - 25) / 8 AS x,
  (l_discount::DOUBLE - 0.05::DOUBLE) * 40 AS y, l_tax::DOUBLE * 10 AS z FROM lineitem)"""
INF, NAN = "'inf'::DOUBLE", "'nan'::DOUBLE"


def over(top: str, bottom: str) -> str:
    """IEEE division."""
    return f"(CASE WHEN ({bottom}) = 0 THEN ({top}) * pow(({bottom}), -1::DOUBLE) ELSE ({top}) / ({bottom}) END)"


def log_of(function: str, x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN {NAN} WHEN {x} > 0 THEN {function}({x}) WHEN {x} = 0 THEN -{INF} ELSE {NAN} END)"


def within(condition: str, value: str) -> str:
    return f"(CASE WHEN {condition} THEN {value} ELSE {NAN} END)"


#: Each operator's value, and the partial of each argument, at x, y, z.
OPERATORS: dict[str, tuple[str, ...]] = {
    "cos": ("cos(x)", "-sin(x)"),
    "sin": ("sin(x)", "cos(x)"),
    "tan": ("tan(x)", over("1::DOUBLE", "cos(x) * cos(x)")),
    "asin": (within("abs(x) <= 1", "asin(x)"), within("abs(x) <= 1", over("1::DOUBLE", "sqrt(greatest(1 - x * x, 0))"))),
    "acos": (within("abs(x) <= 1", "acos(x)"), within("abs(x) <= 1", over("-1::DOUBLE", "sqrt(greatest(1 - x * x, 0))"))),
    "atan": ("atan(x)", "1 / (1 + x * x)"),
    "sinh": ("sinh(x)", "cosh(x)"),
    "cosh": ("cosh(x)", "sinh(x)"),
    "tanh": ("tanh(x)", "1 / (cosh(x) * cosh(x))"),
    "asinh": ("asinh(x)", "1 / sqrt(x * x + 1)"),
    "acosh": (within("x >= 1", "acosh(greatest(x, 1))"), within("x >= 1", over("1::DOUBLE", "sqrt(greatest(x - 1, 0)) * sqrt(greatest(x + 1, 0))"))),
    "atanh": (f"(CASE WHEN abs(x) < 1 THEN 0.5 * ln((1 + x) / (1 - x)) WHEN x = 1 THEN {INF} WHEN x = -1 THEN -{INF} ELSE {NAN} END)", over("1::DOUBLE", "1 - x * x")),
    "sec": (over("1::DOUBLE", "cos(x)"), over("tan(x)", "cos(x)")),
    "csc": (over("1::DOUBLE", "sin(x)"), f"-({over(over('1::DOUBLE', 'tan(x)'), 'sin(x)')})"),
    "cot": (over("1::DOUBLE", "tan(x)"), f"-({over('1::DOUBLE', 'sin(x) * sin(x)')})"),
    "exp": ("exp(x)", "exp(x)"),
    "log": (log_of("ln", "x"), over("1::DOUBLE", "x")),
    "log2": (log_of("log2", "x"), over("1::DOUBLE", "x * ln(2::DOUBLE)")),
    "log10": (log_of("log10", "x"), over("1::DOUBLE", "x * ln(10::DOUBLE)")),
    "log1p": (log_of("ln", "(1 + x)"), over("1::DOUBLE", "1 + x")),
    "exp2": ("pow(2::DOUBLE, x)", "pow(2::DOUBLE, x) * ln(2::DOUBLE)"),
    "expm1": ("exp(x) - 1", "exp(x)"),
    "sqrt": (within("x >= 0", "sqrt(greatest(x, 0))"), within("x >= 0", over("0.5::DOUBLE", "sqrt(greatest(x, 0))"))),
    "cbrt": ("cbrt(x)", over("1::DOUBLE", "3 * cbrt(x) * cbrt(x)")),
    "abs": ("abs(x)", "sign(x)::DOUBLE"),
    "abs2": ("x * x", "2 * x"),
    "inv": (over("1::DOUBLE", "x"), f"-({over('1::DOUBLE', 'x * x')})"),
    "sign": ("(CASE WHEN x < 0 THEN -1::DOUBLE ELSE 1::DOUBLE END)", "0::DOUBLE"),
    "identity": ("x", "1::DOUBLE"),
    "neg": ("-x", "-1::DOUBLE"),
    "add": ("x + y", "1::DOUBLE", "1::DOUBLE"),
    "sub": ("x - y", "1::DOUBLE", "-1::DOUBLE"),
    "mul": ("x * y", "y", "x"),
    "div": (over("x", "y"), over("1::DOUBLE", "y"), f"-({over('x', 'y * y')})"),
    "pow": ("pow(x, y)", "y * pow(x, y - 1)", f"pow(x, y) * {log_of('ln', 'x')}"),
    "atan2": ("atan2(x, y)", over("y", "x * x + y * y"), f"-({over('x', 'x * x + y * y')})"),
    "min": ("least(x, y)", "(CASE WHEN x < y THEN 1 WHEN x = y THEN 0.5 ELSE 0 END)::DOUBLE", "(CASE WHEN y < x THEN 1 WHEN x = y THEN 0.5 ELSE 0 END)::DOUBLE"),
    "max": ("greatest(x, y)", "(CASE WHEN x > y THEN 1 WHEN x = y THEN 0.5 ELSE 0 END)::DOUBLE", "(CASE WHEN y > x THEN 1 WHEN x = y THEN 0.5 ELSE 0 END)::DOUBLE"),
    "fma": ("x * y + z", "y", "x", "1::DOUBLE"),
    "clamp": ("(CASE WHEN x < y THEN y WHEN x > z THEN z ELSE x END)", "(CASE WHEN x < y OR x > z THEN 0 ELSE 1 END)::DOUBLE", "(CASE WHEN x < y THEN 1 ELSE 0 END)::DOUBLE", "(CASE WHEN x >= y AND x > z THEN 1 ELSE 0 END)::DOUBLE"),
}


def shown(column: str, name: str = "v") -> str:
    return (
        f"round(CASE WHEN isfinite({column}) THEN {column} ELSE 0 END, 6) + 0.0 AS {name}, isnan({column}) AS {name}_nan, "
        f"CASE WHEN isnan({column}) THEN 0 WHEN {column} = {INF} THEN 1 WHEN {column} = -{INF} THEN -1 ELSE 0 END AS {name}_inf"
    )


LINES = "(SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_extendedprice::DOUBLE AS p FROM lineitem)"
PREDICTIONS = f"(SELECT *, x * cos(y) AS yhat, (l_linenumber % 4)::DOUBLE AS w, x * cos(y) - z AS r FROM {INPUTS})"
#: Point losses and their slopes at the residual r.
LOSSES = {
    "mse": ("r * r", "2 * r"),
    "mae": ("abs(r)", "sign(r)"),
    "rmse": ("r * r", None),
    "huber": ("CASE WHEN abs(r) <= 1 THEN 0.5 * r * r ELSE abs(r) - 0.5 END", "CASE WHEN abs(r) <= 1 THEN r ELSE sign(r) END"),
    "logcosh": ("ln(cosh(r))", "tanh(r)"),
    "lp": ("pow(abs(r), 3)", "3 * r * abs(r)"),
    "quantile": ("CASE WHEN r <= 0 THEN -0.3 * r ELSE 0.7 * r END", "CASE WHEN r < 0 THEN -0.3 WHEN r > 0 THEN 0.7 ELSE 0 END"),
    "epsins": ("greatest(abs(r) - 0.1, 0)", "CASE WHEN abs(r) > 0.1 THEN sign(r) ELSE 0 END"),
}
MEMBERS = """(SELECT p_partkey % 31 AS pop, p_partkey AS id, p_partkey AS arrival, (p_partkey * 7919) % 1000 AS birth, p_size::INTEGER AS complexity,
  ((p_partkey * 48271) % 997)::DOUBLE AS loss, ((p_partkey * 16807) % 499)::DOUBLE AS cost FROM (SELECT p_partkey::BIGINT AS p_partkey, p_size FROM part))"""
HOF = f"(SELECT pop, id, arrival, birth, complexity, loss, cost FROM {MEMBERS} WHERE complexity BETWEEN 1 AND 30 QUALIFY row_number() OVER (PARTITION BY complexity ORDER BY cost, arrival) = 1)"
PARETO = f"(SELECT pop, id, arrival, birth, complexity, loss, cost FROM (SELECT *, min(loss) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {HOF}) WHERE m IS NULL OR loss < m)"
TOP = "(SELECT * FROM {m} QUALIFY row_number() OVER (PARTITION BY pop ORDER BY cost, arrival) <= {n})"
HISTOGRAM = f"(SELECT s.size::INTEGER AS size, coalesce(n, 0) + 1.0::DOUBLE AS freq FROM range(1, 31) AS s(size) LEFT JOIN (SELECT complexity, count(*) AS n FROM {MEMBERS} GROUP BY 1) c ON c.complexity = s.size)"


def split_key(key: str, seed: int) -> str:
    return f"((({key}::BIGINT % 2147483647) + {seed + 1}) * 1327217885) % 2147483647"


def metric(weight: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN m USING ({by})" if by else "CROSS JOIN m"
    return f"""
WITH m AS (SELECT {keys}sum(z * {weight}) / sum({weight}) AS my, avg(yhat) AS mp FROM {PREDICTIONS} GROUP BY ALL),
s AS (SELECT {keys}count(*) AS n, sum({weight}) AS sw, sum(r * r * {weight}) AS se, sum(abs(r) * {weight}) AS ae, sum((z - my) * (z - my) * {weight}) AS sst,
  sum((z - my) * (yhat - mp)) AS cov, sum((z - my) * (z - my)) AS vy, sum((yhat - mp) * (yhat - mp)) AS vp, min(abs(r)) AS lo, max(abs(r)) AS hi
  FROM {PREDICTIONS} {join} {group})
SELECT {keys}n, round(se / sw, 6) AS mse, round(ae / sw, 6) AS mae, round(sqrt(se / sw), 6) AS rmse, round(1 - se / sst, 6) AS r2,
  round(cov / (sqrt(vy) * sqrt(vp)), 6) AS corr, round(lo, 6) AS min_abs_err, round(hi, 6) AS max_abs_err FROM s
"""


def null_keys(weight: str, flag: str) -> str:
    return f"""
SELECT key, {flag} AS weighted, n, round(se / sw, 6) AS mse, round(ae / sw, 6) AS mae, round(1 - se / sst, 6) AS r2, round(cov / (sqrt(vy) * sqrt(vp)), 6) AS corr FROM (
  SELECT key, count(*) AS n, sum({weight}) AS sw, sum(r * r * {weight}) AS se, sum(abs(r) * {weight}) AS ae, sum((z - my) * (z - my) * {weight}) AS sst,
    sum((z - my) * (yhat - mp)) AS cov, sum((z - my) * (z - my)) AS vy, sum((yhat - mp) * (yhat - mp)) AS vp
  FROM (SELECT *, sum(z * {weight}) OVER k / sum({weight}) OVER k AS my, avg(yhat) OVER k AS mp
    FROM (SELECT *, nullif(l_returnflag, 'R') AS key FROM {PREDICTIONS}) WINDOW k AS (PARTITION BY key)) GROUP BY key)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, (value, *partials) in OPERATORS.items():
        out[f"op_{name}"] = f"SELECT l_orderkey, l_linenumber, {shown('v')} FROM (SELECT *, {value} AS v FROM {INPUTS})"
        columns = ", ".join(f"{p} AS p{i}" for i, p in enumerate(partials))
        out[f"d_{name}"] = f"SELECT l_orderkey, l_linenumber, {', '.join(shown(f'p{i}', f'd{i}') for i in range(len(partials)))} FROM (SELECT *, {columns} FROM {INPUTS})"
    evaluated = {"eval_readme": "a * cos(b - 3.2::DOUBLE)", "eval_fma": "(a * b + c) / 2.5::DOUBLE", "eval_nested": "exp(-(b * b)) + greatest(sin(a), b) * 0.5::DOUBLE"}
    out |= {k: f"SELECT l_orderkey, l_linenumber, round({v}, 6) AS yhat, true AS ok FROM {LINES}" for k, v in evaluated.items()}
    for name, (point, slope) in LOSSES.items():
        root = "sqrt" if name == "rmse" else ""
        out[f"loss_{name}"] = f"SELECT l_returnflag, round({root}(avg({point})), 6) AS loss, count(*) AS n FROM {PREDICTIONS} GROUP BY 1"
        out[f"loss_{name}_w"] = f"SELECT l_returnflag, round({root}(sum(w * ({point})) / sum(w)), 6) AS loss, count(*) AS n FROM {PREDICTIONS} GROUP BY 1"
        slope = slope or f"r / (SELECT sqrt(sum(w * r * r) / sum(w)) FROM {PREDICTIONS})"
        out[f"dloss_{name}"] = f"SELECT l_orderkey, l_linenumber, round(w * ({slope}), 6) + 0.0 AS slope FROM {PREDICTIONS}"
    counts = {"through_infinity": "x = 0", "log_of_signed": "x <= 0", "bare_feature": "false", "swallowed": "x < 0"}
    out["eval_completeness"] = f"SELECT {', '.join(f'NOT bool_or({c}) AS {n}, count(*) FILTER ({c}) AS bad_{n}' for n, c in counts.items())} FROM {INPUTS}"
    out["diff_readme"] = f"SELECT l_orderkey, l_linenumber, round(a * cos(b - 3.2::DOUBLE), 6) AS yhat, round(-a * sin(b - 3.2::DOUBLE), 6) AS dyhat, true AS ok FROM {LINES}"
    out["grad_features"] = f"SELECT l_orderkey, l_linenumber, round(cos(b - 3.2::DOUBLE), 6) AS g0, round(-a * sin(b - 3.2::DOUBLE), 6) AS g1, 0::DOUBLE AS g2 FROM {LINES}"
    out["grad_constants"] = f"SELECT l_orderkey, l_linenumber, round(a * sin(b - 3.2::DOUBLE), 6) AS g0, round(a + b, 6) AS h0 FROM {LINES}"
    out["avg_y"] = f"SELECT l_returnflag, round(avg(z), 9) AS avg_y, round(sum(z * w) / sum(w), 9) AS avg_y_w FROM {PREDICTIONS} GROUP BY 1"
    out["baseline_and_cost"] = f"""
WITH s AS (SELECT round(avg(pow(a * cos(b - 3.2::DOUBLE) / 1000 - p / 1000, 2)), 6) AS loss, round(avg(pow(p / 1000, 2)), 6) AS baseline FROM {LINES})
SELECT loss, baseline, round(loss / baseline + 6 * 0.001, 6) AS cost, round(loss / 100 / 0.01 + 6 * 0.001, 6) AS cost_without FROM s"""
    out["metrics"], out["metrics_w"], out["metrics_by_flag"] = metric("1.0::DOUBLE"), metric("w"), metric("1.0::DOUBLE", "l_returnflag, l_linestatus")
    out["loss_rollup"] = f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(r * r), 6) AS mse FROM {PREDICTIONS} GROUP BY ROLLUP (l_returnflag, l_linestatus)"
    summary = "SELECT '{n}' AS name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT {e} AS v FROM " + INPUTS + ")"
    out["column_summary"] = " UNION ALL ".join(summary.format(n=n, e=e) for n, e in (("x", "x"), ("y", "y"), ("z", "z"), ("lx", "CASE WHEN x > 0 THEN ln(x) END")))
    out["hof_best_by_complexity"] = f"SELECT * FROM {HOF}"
    out["pareto_front"] = f"SELECT * FROM {PARETO}"
    out["pareto_tail_k"] = f"SELECT * FROM {PARETO} ORDER BY complexity DESC LIMIT 3"
    out["best_sub_pop"] = f"SELECT * FROM {TOP.format(m=MEMBERS, n=12)}"
    out["global_best"] = f"SELECT * FROM {MEMBERS} ORDER BY loss, arrival LIMIT 1"
    out["two_oldest"] = f"SELECT * FROM {MEMBERS} QUALIFY row_number() OVER (PARTITION BY pop ORDER BY birth, arrival) <= 2"
    out["replace_oldest"] = f"""
SELECT * FROM {MEMBERS} QUALIFY row_number() OVER (PARTITION BY pop ORDER BY birth, arrival) > least(2, count(*) OVER (PARTITION BY pop))
UNION ALL SELECT pop, -id, arrival, 10000, complexity, loss, cost FROM {TOP.format(m=MEMBERS, n=2)}"""
    out["size_histogram"] = f"SELECT size, freq FROM {HISTOGRAM}"
    out["freq_normalised"] = f"SELECT size, round(greatest(freq / sum(freq) OVER (), 1e-6), 9) AS share FROM {HISTOGRAM}"
    out["tournament_score"] = f"""
WITH s AS (SELECT size, greatest(freq / sum(freq) OVER (), 1e-6) AS share FROM {HISTOGRAM})
SELECT id, round(cost * exp(20 * coalesce(share, 1e-6)), 6) AS score FROM {MEMBERS} m LEFT JOIN s ON s.size = m.complexity"""
    out["migrants_pool"] = f"""
SELECT p.pop AS target, count(*) AS n, min(cost) AS least FROM (SELECT DISTINCT pop FROM {MEMBERS}) p JOIN {TOP.format(m=MEMBERS, n=2)} t ON t.pop <> p.pop GROUP BY 1"""
    out["asof_lower_complexity"] = f"""
SELECT k::INTEGER AS wanted, f.id, f.complexity FROM (VALUES (0), (3), (17), (30)) AS w(k), {PARETO} f
QUALIFY row_number() OVER (PARTITION BY k ORDER BY f.complexity <= k DESC, CASE WHEN f.complexity <= k THEN -f.complexity ELSE f.complexity END, f.arrival DESC) = 1"""
    out["member_by_id"] = f"SELECT CASE WHEN id = 7 THEN -1 ELSE pop END AS pop, id, arrival, birth, complexity, loss, cost FROM {MEMBERS} WHERE id IN (7, 8)"
    out["column_preview"] = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey LIMIT 12"
    out["finite_filter"] = f"SELECT round(ln(x), 6) AS x, round(y, 6) AS y, count(*) AS n FROM {INPUTS} WHERE x > 0 GROUP BY ALL"
    orders = "(SELECT *, {h} < {limit} AS is_val FROM orders)"
    out["split_hash"] = f"SELECT is_val, o_orderstatus, count(*) AS n, min(o_orderkey) AS least FROM {orders.format(h=split_key('o_orderkey', 7), limit=round(0.2 * 2147483647))} GROUP BY ALL"
    out["split_exact"] = f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {split_key('o_orderkey', 7)}, o_orderkey) <= (SELECT round_even(0.2 * count(*), 0) FROM orders)"
    out["gather_val"] = f"SELECT o_orderkey, o_custkey FROM {orders.format(h=split_key('o_orderkey', 3), limit=round(0.1 * 2147483647))} WHERE is_val"
    out["curve_sorted"] = f"SELECT row_number() OVER (ORDER BY s, y) AS place, round(s, 6) AS x, round(y, 6) AS y FROM (SELECT DISTINCT sqrt(x) AS s, y FROM {INPUTS} WHERE x >= 0)"
    out["curve_places"] = f"SELECT row_number() OVER (ORDER BY sqrt(x), y) AS place, round(sqrt(x), 6) AS x, round(y, 6) AS y FROM {INPUTS} WHERE x >= 0"
    scores = ["x", "cos(y) * 0.5", "NULL", "x * y + 1", "tanh(x) * 0.3 + 0.4"]
    out["score_columns"] = out["score_many"] = " UNION ALL ".join(f"SELECT {k} AS k, round(avg(pow({e} - z, 2)), 6) AS loss, {str(e != 'NULL').lower()} AS ok FROM {INPUTS}" for k, e in enumerate(scores))
    out["metrics_null_keys"] = " UNION ALL ".join(null_keys(w, flag) for w, flag in (("1.0::DOUBLE", "false"), ("w", "true")))
    out["split_null_keys"] = f"""
WITH keyed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey END AS k FROM orders),
ranked AS (SELECT *, row_number() OVER (ORDER BY {split_key('k', 7)}, k) AS p FROM keyed WHERE k IS NOT NULL)
SELECT false AS no_key, p <= (SELECT round_even(0.5 * count(*), 0) FROM ranked) AS is_val, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM ranked GROUP BY ALL
UNION ALL SELECT true, false, count(*), sum(o_orderkey)::BIGINT FROM keyed WHERE k IS NULL"""
    out["csv_roles"] = "SELECT 's_acctbal' AS x, 's_nationkey' AS y, 's_suppkey' AS w, round(s_acctbal::DOUBLE, 2) AS x0, s_nationkey::DOUBLE AS value, s_suppkey::DOUBLE AS weight FROM supplier"
    out["optimize_constants_linear"] = f"""
WITH line AS (SELECT regr_slope(z, x) AS a, regr_intercept(z, x) AS b FROM {PREDICTIONS})
SELECT round(a, 4) AS slope, round(b, 4) AS intercept, round((SELECT avg(pow(a * x + b - z, 2)) FROM {PREDICTIONS}), 4) AS loss FROM line"""
    out["engine_steps"] = "SELECT * FROM (VALUES (0, 0, 8, false, true, false), (1, 4, 8, false, true, true), (2, 8, 8, true, true, true), (3, 8, 8, true, true, true)) AS t(step, cycles, total_cycles, finished, falls, has_front)"
    out["simplified_values"] = "SELECT i::INTEGER AS tree, 0::BIGINT AS differ, false AS grew FROM range(30) AS t(i)"
    out["windowed_loss"] = f"""
SELECT (l_orderkey * 86400) // 432000 * 432000 AS start, count(*) AS rows, CASE WHEN bool_and(x >= -2.75) THEN round(avg(pow(sqrt(greatest(x + 2.75, 0)) - z, 2)), 6) END AS loss, bool_and(x >= -2.75) AS ok
FROM {PREDICTIONS} GROUP BY 1"""
    resid = "(0.5 * x + cos(0.7 * y) - z) * 2 * w"
    out["loss_slopes"] = f"SELECT 0 AS slot, round(sum({resid} * x) / sum(w), 6) AS slope FROM {PREDICTIONS} UNION ALL SELECT 1, round(sum({resid} * -sin(0.7 * y) * y) / sum(w), 6) FROM {PREDICTIONS}"
    return out
