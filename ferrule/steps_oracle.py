"""DuckDB SQL for the queries about the steps of a search: what holds for any draw, and what follows from definitions."""

from __future__ import annotations

from ferrule.oracle import HOF, INPUTS, LOSSES, PREDICTIONS


def listed(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


SHOWN = {
    "losses": {**{n: f"avg({p})" for n, (p, _) in LOSSES.items() if n != "rmse"}, "custom": "avg(pow(r, 4))"},
}


def skyline(x: str, y: str) -> str:
    return f"""
WITH best AS (SELECT {x} AS x, {y} AS y, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY x ORDER BY y, l_orderkey, l_linenumber) = 1),
swept AS (SELECT *, min(y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
SELECT x, y, l_orderkey, l_linenumber FROM swept WHERE before IS NULL OR y < before"""


def line(name: str, e: str) -> str:
    fitted = f"regr_slope(z, {e}) AS a, regr_intercept(z, {e}) AS b, regr_syy(z, {e}) / count(*) - pow(regr_sxy(z, {e}), 2) / regr_sxx(z, {e}) / count(*) AS loss"
    return f"SELECT '{name}' AS formula, round(a, 4) AS slope, round(b, 4) AS intercept, round(loss, 5) AS loss FROM (SELECT {fitted} FROM {INPUTS})"


#: 1 - R² and 1 - correlation of p and z by weight w, from sums.
STATES = {
    "r2": "sum({w} * pow({p} - z, 2)) / (sum({w} * z * z) - pow(sum({w} * z), 2) / sum({w}))",
    "correlation": "1 - (sum({w} * z * ({p})) - sum({w} * z) * sum({w} * ({p})) / sum({w})) / sqrt((sum({w} * z * z) - pow(sum({w} * z), 2) / sum({w})) * (sum({w} * pow({p}, 2)) - pow(sum({w} * ({p})), 2) / sum({w})))",
}
#: Members of a priority: the last of each size. A request takes the largest one up to what it wants, else the smallest.
ASOF = """
WITH sized AS (SELECT o_orderpriority, (o_orderkey % 47 + 5)::INTEGER AS c, o_orderkey AS a, o_totalprice AS p FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 47 + 5) % 2 = 1),
members AS (SELECT o_orderpriority, c, max(a) AS a, arg_max(p, a) AS p FROM sized GROUP BY ALL),
asked AS (SELECT o_orderkey, o_orderpriority, o_custkey % 60 AS wanted FROM orders),
found AS (SELECT q.o_orderkey, q.o_orderpriority, q.wanted, coalesce(max(c) FILTER (c <= wanted), min(c)) AS c FROM asked q LEFT JOIN members USING (o_orderpriority) GROUP BY ALL)
SELECT o_orderkey, o_orderpriority, wanted, c AS found_complexity, a AS found_arrival, p AS found_price FROM found LEFT JOIN members USING (o_orderpriority, c)
"""
#: Events in chunks of time, some of them three chunks late. ``seen`` is the latest time of all chunks before a chunk, from
#: which the watermark follows, a day less; Spark drops late rows by that of one chunk earlier (``late``).
CHUNKS = """
span AS (SELECT min(ts) AS a, max(ts) AS z, epoch(max(ts) - min(ts))::BIGINT AS long FROM events),
placed AS (SELECT e.*, least((floor(epoch(ts)) - floor(epoch(a)))::BIGINT * 6 // (floor(epoch(z - a))::BIGINT + 1), 5)::INTEGER AS own FROM events e, span),
rows AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN least(own + 3, 5) ELSE own END AS chunk, value / 10.0 AS x, (event_id % 7)::DOUBLE AS goal FROM placed),
ends AS (SELECT chunk, max(epoch_ms(ts)) - 86400000 AS w FROM rows GROUP BY 1),
marks AS (SELECT c.chunk, (SELECT max(w) FROM ends e WHERE e.chunk < c.chunk) AS seen, (SELECT max(w) FROM ends e WHERE e.chunk < c.chunk - 1) AS late FROM ends c),
last AS (SELECT max(w) AS w FROM ends)"""
WINDOWS = f"""
WITH {CHUNKS},
kept AS (SELECT floor(epoch(ts))::BIGINT // 43200 * 43200 AS start, x, goal FROM (SELECT r.*, m.late FROM rows r JOIN marks m USING (chunk)) WHERE late IS NULL OR (floor(epoch(ts))::BIGINT // 43200 + 1) * 43200000 > late)
SELECT start, count(*) AS rows, CASE WHEN bool_and(x >= -2.75) THEN round(avg(pow(sqrt(greatest(x + 2.75, 0)) - goal, 2)), 6) END AS loss, bool_and(x >= -2.75) AS ok
FROM kept, last WHERE (start + 43200) * 1000 <= w GROUP BY start
"""
STATE_WINDOWS = f"""
WITH {CHUNKS},
kept AS (SELECT event_type, floor(epoch(ts))::BIGINT // 86400 * 86400 AS start, 0.25 * x + 1.5 AS p, goal AS z FROM (SELECT r.*, m.seen FROM rows r JOIN marks m USING (chunk)) WHERE seen IS NULL OR (floor(epoch(ts))::BIGINT // 86400 + 1) * 86400000 > seen)
SELECT event_type, start, count(*) AS rows, CASE WHEN min(z) = max(z) THEN 1.0::DOUBLE ELSE round({STATES['r2'].format(p='p', w=1)}, 6) END AS loss, true AS ok FROM kept, last WHERE (start + 86400) * 1000 <= w GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["custom_operator"] = f"SELECT l_orderkey, l_linenumber, round((x + y) * (x + y), 6) AS yhat, round(2 * (x + y), 6) + 0.0 AS slope, true AS ok FROM {INPUTS}"
    out["losses_by_name"] = " UNION ALL ".join(f"SELECT '{n}' AS loss, round({e}, 6) AS value FROM {PREDICTIONS}" for n, e in SHOWN["losses"].items())
    out["unchecked_and_filled"] = f"SELECT count(*) FILTER (x > 0) AS ok, count(*) AS unchecked, count(*) FILTER (x <= 0) AS filled FROM {INPUTS}"
    out["csv_drop"] = "SELECT 'col_0,col_1' AS columns, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0"
    out["bootstrap_rows"] = "SELECT (2 * count(*) + 7)::BIGINT AS rows, count(*) AS keys, 0::BIGINT AS other, true AS even FROM orders"
    out["skyline_price"] = f"SELECT x AS l_extendedprice, l_orderkey, l_linenumber, -y AS quantity FROM ({skyline('l_extendedprice', '-l_quantity::DOUBLE')})"
    out["skyline_quantity"] = skyline("60 - l_quantity", "l_extendedprice")
    out["asof_orders"] = ASOF
    out["search_constants_linear"] = " UNION ALL ".join(line(n, e) for n, e in (("x", "x"), ("y", "y"), ("xy", "x * y")))
    out["state_losses"] = " UNION ALL ".join(f"SELECT '{n}' AS name, {w != '1'} AS weighted, l_returnflag, round({e.format(p='yhat', w=w)}, 6) AS loss, true AS ok FROM {PREDICTIONS} GROUP BY l_returnflag" for n, e in STATES.items() for w in ("1", "w"))
    formulas = ["x", "x * y", "x * y + x", None, "cos(x * y)"]
    out["score_states"] = " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS k, {f'round({e.format(p=f, w=1)}, 6)' if f else 'max(NULL::DOUBLE)'} AS loss, {bool(f)} AS ok FROM {INPUTS}" for n, e in STATES.items() for k, f in enumerate(formulas))
    out["search_resumed"] = listed("iterations, as_many, agree, evals", "3, true, true, true")
    out["stream_windows"] = WINDOWS
    out["stream_state_windows"] = STATE_WINDOWS
    out["shuffled_rows"] = "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS mixed FROM orders"
    out["hof_bulk_update"] = f"SELECT * FROM {HOF}"
    out["training_sample"] = listed("n, different, everywhere", "2000, 2000, true")
    events = ["step|error", "init|ready", "step|snapshot front_update", "start|snapshot front_update done", "evaluate|eval_result", "pause|paused", "reset|reset_done"]
    out["search_session"] = listed("n, request, events, holds", *(f"{k}, '{e.split('|')[0]}', '{e.split('|')[1]}', true" for k, e in enumerate(events)))
    return out
