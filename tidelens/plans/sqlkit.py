"""Helpers that spell out the DuckDB side of a check."""

from __future__ import annotations

EVENT_BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume
  FROM events GROUP BY 1, 2)"""

BRAND_BARS = """bars AS (
  SELECT p_brand AS symbol, l_shipdate AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

OVER = "OVER (PARTITION BY symbol ORDER BY ts{})"


def rows(n: int, end: str = "CURRENT ROW") -> str:
    return OVER.format(f" ROWS BETWEEN {n - 1} PRECEDING AND {end}")


def running() -> str:
    return OVER.format(" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


def R(agg: str, x: str, n: int) -> str:
    """Rolling aggregate with the full-frame guard."""
    return f"(CASE WHEN count({x}) {rows(n)} = {n} THEN {agg}({x}) {rows(n)} END)"


def R2(agg: str, x: str, y: str, n: int) -> str:
    both = f"count(CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN 1 END) {rows(n)} = {n}"
    return f"(CASE WHEN {both} THEN {agg}({x}, {y}) {rows(n)} END)"


def L(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) {OVER.format('')})"


def LEAD(x: str, k: int = 1) -> str:
    return f"(lead({x}, {k}) {OVER.format('')})"


def D(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def PCT(x: str, k: int = 1) -> str:
    return D(f"{x} - {L(x, k)}", L(x, k))


TR = f"greatest(high - low, abs(high - {L('close')}), abs(low - {L('close')}))"
TP = "((high + low + close) / 3.0)"


def ratio_index(up: str, down: str) -> str:
    return f"(CASE WHEN {down} = 0 AND {up} > 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {D(up, down)}) END)"


def over_bars(steps: list[dict], outs: dict, digits: int = 6, bars: str = EVENT_BARS, ints=(), tail: str = "",
              more: str = "", flags=()) -> str:
    """Bars, then one CTE per step of added columns, then the rounded outputs."""
    sql = [f"WITH RECURSIVE {bars}", "s0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"]
    prev = "s0"
    for i, step in enumerate(steps, 1):
        if isinstance(step, str):
            sql.append(step.replace("{prev}", prev).replace("{this}", f"s{i}"))
        else:
            sql.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM {prev})")
        prev = f"s{i}"
    cols = []
    for n, e in outs.items():
        if n in ints:
            cols.append(f"CAST({e} AS INTEGER) AS {n}")
        elif n in flags:
            cols.append(f"{e} AS {n}")
        else:
            cols.append(f"round({e} + 1e-9, {digits}) + 0.0 AS {n}")
    return ",\n".join(sql) + f"\nSELECT symbol, ts, {', '.join(cols)} FROM {prev} {tail}"


def recur(fields: dict) -> str:
    """A step that adds recurrences row by row: name -> (first value, later value).

    In the later value the previous row's fields are ``p.<name>`` and this row's ``t.``.
    """
    first = ", ".join(f"CAST({f} AS DOUBLE) AS {n}" for n, (f, _) in fields.items())
    later = ", ".join(f"CAST({x} AS DOUBLE)" for _, x in fields.values())
    names = ", ".join(f"r.{n}" for n in fields)
    return (
        "{this}r AS (SELECT symbol, rn, " + first + " FROM {prev} t WHERE rn = 1 UNION ALL SELECT t.symbol, t.rn, "
        + later + " FROM {this}r p JOIN {prev} t ON t.symbol = p.symbol AND t.rn = p.rn + 1),\n"
        "{this} AS (SELECT q.*, " + names + " FROM {prev} q JOIN {this}r r USING (symbol, rn))"
    )


def ema(x: str, span: float, name: str, start: int = 1, alpha: str | None = None) -> dict:
    """x refers to this row as ``t.``."""
    a = alpha or f"(2.0 / ({span} + 1))"
    first = x if start == 1 else "NULL"
    return {name: (first, f"CASE WHEN t.rn = {start} THEN {x} WHEN t.rn > {start} THEN {a} * {x} + (1 - {a}) * p.{name} END")}
