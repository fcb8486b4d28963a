"""Small text helpers for writing the DuckDB twins."""

from __future__ import annotations


def win(k: int | None = None, part: str = "series_id", order: str = "t", hi: str = "CURRENT ROW") -> str:
    lo = "UNBOUNDED PRECEDING" if k is None else f"{k - 1} PRECEDING"
    p = f"PARTITION BY {part} " if part else ""
    return f"({p}ORDER BY {order} ROWS BETWEEN {lo} AND {hi})"


def roll(stat: str, x: str, k: int, mp: int | None = None, part: str = "series_id",
         order: str = "t") -> str:
    """Guarded rolling aggregate: NULL when fewer than mp non-null values."""
    mp = k if mp is None else mp
    w = win(k, part, order)
    return f"CASE WHEN count({x}) OVER {w} >= {mp} THEN {stat}({x}) OVER {w} END"


def fin(e: str) -> str:
    """NaN / inf -> NULL."""
    return f"(CASE WHEN isnan({e}) OR isinf({e}) THEN NULL ELSE {e} END)"


def sdiv(a: str, b: str) -> str:
    return fin(f"(({a}) / nullif({b}, 0))")


def lag(x: str, n: int, part: str = "series_id", order: str = "t") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"lag({x}, {n}) OVER ({p}ORDER BY {order})"


def clip(e: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE least(greatest({e}, {lo}), {hi}) END)"


def ewm_ctes(src: str, x: str, alphas: dict[str, float], part: tuple[str, ...] = ("series_id",),
             order: str = "t", adjust: bool = False, name: str = "ewm") -> str:
    """CTE text (starting with a comma) computing pandas-style EWM means of
    ``x`` over ``src`` with a recursive CTE; the result CTE ``{name}`` holds
    every ``src`` column plus one column per alpha.  The statement must use
    ``WITH RECURSIVE``."""
    p = ", ".join(part)
    on = " AND ".join(f"s.{c} = r.{c}" for c in part)
    names = list(alphas)
    init, step, cols = [], [], []
    for i, n in enumerate(names):
        a = alphas[n]
        b = 1.0 - a
        if adjust:
            init += [f"CAST(coalesce({x}, 0.0) AS DOUBLE) AS n{i}",
                     f"CAST(CASE WHEN {x} IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS d{i}"]
            step += [f"r.n{i} * {b!r} + coalesce(s.{x}, 0.0)",
                     f"r.d{i} * {b!r} + CASE WHEN s.{x} IS NULL THEN 0.0 ELSE 1.0 END"]
            cols.append(f"CASE WHEN e.d{i} > 0 THEN e.n{i} / e.d{i} END AS {n}")
        else:
            init += [f"CAST({x} AS DOUBLE) AS m{i}", f"CASE WHEN {x} IS NULL THEN NULL ELSE _rn END AS l{i}"]
            w = f"power({b!r}, s._rn - r.l{i})"
            step += [f"CASE WHEN s.{x} IS NULL THEN r.m{i} WHEN r.m{i} IS NULL THEN s.{x} "
                     f"ELSE ({w} * r.m{i} + {a!r} * s.{x}) / ({w} + {a!r}) END",
                     f"CASE WHEN s.{x} IS NULL THEN r.l{i} ELSE s._rn END"]
            cols.append(f"e.m{i} AS {n}")
    state = ", ".join(f"{c}{i}" for i in range(len(names)) for c in (("n", "d") if adjust else ("m", "l")))
    return f""",
{name}_src AS (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY {order}) AS _rn FROM {src}),
{name}_rec({p}, _rn, {state}) AS (
  SELECT {p}, _rn, {', '.join(init)} FROM {name}_src WHERE _rn = 1
  UNION ALL
  SELECT {', '.join('s.' + c for c in part)}, s._rn, {', '.join(step)}
  FROM {name}_rec r JOIN {name}_src s ON {on} AND s._rn = r._rn + 1),
{name} AS (SELECT q.* EXCLUDE (_rn), {', '.join(cols)}
           FROM {name}_src q JOIN {name}_rec e USING ({p}, _rn))"""


def recursive(sql: str) -> str:
    s = sql.lstrip()
    assert s.startswith("WITH ")
    return "WITH RECURSIVE " + s[5:]


def log1p(x: str) -> str:
    """Accurate log(1 + x) for DuckDB, which has no log1p."""
    return (f"(CASE WHEN (1 + ({x})) - 1 = 0 THEN ({x}) "
            f"ELSE ln(1 + ({x})) * ({x}) / ((1 + ({x})) - 1) END)")
