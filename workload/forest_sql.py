"""SQL that grows and walks the forests of the short series, level by level (DuckDB dialect).

Written from the rules of ``adlens.operators.forest``: draws and ties by the same generator, sums of
whole steps, the best cut by score, tie number, feature and threshold. Nodes are named by paths.
"""

from __future__ import annotations

from adlens.operators.forest import ADDEND, BITS, FACTOR, FEATURE, MODULUS, PLACE, ROUNDS, TREE
from adlens.schema import (
    FOREST_DEPTH, FOREST_SEED, FOREST_TREES, HOLIDAYS, HORIZON_DAYS, MEASURES, MIN_FOREST_ROWS,
)

_NODE = "sid, g, t, path"


def _scrambled(x: str) -> str:
    start = f"({x})::BIGINT % {MODULUS}"
    return (f"list_reduce([{start}{', 0::BIGINT' * ROUNDS}], "
            f"lambda a, b: (a * a % {MODULUS} * {FACTOR} + {ADDEND}) % {MODULUS})")


def _inputs(date: str) -> str:
    flag = f"month({date}) * 100 + day({date}) IN ({', '.join(map(str, HOLIDAYS))})"
    return (f"[719163 + date_diff('day', DATE '1970-01-01', {date}), isodow({date}) - 1, day({date}), "
            f"month({date}), ({flag})::INTEGER]::DOUBLE[]")


def _level(level: int) -> list[str]:
    """Sums of the nodes of a level, their cuts, the best of them, and the rows of the next level."""
    same = " AND ".join(f"e.{c} = o.{c}" for c in _NODE.split(", "))
    rows = f"f_e{level}"
    parts = [f"""f_n{level} AS MATERIALIZED (SELECT {_NODE}, sum(w) AS w, sum(w * q) AS s,
  min(q) AS lowest, max(q) AS highest FROM {rows} GROUP BY ALL)"""]
    if level == FOREST_DEPTH:
        return parts
    tie = _scrambled(f"t * {TREE} + path * {PLACE} + f * {FEATURE}::BIGINT + {FOREST_SEED}")
    parts.append(f"""f_v{level} AS (SELECT e.sid, e.g, e.t, e.path, f, x[f + 1] AS v, sum(e.w) AS w,
  sum(e.w * e.q) AS s FROM {rows} e JOIN f_n{level} o ON {same}, (SELECT unnest(range(5)) AS f)
  WHERE o.highest > o.lowest GROUP BY ALL)""")
    parts.append(f"""f_c{level} AS (SELECT *, lead(v) OVER k AS nv, sum(w) OVER k AS lw, sum(s) OVER k AS ls,
  sum(w) OVER u AS tw, sum(s) OVER u AS ts FROM f_v{level}
  WINDOW k AS (PARTITION BY {_NODE}, f ORDER BY v ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY {_NODE}, f))""")
    parts.append(f"""f_b{level} AS MATERIALIZED (SELECT {_NODE}, f, (v + nv) / 2.0::DOUBLE AS threshold
  FROM (SELECT *, ls::DOUBLE * ls::DOUBLE / lw::DOUBLE
    + (ts - ls)::DOUBLE * (ts - ls)::DOUBLE / (tw - lw)::DOUBLE AS score FROM f_c{level} WHERE nv IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY {_NODE} ORDER BY score DESC, {tie} DESC, f, v) = 1)""")
    parts.append(f"""f_e{level + 1} AS MATERIALIZED (SELECT e.sid, e.g, e.t,
  2 * e.path + (x[f + 1] > threshold)::INTEGER AS path, x, e.w, e.q
  FROM {rows} e JOIN f_b{level} o ON {same})""")
    parts.append(f"""f_p{level + 1} AS (SELECT e.sid, e.g, e.t, d, x,
  CASE WHEN o.f IS NULL THEN e.path ELSE 2 * e.path + (x[o.f + 1] > o.threshold)::INTEGER END AS path
  FROM f_p{level} e LEFT JOIN f_b{level} o ON {same})""")
    return parts


def forest_stats(series: str) -> str:
    """CTEs that end in ``f_stats``: mean and spread of the trees per channel, date and target.

    ``series`` has the facts and, as n and back, the rows of each channel and their place from the end.
    """
    values = ", ".join(f"""{{'g': {g}, 'y': "{c}"}}""" for g, c in enumerate(MEASURES))
    nodes = " UNION ALL ".join(f"SELECT {_NODE}, w, s FROM f_n{i}" for i in range(FOREST_DEPTH + 1))
    levels = [part for level in range(FOREST_DEPTH + 1) for part in _level(level)]
    moments = ", ".join(
        f'{how}(value) FILTER (p.g = {g}) AS "{c}_{what}"'
        for g, c in enumerate(MEASURES) for how, what in (("avg", "mean"), ("stddev_pop", "std"))
    )
    return ",\n".join([
        f"""f_sid AS MATERIALIZED (SELECT campaign_id, "Channel", n, "Date" AS last,
  row_number() OVER (ORDER BY campaign_id, "Channel") AS sid
  FROM {series} WHERE back = 1 AND n >= {MIN_FOREST_ROWS})""",
        f"""f_known AS MATERIALIZED (SELECT i.sid, r.n, r.n - r.back AS i, {_inputs('r."Date"')} AS x,
  unnest([{values}], recursive := true) FROM {series} r
  JOIN f_sid i ON i.campaign_id = r.campaign_id AND i."Channel" = r."Channel")""",
        f"""f_scale AS MATERIALIZED (SELECT sid, g, min(y) AS low, CASE WHEN max(y) - min(y) > 0
  THEN pow(2.0::DOUBLE, {BITS - 1} - floor(log2(max(y) - min(y)))) ELSE 1.0::DOUBLE END AS per_unit
  FROM f_known GROUP BY ALL)""",
        f"""f_draws AS MATERIALIZED (SELECT n, t, {_scrambled(f't * {TREE} + j * {PLACE} + {FOREST_SEED}')} % n AS i,
  count(*) AS w FROM (SELECT n, t, unnest(range(n)) AS j
    FROM (SELECT DISTINCT n FROM f_sid), (SELECT unnest(range({FOREST_TREES})) AS t)) GROUP BY ALL)""",
        """f_e0 AS MATERIALIZED (SELECT k.sid, k.g, d.t, 1 AS path, k.x, d.w,
  round_even((k.y - c.low) * c.per_unit, 0)::BIGINT AS q
  FROM f_known k JOIN f_scale c ON c.sid = k.sid AND c.g = k.g JOIN f_draws d ON d.n = k.n AND d.i = k.i)""",
        f"""f_p0 AS (SELECT sid, g, t, d, {_inputs('d')} AS x, 1 AS path
  FROM (SELECT sid, CAST(last + CAST(ahead AS INTEGER) AS DATE) AS d
    FROM f_sid, range(1, {HORIZON_DAYS + 1}) AS days(ahead)),
    (SELECT unnest(range({len(MEASURES)})) AS g), (SELECT unnest(range({FOREST_TREES})) AS t))""",
        *levels,
        f"""f_all AS (SELECT o.*, c.low + o.s::DOUBLE / o.w::DOUBLE / c.per_unit AS value
  FROM ({nodes}) o JOIN f_scale c ON c.sid = o.sid AND c.g = o.g)""",
        f"""f_stats AS (SELECT i.campaign_id, i."Channel", p.d AS "Date", {moments}
  FROM f_p{FOREST_DEPTH} p JOIN f_all o ON o.sid = p.sid AND o.g = p.g AND o.t = p.t AND o.path = p.path
  JOIN f_sid i ON i.sid = p.sid GROUP BY ALL)""",
    ])


def forest_forecast(z: str) -> str:
    """CTE ``f_rows``, the forecast rows of ``f_stats`` with bands of ``z`` deviations."""
    floor = "greatest({}, 0.0::DOUBLE)"
    means = {c: floor.format(f'"{c}_mean"') for c in MEASURES}
    bands = ", ".join(
        floor.format(f'"{c}_mean" {sign} {z}::DOUBLE * "{c}_std"') + f' AS "{c}_{side}"'
        for c in ("Revenue", "Conversions") for side, sign in (("Lower", "-"), ("Upper", "+"))
    )
    points = ", ".join(f'{x} AS "{c}"' for c, x in means.items())
    roas = f"CASE WHEN {means['Spend']} > 0 THEN {means['Revenue']} / {means['Spend']} ELSE 0.0::DOUBLE END"
    return f"""f_rows AS (SELECT campaign_id, "Channel", "Date", {points}, {roas} AS "ROAS", {bands},
  true AS "IsForecast" FROM f_stats)"""
