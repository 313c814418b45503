"""SQL text of what DuckDB has no function for: tail probabilities by Simpson's rule, and least squares by elimination. Used by the SQL twins only."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 4000  # of Simpson's rule


def _simpson(f: str, low: str, high: str) -> str:
    """The integral of ``f`` (of ``s``) between two expressions."""
    width = f"(({high}) - ({low}))"
    weight = f"CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = f.replace("{s}", f"(({low}) + i * {width} / {STEPS})")
    return f"({width} / {3 * STEPS}.0::DOUBLE * list_sum(list_transform(range({STEPS} + 1), lambda i: ({weight}) * ({inner}))))"


def t_two_sided(t: str, df: str) -> str:
    front = f"exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi())"
    body = _simpson(f"power(1 + {{s}} * {{s}} / ({df}), -(({df}) + 1) / 2.0::DOUBLE)", "0", f"least(abs({t}), 60)")
    return f"greatest(1 - 2 * {front} * {body}, 0)"


def chi2_upper(x: str, df: str) -> str:
    """With s² for the variable, so that one degree of freedom is smooth too."""
    power = f"CASE WHEN {{s}} <= 0 THEN CASE WHEN ({df}) = 1 THEN 1 ELSE 0 END ELSE exp((({df}) - 1) * ln({{s}}) - {{s}} * {{s}} / 2 - lgamma(({df}) / 2.0::DOUBLE) - (({df}) / 2.0::DOUBLE - 1) * ln(2)) END"
    start = f"CASE WHEN ({df}) = 1 THEN exp(-lgamma(0.5::DOUBLE) + 0.5 * ln(2)) ELSE 0 END"
    power = power.replace(f"CASE WHEN ({df}) = 1 THEN 1 ELSE 0 END", start, 1)
    return f"greatest(1 - {_simpson(power, '0', f'least(sqrt({x}), sqrt({df}) + 40)')}, 0)"


def f_upper(f: str, d1: str, d2: str) -> str:
    """The beta tail with sqrt(1 - x) for the variable, which is smooth for one degree of freedom."""
    front = f"2 * exp(lgamma((({d1}) + ({d2})) / 2.0::DOUBLE) - lgamma(({d1}) / 2.0::DOUBLE) - lgamma(({d2}) / 2.0::DOUBLE))"
    body = f"power(greatest(1 - {{s}} * {{s}}, 0), ({d2}) / 2.0::DOUBLE - 1) * power({{s}}, ({d1}) - 1)"
    low = f"sqrt(({d1}) * greatest({f}, 0) / (({d2}) + ({d1}) * greatest({f}, 0)))"
    return f"least(greatest({front} * {_simpson(body, low, '1')}, 0), 1)"


def ks_upper(d: str, n1: str, n2: str) -> str:
    lam = f"(({d}) * sqrt(({n1})::DOUBLE * ({n2}) / (({n1}) + ({n2}))))"
    return f"CASE WHEN {lam} < 0.001 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * {lam} * {lam}))), 0), 1) END"


def covariances(src: str, by: str, columns: Sequence[str], where: str = "true") -> str:
    """Query for (g, n, a, b, v): population covariances of all pairs of columns per group."""
    cells = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'v': covar_pop({a}, {b})}}" for a in columns for b in columns)
    return f"SELECT g, n, c.a, c.b, c.v FROM (SELECT g, n, unnest(cs) AS c FROM (SELECT {by} AS g, count(*)::DOUBLE AS n, [{cells}] AS cs FROM {src} WHERE {where} GROUP BY {by}))"


def least_squares(families: Sequence[tuple[str, str, Sequence[str]]]) -> str:
    """CTEs over ``cov``: for every family (name, y, xs) ``fit`` has (g, fam, n, x, coef, inverse diagonal) and ``rss`` the residual sum of squares.

    Gauss-Jordan elimination of [Sxx | Sxy | I], one pivot a round, all groups and families at once. Needs WITH RECURSIVE.
    """
    pos = ", ".join(f"('{name}', {i}, '{x}')" for name, _, xs in families for i, x in enumerate(xs, 1))
    targets = ", ".join(f"('{name}', '{y}', {len(xs)})" for name, y, xs in families)
    return f"""pos(fam, i, x) AS (VALUES {pos}), target(fam, y, size) AS (VALUES {targets}),
    elim AS (SELECT g, fam, 0 AS k, size, i, j, v FROM (
        SELECT c.g, p.fam, p.i, q.i AS j, c.v FROM pos p JOIN pos q ON p.fam = q.fam JOIN cov c ON c.a = p.x AND c.b = q.x
        UNION ALL SELECT c.g, p.fam, p.i, 1000, c.v FROM pos p JOIN target t ON t.fam = p.fam JOIN cov c ON c.a = p.x AND c.b = t.y
        UNION ALL SELECT gs.g, p.fam, p.i, 1000 + q.i, CASE WHEN p.i = q.i THEN 1.0::DOUBLE ELSE 0 END FROM pos p JOIN pos q ON p.fam = q.fam, (SELECT DISTINCT g FROM cov) gs) JOIN target USING (fam)
      UNION ALL SELECT a.g, a.fam, a.k + 1, a.size, a.i, a.j, CASE WHEN a.i = a.k + 1 THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END
        FROM elim a JOIN elim p ON p.g = a.g AND p.fam = a.fam AND p.i = a.k + 1 AND p.j = a.k + 1 JOIN elim r ON r.g = a.g AND r.fam = a.fam AND r.i = a.k + 1 AND r.j = a.j
        JOIN elim c ON c.g = a.g AND c.fam = a.fam AND c.i = a.i AND c.j = a.k + 1 WHERE a.k < a.size),
    ns AS (SELECT DISTINCT g, n FROM cov),
    fit AS (SELECT e.g, e.fam, ns.n, o.x, e.v AS coef, d.v AS inv FROM elim e JOIN elim d ON d.g = e.g AND d.fam = e.fam AND d.k = e.k AND d.i = e.i AND d.j = 1000 + e.i JOIN pos o ON o.fam = e.fam AND o.i = e.i JOIN ns ON ns.g = e.g WHERE e.k = e.size AND e.j = 1000),
    rss AS (SELECT f.g, f.fam, f.n, f.n * (any_value(s.v) - sum(f.coef * c.v)) AS rss, any_value(s.v) AS syy, count(*) AS size FROM fit f JOIN target t ON t.fam = f.fam JOIN cov c ON c.g = f.g AND c.a = f.x AND c.b = t.y JOIN cov s ON s.g = f.g AND s.a = t.y AND s.b = t.y GROUP BY 1, 2, 3)"""
