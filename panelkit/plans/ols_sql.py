"""SQL counterparts of fixed-effects least squares: cross products in long form and a sweep, one step a column."""

from __future__ import annotations

from .domain import FIRST, LAST


def fe_sql(rows: str, x: list[str], prefix: str = "f", twoway: bool = False) -> str:
    """CTEs that fit y on x with entity and time effects, once for each grp, from the CTE rows (grp, id, year, y, x...).

    They end with <prefix>_b (grp, i, beta; i counts x from 1), <prefix>_v (grp, i, j, v: covariance clustered by
    entity or, with twoway, by entity and period), <prefix>_t (grp, year, effect) and <prefix>_n (grp, nobs, n_entities). Columns that the effects or earlier
    ones absorb have no row in _b. Time dummies come first, as in the operator.
    """
    years = list(range(FIRST + 1, LAST + 1))
    cols = [f"CAST(year = {t} AS DOUBLE)" for t in years] + [f"CAST({c} AS DOUBLE)" for c in x] + ["y"]
    n, t, p = len(cols), len(years), prefix

    def by(cluster: str, sign: int) -> str:
        sums = f"(SELECT grp, {cluster}, i, sum(u) AS u FROM {p}_u GROUP BY ALL)"
        return f"SELECT a.grp, a.i, b.i AS j, {sign} * sum(a.u * b.u) AS v FROM {sums} a JOIN {sums} b USING (grp, {cluster}) GROUP BY ALL"

    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY grp, id)" for c in cols)
    out = [
        f"{p}_z AS MATERIALIZED (SELECT grp, id, year, unnest(range(1, {n + 1})) AS i, unnest([{centred}]) AS v FROM {rows})",
        f"{p}_0 AS MATERIALIZED (SELECT a.grp, a.i, b.i AS j, sum(a.v * b.v) AS v FROM {p}_z a JOIN {p}_z b ON a.grp = b.grp AND a.id = b.id AND a.year = b.year GROUP BY ALL)",
    ]
    for k in range(1, n):
        m = f"{p}_{k - 1}"
        out.append(
            f"{p}_{k} AS MATERIALIZED (SELECT a.grp, a.i, a.j, CASE WHEN d.v <= 1e-9 * o.v THEN a.v WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v "
            f"FROM {m} a JOIN {m} r ON r.grp = a.grp AND r.i = a.i AND r.j = {k} JOIN {m} c ON c.grp = a.grp AND c.i = {k} AND c.j = a.j JOIN {m} d ON d.grp = a.grp AND d.i = {k} AND d.j = {k} JOIN {p}_0 o ON o.grp = a.grp AND o.i = {k} AND o.j = {k})"
        )
    m = f"{p}_{n - 1}"
    out += [
        # a swept column holds at most -1 / its own square; the pivot of one that was left out is 0 but for rounding, of either sign
        f"{p}_k AS MATERIALIZED (SELECT a.grp, a.i, b.v AS beta FROM {m} a JOIN {m} b ON b.grp = a.grp AND b.i = a.i AND b.j = {n} JOIN {p}_0 o ON o.grp = a.grp AND o.i = a.i AND o.j = a.i WHERE a.i = a.j AND a.i < {n} AND a.v * o.v < -0.5)",
        f"{p}_e AS MATERIALIZED (SELECT z.grp, z.id, z.year, sum(CASE WHEN z.i = {n} THEN z.v ELSE -z.v * coalesce(beta, 0) END) AS e FROM {p}_z z LEFT JOIN {p}_k USING (grp, i) GROUP BY ALL)",
        f"{p}_s AS MATERIALIZED (SELECT z.grp, z.id, {'z.year' if twoway else '0 AS year'}, z.i, sum(z.v * e) AS s FROM {p}_z z JOIN {p}_k USING (grp, i) JOIN {p}_e USING (grp, id, year) GROUP BY ALL)",
        f"{p}_u AS MATERIALIZED (SELECT s.grp, s.id, s.year, m.i - {t} AS i, sum(-m.v * s.s) AS u FROM {p}_s s JOIN {m} m ON m.grp = s.grp AND m.j = s.i JOIN {p}_k k ON k.grp = m.grp AND k.i = m.i WHERE m.i > {t} GROUP BY ALL)",
        f"{p}_v AS MATERIALIZED (SELECT grp, i, j, sum(v) AS v FROM ({' UNION ALL '.join(by(*c) for c in ((('id', 1), ('year', 1), ('id, year', -1)) if twoway else (('id', 1),)))}) GROUP BY ALL)",
        f"{p}_b AS (SELECT grp, i - {t} AS i, beta FROM {p}_k WHERE i > {t})",
        f"{p}_t AS (SELECT g.grp, y.year, coalesce(beta, 0) AS effect FROM (SELECT DISTINCT grp FROM {rows}) g CROSS JOIN (SELECT unnest(range({FIRST}, {LAST + 1})) AS year) y LEFT JOIN {p}_k k ON k.grp = g.grp AND k.i = y.year - {FIRST})",
        f"{p}_n AS (SELECT grp, count(*) AS nobs, count(DISTINCT id) AS n_entities FROM {rows} GROUP BY 1)",
    ]
    return ",\n".join(out)


def coefficients(prefix: str, names: list[str], places: int = 6) -> str:
    """A SELECT of grp, term, coef and se (rounded), nobs, n_entities and whether p is below 0.05."""
    names_sql = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"SELECT b.grp, {names_sql}[CAST(b.i AS INT)] AS term, round(beta, {places}) + 0.0 AS coef, round(sqrt(v), {places}) AS se, nobs, n_entities, abs(beta) > 1.9599639845400536 * sqrt(v) AS significant FROM {prefix}_b b JOIN {prefix}_v v ON v.grp = b.grp AND v.i = b.i AND v.j = b.i JOIN {prefix}_n n ON n.grp = b.grp"


def logit_sql(rows: str, x: list[str], prefix: str = "q", steps: int = 9) -> str:
    """CTEs that fit the balanced logistic regression of t on x with a unit ridge (none on the constant), from the CTE rows (id, t, x...).

    Newton steps from zero, unrolled: cross products in long form, solved by a sweep, one CTE a column. They end with
    <prefix>_score (id, pscore). x: SQL of each regressor as a row has it.
    """
    n, p = len(x), prefix
    out = [
        f"{p}_w AS (SELECT count(*) / (2.0 * sum(t)) AS w1, count(*) / (2.0 * sum(1 - t)) AS w0 FROM {rows})",
        f"{p}_z AS MATERIALIZED (SELECT id, t, CASE WHEN t = 1 THEN w1 ELSE w0 END AS w, unnest(range(0, {n + 1})) AS i, unnest([{', '.join(['1.0', *(f'CAST({c} AS DOUBLE)' for c in x)])}]) AS v FROM {rows}, {p}_w)",
        f"{p}_b0 AS (SELECT unnest(range(0, {n + 1})) AS i, 0.0::DOUBLE AS b)",
    ]
    for s in range(steps):
        m = f"{p}_m{s}"
        out += [
            f"{p}_p{s} AS MATERIALIZED (SELECT id, 1 / (1 + exp(-sum(v * b))) AS p FROM {p}_z JOIN {p}_b{s} USING (i) GROUP BY 1)",
            f"{m}_0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.w * p * (1 - p) * a.v * b.v) + CAST(a.i = b.i AND a.i > 0 AS INT) AS v FROM {p}_z a JOIN {p}_z b USING (id) JOIN {p}_p{s} USING (id) GROUP BY 1, 2 "
            f"UNION ALL SELECT z.i, {n + 1}, sum(w * (t - p) * v) - CASE WHEN z.i > 0 THEN any_value(b) ELSE 0 END FROM {p}_z z JOIN {p}_p{s} USING (id) JOIN {p}_b{s} k ON k.i = z.i GROUP BY 1)",
        ]
        out += [
            f"{m}_{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v FROM {m}_{k} a JOIN {m}_{k} r ON r.i = a.i AND r.j = {k} JOIN {m}_{k} c ON c.i = {k} AND c.j = a.j JOIN {m}_{k} d ON d.i = {k} AND d.j = {k})"
            for k in range(n + 1)
        ]
        out.append(f"{p}_b{s + 1} AS MATERIALIZED (SELECT i, b + v AS b FROM {p}_b{s} JOIN (SELECT i, v FROM {m}_{n + 1} WHERE j = {n + 1}) USING (i))")
    out.append(f"{p}_score AS MATERIALIZED (SELECT id, 1 / (1 + exp(-sum(v * b))) AS pscore FROM {p}_z JOIN {p}_b{steps} USING (i) GROUP BY 1)")
    return ",\n".join(out)
