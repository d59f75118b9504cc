"""Least squares in SQL: what the regression operators are held against."""

from __future__ import annotations

def ols_ctes(
    p: str, rows: str, y: str, terms: list[tuple[str, str]], home: str | None = None, level: str | None = None
) -> str:
    """CTEs named with prefix ``p``, the last being {p}coef(term, estimate, std_error).

    ``terms`` are names and expressions. With ``home`` everything is centred within its groups, with
    ``level`` the levels of that column but the first are further regressors. The cross-products, scaled
    to a unit diagonal and with the unit matrix beside them, are swept pivot by pivot; what earlier
    terms explain is skipped.
    """
    xs = [f"CAST({e} AS DOUBLE)" for _, e in terms]
    k0 = len(terms)
    names = "[" + ", ".join(f"'{n}'" for n, _ in terms) + "]"
    over = f"OVER (PARTITION BY {home})" if home else "OVER ()"
    centred = ", ".join(f"{x} - avg({x}) {over}" for x in xs)
    need = " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys([*[n for n, _ in terms if '^' not in n], y, *filter(None, [home, level])]))
    q = f"""{p}d AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM ({rows}) WHERE {need}),
    {p}lev AS (SELECT {f'list(DISTINCT {level} ORDER BY {level})[2:] AS lv FROM {p}d' if level else 'CAST([] AS INT[]) AS lv'}),
    {p}v AS (SELECT rid, list_concat([{centred}], {f'[CAST({level} = l AS INT) - len(list_filter(seen, lambda s: s = l)) / CAST(len(seen) AS DOUBLE) for l in lv]' if level else 'CAST([] AS DOUBLE[])'},
        [CAST({y} AS DOUBLE) - avg(CAST({y} AS DOUBLE)) {over}]) AS v FROM (SELECT *, {f'list({level}) {over}' if level else 'NULL'} AS seen FROM {p}d, {p}lev)),
    {p}x AS MATERIALIZED (SELECT rid, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM {p}v),
    {p}s AS MATERIALIZED (SELECT i, sqrt(sum(x * x)) AS s, max(i) OVER () - 1 AS size FROM {p}x GROUP BY i),
    {p}c AS MATERIALIZED (SELECT a.i, b.i AS j, coalesce(sum(a.x / nullif(sa.s, 0) * b.x / nullif(sb.s, 0)), 0) AS v FROM {p}x AS a JOIN {p}x AS b USING (rid)
        JOIN {p}s AS sa ON sa.i = a.i JOIN {p}s AS sb ON sb.i = b.i GROUP BY 1, 2),
    {p}m AS (SELECT list(list_concat(r, [CAST(i = j AS DOUBLE) for j in range(1, size + 1)]) ORDER BY i) AS m, any_value(size) AS size
        FROM (SELECT i, list(v ORDER BY j) AS r, any_value(size) AS size FROM {p}c JOIN (SELECT DISTINCT size FROM {p}s) ON i <= size AND j <= size GROUP BY i)),
    {p}g AS (SELECT CAST(1 AS BIGINT) AS k, m, size, CAST([] AS BIGINT[]) AS kept FROM {p}m UNION ALL
        SELECT k + 1, CASE WHEN m[k][k] > 1e-9 THEN [CASE WHEN i = k THEN [e / m[k][k] for e in m[k]]
            ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, 2 * size + 1)] END for i in range(1, size + 1)] ELSE m END,
        size, CASE WHEN m[k][k] > 1e-9 THEN list_append(kept, k) ELSE kept END FROM {p}g WHERE k <= size),
    {p}f AS (SELECT m, size, kept, (SELECT list(v ORDER BY i) FROM {p}c WHERE j = size + 1) AS b, (SELECT list(s ORDER BY i) FROM {p}s) AS s FROM {p}g WHERE k = size + 1),
    {p}e AS MATERIALIZED (SELECT *, [CASE WHEN list_contains(kept, i) THEN list_sum([m[i][size + j] * b[j] for j in kept]) ELSE 0 END for i in range(1, size + 1)] AS beta FROM {p}f),
    {p}w AS (SELECT *, CASE WHEN 1 - list_sum([beta[i] * b[i] for i in kept]) > 1e-10 THEN 1 - list_sum([beta[i] * b[i] for i in kept]) ELSE 0 END * s[size + 1] * s[size + 1]
        / ((SELECT count(*) FROM {p}d) - len(kept) - {f'(SELECT count(DISTINCT {home}) FROM {p}d)' if home else '1'}) AS variance FROM {p}e),
    {p}b AS MATERIALIZED (SELECT i, CASE WHEN i <= {k0} THEN {names}[i] END AS term, CASE WHEN i > {k0} THEN (SELECT lv FROM {p}lev)[i - {k0}] END AS lev,
        beta[i] * s[size + 1] / s[i] AS estimate, sqrt(variance * m[i][size + i]) / s[i] AS std_error FROM (SELECT *, unnest(kept) AS i FROM {p}w)),
    {p}coef AS (SELECT term, estimate, std_error FROM {p}b WHERE term IS NOT NULL"""
    if not home:
        means = ", ".join(f"avg({x})" for x in xs)
        q += f""" UNION ALL SELECT '(Intercept)', ym - list_sum([beta[i] * s[size + 1] / s[i] * a[i] for i in kept]),
        sqrt(variance * (1.0 / n + list_sum([list_sum([a[i] / s[i] * m[i][size + j] * a[j] / s[j] for j in kept]) for i in kept])))
        FROM {p}w, (SELECT [{means}] AS a, avg(CAST({y} AS DOUBLE)) AS ym, count(*) AS n FROM {p}d)"""
    return q + ")"


LINEAR = [("income", "income"), ("age", "age")]
EDUCATION = [("education", "education")]
SQUARED = [("income^2", "income * income"), ("age^2", "age * age")]


def coef_sql(rows: str, y: str, terms: list[tuple[str, str]], home: str | None = None, level: str | None = None) -> str:
    return f"WITH RECURSIVE {ols_ctes('z', rows, y, terms, home, level)} SELECT 1 AS spec, term, estimate, std_error FROM zcoef"


def job_sql(rows: str, y: str) -> str:
    """Estimates of the five specifications of the regression job and the fitted values of each row."""
    full = [*LINEAR, *EDUCATION, *SQUARED]
    specs = [(LINEAR, None, None), ([*LINEAR, *SQUARED], None, None), (full, None, None), (full, "year", None), (full, "hid", "year")]
    chains, estimates, fitted = [], [], []
    for n, (terms, home, level) in enumerate(specs, 1):
        p = f"m{n}_"
        chains.append(ols_ctes(p, rows, y, terms, home, level))
        estimates.append(f"SELECT 'estimate' AS kind, {n} AS spec, term, NULL AS hid, NULL AS year, estimate, NULL AS fitted FROM {p}coef")
        known = [*terms, *([] if home else [("(Intercept)", "1")])]
        parts = [f"coalesce((SELECT estimate FROM {p}coef WHERE term = '{t}'), 0) * ({e})" for t, e in known]
        if level:
            parts.append(f"coalesce((SELECT estimate FROM {p}b WHERE lev = d.{level}), 0)")
        effect = f" + avg(y - part) OVER (PARTITION BY {home})" if home else ""
        fitted.append(
            f"SELECT 'fitted', NULL, 'Model{n}', hid, year, NULL, part{effect} FROM "
            f"(SELECT hid, year, {y} AS y, {' + '.join(parts)} AS part FROM {p}d AS d)"
        )
    return f"WITH RECURSIVE {', '.join(chains)} " + " UNION ALL ".join([*estimates, *fitted])
