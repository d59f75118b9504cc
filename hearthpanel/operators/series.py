"""Many yearly or monthly series at once: AR(1) in differences, projections, learning.

A series is a set of rows (key, period, value) with consecutive integer periods. A period that is
missing breaks the differences around it, and nothing is learned from these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions.draws import normal
from hearthpanel.functions.finance import price_path
from hearthpanel.operators.keyed import attach, null_safe_join
from hearthpanel.operators.panel import earlier_values
from hearthpanel.operators.scan import running_states
from hearthpanel.workspace import materialize


def differences(df: DataFrame, keys: Sequence[str], order: str, value: str, *more: str) -> DataFrame:
    """Each value with its change ``y`` and the change before, ``x``, and ``more`` columns as they are."""
    looked = earlier_values(
        df.select(*keys, order, value, *more), keys, order, {"_lag1": (value, 1), "_lag2": (value, 2)}
    )
    return looked.select(
        *keys, order, value, *more, (F.col(value) - F.col("_lag1")).alias("y"), (F.col("_lag1") - F.col("_lag2")).alias("x")
    )


def ar1_fit(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Per series: intercept and slope of the change on the change before, sample standard
    deviation of the residuals, and the last value, change and period."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    # A series whose changes are all alike has no slope: the mean of the changes is all that fits.
    explained = F.coalesce(F.try_divide(F.pow(F.regr_sxy("y", "x"), F.lit(2)), F.regr_sxx("y", "x")), F.lit(0.0))
    flat = F.regr_sxx("y", "x") == 0
    rest = F.regr_syy("y", "x") - explained
    return (
        differences(df, keys, order, value)
        .groupBy(*keys)
        .agg(
            F.count(F.when(both, 1)).alias("n"),
            F.when(flat, F.regr_avgy("y", "x")).otherwise(F.regr_intercept("y", "x")).alias("intercept"),
            F.when(flat, 0.0).otherwise(F.regr_slope("y", "x")).alias("slope"),
            rest.alias("_rest"),
            F.max_by(value, order).alias("last"),
            F.max_by("y", order).alias("change"),
            F.max(order).alias("last_period"),
        )
        .withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.greatest("_rest", F.lit(0.0)) / (F.col("n") - 1))))
        .drop("_rest")
    )


def ar1_project(fits: DataFrame, horizon: int, name: str = "path") -> DataFrame:
    """The next ``horizon`` values of each fitted series as an array."""
    path = price_path(F.col("last"), F.col("change"), F.col("intercept"), F.col("slope"), horizon)
    return fits.withColumn(name, path)


def ar1_simulate(
    fits: DataFrame, keys: Sequence[str], horizon: int, seed: int, sd: str | Column = "sd", name: str = "path"
) -> DataFrame:
    """As ``ar1_project`` with a normal shock per step, drawn by series, step and seed."""
    spread = F.col(sd) if isinstance(sd, str) else sd
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])

    def step(state: Column, t: Column) -> Column:
        d = F.col("intercept") + F.col("slope") * state["d"] + spread * normal(F.concat_ws("|", key, t.cast("string")), seed)
        p = state["p"] + d
        return F.struct(p.alias("p"), d.alias("d"), F.concat(state["path"], F.array(p)).alias("path"))

    start = F.struct(
        F.col("last").cast("double").alias("p"),
        F.col("change").cast("double").alias("d"),
        F.array().cast("array<double>").alias("path"),
    )
    return fits.withColumn(
        name, F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["path"])
    )


def path_rows(df: DataFrame, ids: Sequence[str], path: str = "path", step: str = "step", value: str = "value") -> DataFrame:
    """Path arrays -> rows, the step counted from 1."""
    return df.select(*ids, F.posexplode(path).alias(step, value)).withColumn(step, F.col(step) + 1)


def observed_else_projected(
    observed: DataFrame, projected: DataFrame, keys: Sequence[str], order: str, value: str
) -> DataFrame:
    """The observed series, continued by the projection where nothing was observed."""
    marked = observed.select(*keys, order, F.col(value).alias("_seen"), F.lit(None).cast("double").alias("_guess")).unionByName(
        projected.select(*keys, order, F.lit(None).cast("double").alias("_seen"), F.col(value).alias("_guess"))
    )
    return marked.groupBy(*keys, order).agg(F.coalesce(F.max("_seen"), F.max("_guess")).alias(value))


def rls_states(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    gain: str,
    start: tuple[float, float],
    matrix: tuple[float, float, float, float],
) -> DataFrame:
    """What recursive least squares has learned after every period, one row per period that has a change
    and a change before: ``y``, ``x``, the gain, the matrix ``r11 r12 r21 r22`` and coefficients ``n1 n2``.

    The gain may vary from period to period. An update that would make the matrix singular, which from a
    positive definite start happens with gain 1 only, keeps the old matrix; the coefficients still learn.
    Periods without a step leave everything as it is. The matrix, and then the coefficients given the
    matrices, change by affine maps, so both are distributed scans (see ``scan``) over any length of series.
    """
    m11, m12, m21, m22 = _positive_definite(matrix)
    rows = differences(df.select(*keys, order, value, gain), keys, order, value, gain)
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(gain).isNotNull()).withColumn(
        gain, F.col(gain).cast("double")
    )
    rows = materialize(rows, "steps")
    g, x, y = F.col(gain), F.col("x"), F.col("y")
    moves = g != 1

    def affine(a: Column, *c: Column) -> Column:
        return F.struct(a.alias("a"), *[v.alias(f"c{i}") for i, v in enumerate(c)])

    def after(first: Column, second: Column) -> Column:
        return affine(second["a"] * first["a"], *[second["a"] * first[f"c{i}"] + second[f"c{i}"] for i in range(3)])

    def moved(m: Column, r: Column) -> Column:
        parts = (("r11", "c0"), ("r12", "c1"), ("r21", "c1"), ("r22", "c2"))
        return F.struct(*[(m["a"] * r[name] + m[c]).alias(name) for name, c in parts])

    step = affine(F.when(moves, 1 - g).otherwise(1.0), *[F.when(moves, g * v).otherwise(0.0) for v in (F.lit(1.0), x, x * x)])
    begin = F.struct(*[F.lit(v).alias(n) for n, v in (("r11", m11), ("r12", m12), ("r21", m21), ("r22", m22))])
    told = running_states(rows, keys, order, step, after, moved, begin, "_r")
    told = told.select(*rows.columns, "_r.*")
    r11, r12, r21, r22 = (F.col(n) for n in ("r11", "r12", "r21", "r22"))
    det = r11 * r22 - r12 * r21
    u, v = g * (r22 - r12 * x) / det, g * (r11 * x - r21) / det  # gain times inverse matrix times (1, x)

    def linear(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))

    def chained(p: Column, q: Column) -> Column:
        return linear(
            q["a"] * p["a"] + q["b"] * p["c"], q["a"] * p["b"] + q["b"] * p["d"],
            q["c"] * p["a"] + q["d"] * p["c"], q["c"] * p["b"] + q["d"] * p["d"],
            q["a"] * p["e"] + q["b"] * p["f"] + q["e"], q["c"] * p["e"] + q["d"] * p["f"] + q["f"],
        )

    def learned(m: Column, n: Column) -> Column:
        return F.struct(
            (m["a"] * n["n1"] + m["b"] * n["n2"] + m["e"]).alias("n1"), (m["c"] * n["n1"] + m["d"] * n["n2"] + m["f"]).alias("n2")
        )

    step = linear(1 - u, -u * x, -v, 1 - v * x, u * y, v * y)
    begin = F.struct(F.lit(float(start[0])).alias("n1"), F.lit(float(start[1])).alias("n2"))
    out = running_states(told, keys, order, step, chained, learned, begin, "_n")
    return out.select(*told.columns, "_n.*")


def _positive_definite(matrix: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    m11, m12, m21, m22 = (float(m) for m in matrix)
    if m11 <= 0 or 4 * m11 * m22 <= (m12 + m21) ** 2:
        raise ValueError("the starting matrix must be positive definite")
    return m11, m12, m21, m22


def rls_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    gain: str,
    start: tuple[float, float],
    matrix: tuple[float, float, float, float],
) -> DataFrame:
    """Recursive least squares of the change on a constant and the change before, per series: the largest
    gain, moment matrix ``r11 r12 r21 r22`` and coefficients ``n1 n2`` after the last period.

    With one gain g below 1 the recursion moves R to (1-g)R + g zz' and R*coef to (1-g)R*coef + g z y, so
    both are weighted sums by age in steps and no ordered pass is needed where no period is missing. All
    other series (a gain of 1, gains that vary, missing periods) are scanned as in ``rls_states``.
    """
    m11, m12, m21, m22 = _positive_definite(matrix)
    rows = differences(df.select(*keys, order, value, gain), keys, order, value, gain)
    rows = materialize(rows, "changes")
    step = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(gain).isNotNull()
    gains = rows.groupBy(*keys).agg(
        F.max(gain).cast("double").alias("_gain"),
        F.max(order).alias("_last"),
        F.count(F.lit(1)).alias("_obs"),
        F.max_by(value, order).alias("last"),
        F.max_by("y", order).alias("change"),
        F.count(F.when(step, 1)).alias("n"),
        (F.max(F.when(step, F.col(order))) - F.min(F.when(step, F.col(order))) + 1 - F.count(F.when(step, 1))).alias("_missing"),
        (F.min(gain) != F.max(gain)).alias("_varies"),
        F.max(F.when(step, F.col(order))).alias("_until"),
    )
    gains = materialize(gains.filter("n > 0").withColumn("_scan", F.expr("_gain = 1 or _varies or _missing > 0 or _until < _last")), "gains")
    found = _weighted(rows.filter(step), gains.filter("not _scan"), keys, order, gain, start, (m11, m12, m21, m22))
    if gains.filter("_scan").limit(1).count():
        scanned = gains.filter("_scan").select(*keys, F.col("_gain").alias("_most"), "_until", "last", "change", "_last", "n")
        chosen = null_safe_join(df.select(*keys, order, value, gain), scanned.select(*keys), keys, "left_semi")
        states = rls_states(chosen, keys, order, value, gain, start, matrix)
        ends = null_safe_join(states.drop("n"), scanned, keys, "inner").filter(F.col(order) == F.col("_until"))
        found = found.unionByName(
            ends.select(
                *keys, "n", F.col("_most").alias(gain), "last", "change", F.col("_last").alias("last_period"),
                "r11", "r12", "r21", "r22", "n1", "n2",
            )
        )
    return found


def _weighted(
    rows: DataFrame, gains: DataFrame, keys: Sequence[str], order: str, gain: str, start: tuple[float, float],
    matrix: tuple[float, float, float, float],
) -> DataFrame:
    """The learning of series with one gain below 1 and no missing period, as sums weighted by age."""
    m11, m12, m21, m22 = matrix
    aged = attach(rows.drop(gain), gains.drop("n"), keys, "_obs", written=True).filter("_gain is not null").withColumn(
        "_w", F.col("_gain") * F.pow(1 - F.col("_gain"), F.col("_last") - F.col(order))
    )
    weighted = lambda *parts: F.sum(_product("_w", *parts))
    sums = aged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_gain").alias(gain),
        F.pow(1 - F.max("_gain"), F.count(F.lit(1))).alias("_left"),
        weighted().alias("_s1"),
        weighted("x").alias("_sx"),
        weighted("x", "x").alias("_sxx"),
        weighted("y").alias("_sy"),
        weighted("x", "y").alias("_sxy"),
        F.max("last").alias("last"),
        F.max("change").alias("change"),
        F.max("_last").alias("last_period"),
    )
    left = F.col("_left")
    state = sums.withColumns(
        {
            "r11": left * m11 + F.col("_s1"),
            "r12": left * m12 + F.col("_sx"),
            "r21": left * m21 + F.col("_sx"),
            "r22": left * m22 + F.col("_sxx"),
            "_b1": left * (m11 * start[0] + m12 * start[1]) + F.col("_sy"),
            "_b2": left * (m21 * start[0] + m22 * start[1]) + F.col("_sxy"),
        }
    )
    det = F.col("r11") * F.col("r22") - F.col("r12") * F.col("r21")
    return state.select(
        *keys, "n", gain, "last", "change", "last_period", "r11", "r12", "r21", "r22",
        F.try_divide(F.col("r22") * F.col("_b1") - F.col("r12") * F.col("_b2"), det).alias("n1"),
        F.try_divide(F.col("r11") * F.col("_b2") - F.col("r21") * F.col("_b1"), det).alias("n2"),
    )


def _product(first: str, *rest: str) -> Column:
    out = F.col(first)
    for name in rest:
        out = out * F.col(name)
    return out


def expected_price_path(
    df: DataFrame, horizon: int, last: str = "last", change: str = "change", intercept: str = "n1", slope: str = "n2",
    name: str = "expected",
) -> DataFrame:
    """Expected prices of the next ``horizon`` periods from each row's own coefficients, an array."""
    return df.withColumn(name, price_path(F.col(last), F.col(change), F.col(intercept), F.col(slope), horizon))


