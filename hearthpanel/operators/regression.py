"""Linear regression from one aggregation row.

Spark adds up the columns and their products exactly, in any order of rows (see ``exact``); only the
k x k system is solved on the driver. Absorbed effects are taken off first: one effect by the means of its
groups, two by solving for the effects of one of them on a table of the pairs of levels that occur.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from itertools import combinations_with_replacement
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hearthpanel.operators import exact
from hearthpanel.operators.keyed import attach
from hearthpanel.operators.reshape import stack_with_id
from hearthpanel.workspace import materialize

INTERCEPT = "(Intercept)"
# Levels up to which the effects come from one dense system on the driver.
DENSE_LEVELS = 200
TOLERANCE, MOST_STEPS = 1e-13, 500


@dataclass(frozen=True)
class Fit:
    """Estimates of one specification. ``dropped`` lists collinear regressors; ``effects`` is a table of the
    first of two absorbed columns' effects."""

    y: str
    coef: dict[str, float]
    se: dict[str, float]
    n: int
    squares: tuple[str, ...] = ()
    fe: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    effects: DataFrame | None = None


def _with_squares(df: DataFrame, squares: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}^2": F.col(c).cast("double") * F.col(c) for c in squares})


def _term(name: str) -> Column:
    return F.col(f"`{name}`")


def _solve(names: Sequence[str], cross: np.ndarray, dof_used: int, n: int):
    """Coefficients, standard errors and dropped names from the centred cross-products of
    [regressors..., y]. A regressor explained by earlier ones is dropped."""
    k = len(names)
    xx, xy, yy = cross[:k, :k], cross[:k, k], cross[k, k]
    kept: list[int] = []
    for j in range(k):
        rest = xx[j, j]
        if kept:
            part = xx[np.ix_(kept, [j])]
            rest = rest - float((part.T @ np.linalg.solve(xx[np.ix_(kept, kept)], part))[0, 0])
        if xx[j, j] > 0 and rest > 1e-9 * xx[j, j]:
            kept.append(j)
    scale = np.sqrt(np.diag(xx)[kept])
    inverse = np.linalg.inv(xx[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ xy[kept]
    residual = float(yy - beta @ xy[kept])
    if residual <= 1e-10 * yy:  # an exact fit; what is left are rounding errors
        residual = 0.0
    dof = n - len(kept) - dof_used
    variance = residual / dof if dof > 0 else float("nan")
    coef = {names[j]: float(b) for j, b in zip(kept, beta)}
    se = {names[j]: float(np.sqrt(variance * inverse[i, i])) for i, j in enumerate(kept)}
    return coef, se, tuple(n for j, n in enumerate(names) if j not in kept), inverse, kept, variance


def _exact_cross(df: DataFrame, cols: Sequence[str], tops: Mapping[str, int]) -> tuple[list[Fraction], dict[tuple[int, int], Fraction]]:
    """Exact sums of the columns and of their products, in one pass."""
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    sums = [c for i, col in enumerate(cols) for c in exact.sum_columns(f"s{i}", _term(col), tops[col])]
    products = [
        c for i, j in pairs for c in exact.sum_columns(f"q{i}_{j}", _term(cols[i]) * _term(cols[j]), tops[cols[i]] + tops[cols[j]])
    ]
    row = df.agg(*sums, *products).first().asDict()
    return (
        [exact.total(row, f"s{i}", tops[c]) for i, c in enumerate(cols)],
        {(i, j): exact.total(row, f"q{i}_{j}", tops[cols[i]] + tops[cols[j]]) for i, j in pairs},
    )


def ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    squares: Sequence[str] = (),
    fe: str | Sequence[str] | None = None,
    cluster: str | None = None,
) -> Fit:
    """Least squares of ``y`` on ``xs`` and the squares of ``squares``; rows with a null are left out.

    With ``fe`` the effects of that column, or of two columns, are absorbed: everything is demeaned first.
    Standard errors assume independent errors of equal variance; with ``cluster`` they allow any
    dependence within its groups (sandwich of the summed scores of each group, times
    G / (G - 1) * (n - 1) / (n - K), where effects nested in the groups do not count in K).
    All sums are exact (see ``exact``), so the result does not depend on how rows are partitioned.
    """
    effects = [fe] if isinstance(fe, str) else list(fe or ())
    if len(effects) > 2:
        raise ValueError("at most two effects can be absorbed")
    names = [*xs, *[f"{c}^2" for c in squares]]
    cols = [f"_x{i}" for i in range(len(names) + 1)]
    keys = list(dict.fromkeys([*effects, *([cluster] if cluster else [])]))
    data = _with_squares(df, squares).dropna(subset=[*xs, y, *keys])
    data = data.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[_term(c).cast("double").alias(n) for c, n in zip([*names, y], cols)]
    )
    if keys:
        data = materialize(data, "regression")
    n, box = exact.extremes(data, cols)
    if not n:
        raise ValueError("no complete rows to fit")
    # Around the middle of the range, which centring takes off anyway, products keep their digits.
    middle = [box[c][0] / 2 + box[c][1] / 2 for c in cols]
    data = data.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(cols, middle)})
    half = {c: (box[c][0] - m, box[c][1] - m) for c, m in zip(cols, middle)}
    tops = exact.tops(half)
    levels, used = None, 1
    if effects:
        demeaned = _within if len(effects) == 1 else _within_both
        # What is left may be larger than what was there; exact sums have room for that.
        data, used, levels = demeaned(data, [f"_k{keys.index(e)}" for e in effects], cols, tops, n)
    sums, products = _exact_cross(data, cols, tops)
    cross = np.zeros((len(cols), len(cols)))
    for (i, j), q in products.items():
        cross[i, j] = cross[j, i] = float(q - sums[i] * sums[j] / n)
    coef, se, dropped, inverse, kept, variance = _solve(names, cross, used, n)
    mean = np.array([middle[i] + float(sums[i] / n) for i in range(len(cols))])
    if not effects:
        at = mean[kept]
        coef = {INTERCEPT: float(mean[-1] - sum(coef[names[j]] * mean[j] for j in kept)), **coef}
        se = {INTERCEPT: float(np.sqrt(variance * (1 / n + at @ inverse @ at))), **se}
    if cluster:
        group = f"_k{keys.index(cluster)}"
        nested = _nested(data, [f"_k{keys.index(e)}" for e in effects], group)
        centre = [float(s / n) for s in sums]
        se = _clustered(data, group, cols, centre, tops, names, kept, coef, inverse, n, used - nested, mean if not effects else None)
    table = None
    if levels is not None:
        value = F.col(cols[-1])
        for j in kept:
            value = value - F.lit(coef[names[j]]) * F.col(cols[j])
        table = materialize(levels.select(F.col("_level").alias(effects[0]), value.alias("_effect1"), F.col("_rows")), "effects")
    return Fit(y, coef, se, n, tuple(squares), tuple(effects), dropped, table)


def _within(
    data: DataFrame, effects: list[str], cols: list[str], tops: Mapping[str, int], n: int
) -> tuple[DataFrame, int, None]:
    """Rows without the means of their group."""
    sums = materialize(exact.group_sums(data, effects, {f"_m{c}": (F.col(c), tops[c]) for c in cols}, "_n"), "sums")
    rows = attach(data, sums, effects, "_n", written=True)
    rows = rows.withColumns({c: F.col(c) - F.col(f"_m{c}") / F.col("_n") for c in cols})
    rows = materialize(rows.drop("_n", *[f"_m{c}" for c in cols]), "within")
    return rows, sums.count(), None


def _within_both(
    data: DataFrame, effects: list[str], cols: list[str], tops: Mapping[str, int], n: int
) -> tuple[DataFrame, int, DataFrame]:
    """Rows without the effects of both columns, the number of effects, and the effects of the first column.

    Every column is regressed on both sets of effects. Those of the second column follow from the first
    (they are means of what is left), so only the first column's are solved for, on one row per pair of
    levels that occurs: directly where the first column has few levels, else by conjugate gradients.
    """
    one, two = effects
    cells = exact.group_sums(data, [one, two], {f"_s{c}": (F.col(c), tops[c]) for c in cols}, "_n")
    cells = materialize(cells.withColumnsRenamed({one: "_level", two: "_home"}), "cells")
    solve = _effects_direct if cells.select("_level").distinct().count() <= DENSE_LEVELS else _effects_iterated
    # A sum of a group is below its rows times the largest value.
    levels, rank = solve(cells, cols, {c: t + int(n).bit_length() for c, t in tops.items()}, n)
    levels = materialize(levels, "levels")
    named = levels.select(F.col("_level").alias(one), *[F.col(c).alias(f"_a{c}") for c in cols], "_rows")
    rows = attach(data, named, [one], "_rows", written=True).drop("_rows")
    rows = rows.withColumns({c: F.col(c) - F.col(f"_a{c}") for c in cols}).drop(*[f"_a{c}" for c in cols])
    rows, homes, _ = _within(materialize(rows, "once"), [two], cols, tops, n)
    return rows, homes + rank, levels


def _home_sums(cells: DataFrame, cols: list[str], tops: Mapping[str, int]) -> DataFrame:
    """Rows and sums per home."""
    homes = cells.groupBy("_home").agg(
        F.sum("_n").alias("_all"), *[a for c in cols for a in exact.sum_columns(f"_h{c}", F.col(f"_s{c}"), tops[c])]
    )
    return homes.select("_home", "_all", *[exact.as_double(f"_h{c}", tops[c]).alias(f"_h{c}") for c in cols])


def _right_side(cells: DataFrame, cols: list[str], tops: Mapping[str, int]) -> DataFrame:
    """Per level its rows and, for each column, the sum of what demeaning within homes leaves."""
    marked = attach(cells, _home_sums(cells, cols, tops), ["_home"], "_all")
    left = {c: F.col(f"_s{c}") - F.col("_n") * F.col(f"_h{c}") / F.col("_all") for c in cols}
    sums = marked.groupBy("_level").agg(
        F.sum("_n").alias("_rows"), *[a for c in cols for a in exact.sum_columns(f"_g{c}", left[c], tops[c] + 1)]
    )
    return sums.select("_level", "_rows", *[exact.as_double(f"_g{c}", tops[c] + 1).alias(f"_g{c}") for c in cols])


def _effects_direct(cells: DataFrame, cols: list[str], tops: Mapping[str, int], n: int) -> tuple[DataFrame, int]:
    """Effects of at most ``DENSE_LEVELS`` levels from one dense system; a home has so many cells at most."""
    right = sorted(_right_side(cells, cols, tops).collect(), key=lambda r: str(r["_level"]))
    order = {r["_level"]: i for i, r in enumerate(right)}
    homes = cells.groupBy("_home").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_level", "_n")).alias("_cells"))
    both = homes.select("_all", F.explode("_cells").alias("c"), "_cells").select("_all", "c", F.explode("_cells").alias("d"))
    weight = F.col("c._n") * F.col("d._n") / F.col("_all")
    top = exact.exponent(float(n))
    shared = both.groupBy(F.col("c._level").alias("a"), F.col("d._level").alias("b")).agg(*exact.sum_columns("w", weight, top))
    system = np.zeros((len(order), len(order)))
    for r in right:
        system[order[r["_level"]], order[r["_level"]]] = r["_rows"]
    for r in shared.collect():
        system[order[r["a"]], order[r["b"]]] -= float(exact.total(r.asDict(), "w", top))
    scale = np.sqrt([r["_rows"] for r in right])
    values, vectors = np.linalg.eigh(system / np.outer(scale, scale))
    known = values > 1e-10
    inverse = (vectors[:, known] / values[known]) @ vectors[:, known].T / np.outer(scale, scale)
    found = inverse @ np.array([[r[f"_g{c}"] for c in cols] for r in right])
    schema = StructType([cells.schema["_level"], StructField("_rows", LongType()), *[StructField(c, DoubleType()) for c in cols]])
    rows = [(r["_level"], r["_rows"], *map(float, found[i])) for i, r in enumerate(right)]
    return cells.sparkSession.createDataFrame(rows, schema), int(known.sum())


def _effects_iterated(cells: DataFrame, cols: list[str], tops: Mapping[str, int], n: int) -> tuple[DataFrame, int]:
    """Effects of any number of levels by conjugate gradients, all columns at a time.

    One step gives every cell its level's value, takes the means within homes and adds up what is left by
    level: two groupings of the cells. The vectors are written tables with a row per level; the driver
    holds a few numbers per column. Steps end when every column's residual is below ``TOLERANCE`` of its
    first, or below what rounding leaves.
    """
    state = _right_side(cells, cols, tops)
    state = materialize(
        state.select(
            "_level", "_rows",
            *[F.lit(0.0).alias(f"a{c}") for c in cols], *[F.col(f"_g{c}").alias(f"r{c}") for c in cols],
            *[(F.col(f"_g{c}") / F.col("_rows")).alias(f"p{c}") for c in cols],
        ), "gradients",
    )
    lengths = lambda df: df.agg(*[F.sum(F.col(f"r{c}") * F.col(f"r{c}") / F.col("_rows")).alias(c) for c in cols]).first()
    first = now = lengths(state)
    homes = materialize(cells.groupBy("_home").agg(F.sum("_n").alias("_all")), "homes")
    for _ in range(MOST_STEPS):
        if all(now[c] <= TOLERANCE**2 * first[c] for c in cols):
            break
        values = cells.select("_level", "_home", "_n")
        given = attach(values, state.select("_level", "_rows", *[f"p{c}" for c in cols]), ["_level"], "_rows", written=True).drop("_rows")
        given = materialize(given, "given")
        means = given.groupBy("_home").agg(*[F.sum(F.col("_n") * F.col(f"p{c}")).alias(f"h{c}") for c in cols])
        means = means.join(homes, "_home")
        left = attach(given, means, ["_home"], "_all")
        moved = left.groupBy("_level").agg(
            *[F.sum(F.col("_n") * (F.col(f"p{c}") - F.col(f"h{c}") / F.col("_all"))).alias(f"q{c}") for c in cols]
        )
        state = materialize(state.join(moved, "_level"), "gradients")
        curve = state.agg(*[F.sum(F.col(f"p{c}") * F.col(f"q{c}")).alias(c) for c in cols]).first()
        step = {c: now[c] / curve[c] if curve[c] > 0 and now[c] > TOLERANCE**2 * first[c] else 0.0 for c in cols}
        state = state.withColumns(
            {
                **{f"a{c}": F.col(f"a{c}") + F.lit(step[c]) * F.col(f"p{c}") for c in cols},
                **{f"r{c}": F.col(f"r{c}") - F.lit(step[c]) * F.col(f"q{c}") for c in cols},
            }
        ).drop(*[f"q{c}" for c in cols])
        then = lengths(state)
        turn = {c: then[c] / now[c] if now[c] > 0 and step[c] else 0.0 for c in cols}
        state = state.withColumns({f"p{c}": F.col(f"r{c}") / F.col("_rows") + F.lit(turn[c]) * F.col(f"p{c}") for c in cols})
        state = materialize(state, "gradients")
        now = then
    else:
        raise RuntimeError(f"effects were not found within {MOST_STEPS} steps")
    levels = state.select("_level", "_rows", *[F.col(f"a{c}").alias(c) for c in cols])
    return levels, state.count() - _connected(cells)


def _connected(cells: DataFrame) -> int:
    """Number of sets of levels and homes that no cell connects.

    Levels take the smallest mark among the levels they share a home with, and every mark its own mark's
    mark, until nothing changes; marks halve their way, so rounds grow with the logarithm of the distance.
    """
    numbered = cells.select("_level").distinct().withColumn("_mark", F.monotonically_increasing_id())
    marks = materialize(numbered.withColumn("_id", F.col("_mark")), "marks")
    total = None
    while True:
        told = cells.select("_level", "_home").join(marks, "_level")
        homes = told.groupBy("_home").agg(F.min("_mark").alias("_low"))
        lower = cells.select("_level", "_home").join(homes, "_home").groupBy("_level").agg(F.min("_low").alias("_low"))
        marks = materialize(
            marks.join(lower, "_level").select("_level", "_id", F.least("_mark", "_low").alias("_mark")), "marks"
        )
        further = marks.select(F.col("_id").alias("_mark"), F.col("_mark").alias("_next"))
        marks = materialize(marks.join(further, "_mark").select("_level", "_id", F.col("_next").alias("_mark")), "marks")
        now = marks.agg(F.sum("_mark")).first()[0]
        if now == total:
            return marks.select("_mark").distinct().count()
        total = now


def _nested(data: DataFrame, effects: Sequence[str], group: str) -> int:
    """How many absorbed effects lie within one group each; one constant stays counted."""
    nested = 0
    for e in effects:
        if e == group:
            nested += data.select(e).distinct().count()
            continue
        inside = data.groupBy(e).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
        row = inside.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("lo") == F.col("hi")).alias("all")).first()
        nested += row["n"] if row["all"] else 0
    return max(nested - 1, 0) if nested else 0


def _clustered(
    data: DataFrame, group: str, cols: list[str], centre: list[float], tops: Mapping[str, int], names: Sequence[str], kept: list[int],
    coef: Mapping[str, float], inverse: np.ndarray, n: int, used: int, mean: np.ndarray | None,
) -> dict[str, float]:
    """Standard errors from the summed scores of each group; one row of scores per group is added up."""
    x = {j: F.col(cols[j]) - F.lit(centre[j]) for j in kept}
    error = F.col(cols[-1]) - F.lit(centre[-1])
    for j in kept:
        error = error - F.lit(coef[names[j]]) * x[j]
    # |error| is below the sum of what it is made of.
    top = max([tops[cols[-1]], *[tops[cols[j]] + exact.exponent(abs(coef[names[j]])) for j in kept]]) + len(kept) + 2
    scores = {f"_g{j}": (x[j] * error, tops[cols[j]] + 1 + top) for j in kept}
    if mean is not None:
        scores["_g"] = (error, top)
    sums = materialize(exact.group_sums(data, [group], scores, "_n"), "scores")
    order = list(scores)
    groups, box = exact.extremes(sums, order)
    _, products = _exact_cross(sums, order, exact.tops(box))
    meat = np.zeros((len(order), len(order)))
    for (i, j), q in products.items():
        meat[i, j] = meat[j, i] = float(q)
    k = len(kept)
    bread = inverse
    if mean is not None:  # the constant's column is at right angles to the centred regressors
        bread = np.zeros((k + 1, k + 1))
        bread[:k, :k], bread[k, k] = inverse, 1 / n
    factor = groups / (groups - 1) * (n - 1) / (n - k - used) if groups > 1 and n > k + used else float("nan")
    covariance = bread @ meat @ bread * factor
    se = {names[j]: float(np.sqrt(covariance[i, i])) for i, j in enumerate(kept)}
    if mean is None:
        return se
    turn = np.append(-mean[kept], 1.0)
    return {INTERCEPT: float(np.sqrt(turn @ covariance @ turn)), **se}


def ols_linear(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    return ols(df, y, xs)


def ols_quadratic(df: DataFrame, y: str, xs: Sequence[str], squares: Sequence[str]) -> Fit:
    return ols(df, y, xs, squares)


def ols_controls(df: DataFrame, y: str, xs: Sequence[str], controls: Sequence[str], squares: Sequence[str] = ()) -> Fit:
    return ols(df, y, [*xs, *controls], squares)


def ols_fixed_effect(
    df: DataFrame, y: str, xs: Sequence[str], fe: str, squares: Sequence[str] = (), cluster: str | None = None
) -> Fit:
    return ols(df, y, xs, squares, fe, cluster)


def ols_two_way_fe(
    df: DataFrame, y: str, xs: Sequence[str], fe1: str, fe2: str, squares: Sequence[str] = (), cluster: str | None = None
) -> Fit:
    """Absorbed ``fe1`` (fewer levels, such as years) and ``fe2`` (many, such as households); both may have many."""
    return ols(df, y, xs, squares, [fe1, fe2], cluster)


def ols_coef_table(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Rows (spec, term, estimate, std_error) of several fits; ``df`` only lends its session."""
    spark = df.sparkSession
    schema = "term string, estimate double, std_error double"
    return stack_with_id(
        [spark.createDataFrame([(t, f.coef[t], f.se[t]) for t in f.coef], schema) for f in fits]
    )


def ols_fitted(df: DataFrame, fits: Sequence[Fit], prefix: str = "Model") -> DataFrame:
    """``df`` with the fitted value of each specification as columns Model1, Model2, ...

    Absorbed effects enter through exact group means of the residual; rows with a null get none.
    """
    out = df
    for number, fit in enumerate(fits, 1):
        name = f"{prefix}{number}"
        parts = [F.lit(b) if t == INTERCEPT else F.lit(b) * _square_or_column(t) for t, b in fit.coef.items()]
        out = out.withColumn(name, reduce(add, parts, F.lit(0.0)))
        if fit.effects is not None:
            out = attach(out, fit.effects, [fit.fe[0]], "_rows", written=True)
            out = out.withColumn(name, F.col(name) + F.col("_effect1")).drop("_effect1", "_rows")
        if fit.fe:
            group = fit.fe[-1]
            out = out.withColumn("_gap", F.when(F.col(name).isNotNull(), F.col(fit.y).cast("double") - F.col(name)))
            _, box = exact.extremes(out, ["_gap"])
            known = out.filter(F.col("_gap").isNotNull())
            gaps = exact.group_sums(known, [group], {"_sum": (F.col("_gap"), exact.tops(box)["_gap"])}, "_gaps")
            out = attach(out.drop("_gap"), gaps.withColumn("_effect", F.col("_sum") / F.col("_gaps")).drop("_sum"), [group], "_gaps")
            out = out.withColumn(name, F.col(name) + F.col("_effect")).drop("_effect", "_gaps")
    return out


def _square_or_column(term: str) -> Column:
    return F.col(term[:-2]).cast("double") * F.col(term[:-2]) if term.endswith("^2") else F.col(term)
