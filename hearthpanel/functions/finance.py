"""Formulas of household finance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float


def col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def panel_yield(consumption: Column, tariff: Column, price: Column, capacity: float, own_use: float) -> Column:
    """Yearly value of a panel: where the tariff pays at least the price everything is fed in,
    otherwise the own use, at most the consumption below capacity, saves the price."""
    share = F.lit(capacity * own_use)
    used = F.when(consumption >= capacity, share).otherwise(F.least(share, consumption))
    return F.when(tariff >= price, tariff * capacity).otherwise(used * price + (capacity - used) * tariff)


def annuity(loan: Column, rate: Column, periods: Value) -> Column:
    """Constant instalment that repays a loan; an interest-free loan is split evenly."""
    growth = F.pow(1 + rate, col(periods))
    return F.when(rate == 0, loan / col(periods)).otherwise(loan * rate * growth / (growth - 1))


def balance_after(loan: Column, rate: Column, instalment: Column, paid: Column) -> Column:
    """Remaining balance after ``paid`` instalments."""
    growth = F.pow(1 + rate, paid)
    return F.when(rate == 0, loan - instalment * paid).otherwise(loan * growth - instalment * (growth - 1) / rate)


def price_path(last: Column, change: Column, intercept: Column, slope: Column, horizon: int) -> Column:
    """Deterministic AR(1) in differences: the next ``horizon`` values as an array."""
    def step(state: Column, _: Column) -> Column:
        d = intercept + slope * state["d"]
        p = state["p"] + d
        return F.struct(p.alias("p"), d.alias("d"), F.concat(state["path"], F.array(p)).alias("path"))

    start = F.struct(
        last.cast("double").alias("p"), change.cast("double").alias("d"), F.array().cast("array<double>").alias("path")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["path"])


def geometric_sum(ratio: Column, terms: int) -> Column:
    """1 + q + ... + q^(terms-1), by its first-order expansion where q is all but 1."""
    near = F.abs(ratio - 1) < 1e-7
    return F.when(near, terms * (1 + (terms - 1) / 2 * (ratio - 1))).otherwise(
        (F.pow(ratio, F.lit(terms)) - 1) / (ratio - 1)
    )


def discounted_interest(loan: Column, rate: Column, instalment: Column, discount: Column, periods: int) -> Column:
    """Discounted interest of a loan's whole schedule.

    The balance is (L - S/r)(1+r)^t + S/r, so the sum consists of two geometric ones.
    """
    growing = geometric_sum((1 + rate) / (1 + discount), periods)
    return F.when(rate == 0, F.lit(0.0)).otherwise(
        (rate * loan - instalment) * growing + instalment * geometric_sum(1 / (1 + discount), periods)
    )


def discounted_yield(
    prices: Column, consumption: Column, trend: Column, discount: Column, tariff: Column, capacity: float, own_use: float
) -> Column:
    """Discounted panel yield over an array of prices, consumption growing by its trend."""
    def step(state: Column, price: Column) -> Column:
        worth = panel_yield(state["use"], tariff, price, capacity, own_use)
        return F.struct(
            (state["total"] + worth * state["weight"]).alias("total"),
            (state["use"] * (1 + trend)).alias("use"),
            (state["weight"] / (1 + discount)).alias("weight"),
        )

    start = F.struct(F.lit(0.0).alias("total"), consumption.cast("double").alias("use"), F.lit(1.0).alias("weight"))
    return F.aggregate(prices, start, step, lambda state: state["total"])
