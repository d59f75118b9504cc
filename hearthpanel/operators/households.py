"""Household finance and adoption: one batch step each over a table of households.

Columns in use: hid, income, incomesd, powercons, liquidity, trend, discount, house, pv, panelage,
attitude, debt, loanrate, debtservice. Costs, tariffs and policy values are columns or numbers, so
that one table can carry several scenarios.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.functions import draws
from hearthpanel.functions.finance import (
    Value,
    annuity,
    balance_after,
    col,
    discounted_interest,
    discounted_yield,
    panel_yield,
)
from hearthpanel.operators.aggregates import positive_mean, share_or_zero
from hearthpanel.operators.joins import percentile_lookup_join, year_lookup_earliest_fallback
from hearthpanel.operators.ranking import position_groups
from hearthpanel.operators.reshape import wide_to_long

c = F.col


# --- draws and trends -------------------------------------------------------------------------


def hash_uniform(df: DataFrame, key: str, seed: int | str, lo: float = 0.0, hi: float = 1.0, name: str = "u") -> DataFrame:
    return df.withColumn(name, draws.uniform(c(key), seed, lo, hi))


def normal_draw(df: DataFrame, key: str, seed: int | str, name: str = "z") -> DataFrame:
    return df.withColumn(name, draws.normal(c(key), seed))


def income_draw(df: DataFrame, seed: int | str, key: str = "hid", name: str = "income_drawn") -> DataFrame:
    """Income drawn around its mean with a relative standard deviation, above zero."""
    drawn = c("income") * (1 + c("incomesd") * draws.normal(c(key), seed))
    return df.withColumn(name, F.greatest(drawn, F.lit(1e-10)))


def trend_growth(df: DataFrame, periods: int, cols: Sequence[str] = ("income", "powercons"), step: str = "t") -> DataFrame:
    """Rows for t = 0..periods with the columns grown by (1 + trend)^t."""
    rows = df.withColumn(step, F.explode(F.sequence(F.lit(0), F.lit(periods))))
    return rows.withColumns({x: c(x) * F.pow(1 + c("trend"), c(step)) for x in cols})


# --- policy -----------------------------------------------------------------------------------


def policy_schedule(scenarios: DataFrame, first: int, last: int) -> DataFrame:
    """Scenario x year with the policy values in force, 0 before their start.

    Scenarios carry a flag per policy (subsidy1, subsidy2, credit1, credit2), its value (s1, s2,
    cp1, cp2) and the years subsidy_start and credit_start.
    """
    years = scenarios.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    # Fixed pairing of policy value, flag and start year.
    policies = {
        "s1": ("subsidy1", "subsidy_start"),
        "s2": ("subsidy2", "subsidy_start"),
        "cp1": ("credit1", "credit_start"),
        "cp2": ("credit2", "credit_start"),
    }
    return years.select(
        "scenario",
        "year",
        *[
            F.when((c(flag) == 1) & (c("year") >= c(start)), c(value)).otherwise(0.0).alias(value)
            for value, (flag, start) in policies.items()
        ],
    )


# --- running a panel --------------------------------------------------------------------------


def panel_revenue(df: DataFrame, price: Value, capacity: float, own_use: float, topup: Value = 0.0) -> DataFrame:
    """Yearly revenue and cost saving of owned panels."""
    worth = panel_yield(c("powercons"), c("tariff") + col(topup), col(price), capacity, own_use)
    return df.withColumn("panelrevenue", F.when(c("pv") == 1, worth).otherwise(0.0))


def net_power_cost(df: DataFrame, price: Value) -> DataFrame:
    """Power cost less panel revenue, the income left (at least 0) and the profit so far."""
    return df.withColumn("powercost", c("powercons") * col(price) - c("panelrevenue")).withColumns(
        {
            "income_net": F.greatest(c("income") - c("powercost"), F.lit(0.0)),
            "profit": c("profit") + F.when(c("pv") == 1, c("panelrevenue")).otherwise(0.0),
        }
    )


def panel_ageing(df: DataFrame, max_age: int) -> DataFrame:
    """Owned panels age by a year; past the maximum age flag, tariff and age return to 0."""
    aged = c("panelage") + F.when(c("pv") == 1, 1).otherwise(0)
    worn = aged > max_age
    return df.withColumns(
        {
            "pv": F.when(worn, 0).otherwise(c("pv")),
            "tariff": F.when(worn, 0.0).otherwise(c("tariff")),
            "panelage": F.when(worn, 0).otherwise(aged),
        }
    )


def feasibility_flag(df: DataFrame, probability: float, seed: int | str, key: str = "hid") -> DataFrame:
    """1 for owners and houses, for flats with the given probability."""
    lucky = draws.uniform(c(key), seed) >= 1 - probability
    return df.withColumn("feasible", F.when((c("pv") == 1) | (c("house") == 1) | lucky, 1).otherwise(0))


def owner_tariff(df: DataFrame, tariffs: DataFrame, start: int) -> DataFrame:
    """Tariff of the year an owner adopted in (start - age - 1), the earliest one if older."""
    found = year_lookup_earliest_fallback(df, tariffs, start - c("panelage") - 1, "tariff")
    return found.withColumn("tariff", F.when(c("pv") == 1, c("tariff")).otherwise(0.0))


def initial_cumulative_profit(
    df: DataFrame, costs: DataFrame, start: int, price: Value, capacity: float, own_use: float,
    subsidy: Value = 0.0, topup: Value = 0.0,
) -> DataFrame:
    """Profit of owners so far: today's yearly revenue for each year of age less the cost paid."""
    found = year_lookup_earliest_fallback(
        panel_revenue(df, price, capacity, own_use, topup), costs, start - c("panelage") - 1, "_cost"
    )
    profit = c("panelrevenue") * c("panelage") - (1 - col(subsidy)) * c("_cost")
    return found.withColumn("profit", F.when(c("pv") == 1, profit).otherwise(0.0)).drop("_cost", "panelrevenue")


# --- consumption, saving, debt ----------------------------------------------------------------


def desired_consumption(df: DataFrame, propensities: DataFrame, persistence: float, first: bool) -> DataFrame:
    """Propensity of the income percentile times net income, blended with the previous
    consumption unless this is the first period."""
    joined = percentile_lookup_join(df, propensities, name="_propensity")
    target = c("_propensity") * c("income_net")
    if not first:
        target = persistence * c("consumption") + (1 - persistence) * target
    return joined.withColumn("consumption", target).drop("_propensity")


def liquidity_update(df: DataFrame) -> DataFrame:
    """Add saving; where consumption and power cost cannot be met liquidity falls to 0."""
    left = c("liquidity") + c("income") - c("consumption") - c("powercost")
    enough = c("liquidity") + c("income") >= c("consumption") + c("powercost")
    return df.withColumns({"liquidity_before": c("liquidity"), "liquidity": F.when(enough, left).otherwise(0.0)})


def debt_service(df: DataFrame, max_age: int) -> DataFrame:
    """Pay interest, then principal, as far as liquidity goes.

    Unpaid interest is added to the debt, whoever pays less than due gets a new instalment over
    the remaining term, and the interest paid lowers the profit.
    """
    due = F.when(c("debt") > 0, F.least("debtservice", "debt")).otherwise(c("debtservice"))
    states = df.withColumns({"_due": due, "_interest": c("loanrate") * c("debt")}).withColumns(
        {
            "_full": c("liquidity") >= c("_due"),
            "_paid": F.least(c("_interest"), c("liquidity")),
            "_term": F.greatest(F.lit(1), max_age - c("panelage")),
        }
    )
    owed = (
        F.when(c("_full"), c("debt") - (c("_due") - c("_interest")))
        .when(c("liquidity") >= c("_interest"), c("debt") - (c("liquidity") - c("_interest")))
        .otherwise(c("debt") + c("_interest") - c("liquidity"))
    )
    paid = states.withColumns(
        {
            "debt": owed,
            "interest_paid": F.when(c("_full"), c("_interest")).otherwise(c("_paid")),
            "payment": F.when(c("_full"), c("_due")).otherwise(c("liquidity")),
            "liquidity": F.when(c("_full"), c("liquidity") - c("_due")).otherwise(0.0),
        }
    )
    again = F.when(c("_full"), c("_due")).otherwise(annuity(c("debt"), c("loanrate"), c("_term")))
    closed = c("debt") <= 0
    return paid.withColumns(
        {
            "profit": c("profit") - c("interest_paid"),
            "debtservice": F.when(closed, 0.0).otherwise(again),
            "loanrate": F.when(closed, 0.0).otherwise(c("loanrate")),
            "debt": F.when(closed, 0.0).otherwise(c("debt")),
        }
    ).drop("_due", "_interest", "_full", "_paid", "_term")


def liquid_saving_share(df: DataFrame, shares: DataFrame) -> DataFrame:
    """Only the share of the income percentile of an increase stays liquid."""
    joined = percentile_lookup_join(df, shares, name="_share")
    kept = c("liquidity_before") + c("_share") * (c("liquidity") - c("liquidity_before"))
    grown = c("liquidity") > c("liquidity_before")
    return joined.withColumn("liquidity", F.when(grown, kept).otherwise(c("liquidity"))).drop("_share")


# --- loan and adoption ------------------------------------------------------------------------


def loan_needed(df: DataFrame, cost: Value, subsidy: Value = 0.0) -> DataFrame:
    """What liquidity leaves open of the subsidised cost; 0 for owners and the infeasible."""
    price = (1 - col(subsidy)) * col(cost)
    none = (c("pv") == 1) | (c("feasible") == 0) | (c("liquidity") >= price)
    return df.withColumn("loan", F.when(none, 0.0).otherwise(price - c("liquidity")))


def loan_offer(
    df: DataFrame, cost: Value, base_rate: Value, markup: float, max_ltv: float, periods: int, subsidy: Value = 0.0
) -> DataFrame:
    """Offered rate, rising with the loan to value, and the annuity instalment."""
    # Nothing is left to borrow for under a full subsidy.
    to_value = F.coalesce(F.try_divide(c("loan"), (1 - col(subsidy)) * col(cost) * max_ltv), F.lit(0.0))
    rate = col(base_rate) + markup * (1 + to_value)
    return df.withColumn("offerrate", rate).withColumn("instalment", annuity(c("loan"), c("offerrate"), periods))


def credit_rationing(
    df: DataFrame, cost: Value, max_ltv: float, max_dti: float, subsidy: Value = 0.0,
    ltv_change: Value = 0.0, dti_change: Value = 0.0,
) -> DataFrame:
    """1 where loan to value or instalment to income is too high and a loan is wanted at all."""
    over_value = c("loan") + c("debt") > (1 - col(subsidy)) * col(cost) * (max_ltv + col(ltv_change))
    # Without an income any instalment is too high.
    to_income = F.when(c("income") == 0, F.lit(float("inf"))).otherwise(F.try_divide(c("instalment"), c("income")))
    over_income = to_income > max_dti + col(dti_change)
    wanted = (c("loan") != 0) & (c("feasible") != 0) & (c("pv") != 1)
    return df.withColumn("rationed", F.when(wanted & (over_value | over_income), 1).otherwise(0))


def amortisation_schedule(df: DataFrame, periods: int, ids: Sequence[str] = ("hid",)) -> DataFrame:
    """Interest, principal and remaining balance per loan and period t = 0..periods-1."""
    rows = df.select(*ids, "loan", "offerrate", "instalment", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("t"))
    balance = lambda paid: balance_after(c("loan"), c("offerrate"), c("instalment"), paid)
    return rows.withColumns({"interest": c("offerrate") * balance(c("t")), "balance": balance(c("t") + 1)}).withColumn(
        "principal", c("instalment") - c("interest")
    )


def discounted_loan_cost(df: DataFrame, periods: int) -> DataFrame:
    """Discounted interest of the whole schedule, in closed form."""
    return df.withColumn(
        "loancost", discounted_interest(c("loan"), c("offerrate"), c("instalment"), c("discount"), periods)
    )


def expected_revenue(
    df: DataFrame, tariff: Value, capacity: float, own_use: float, topup: Value = 0.0, path: str = "expected"
) -> DataFrame:
    """Discounted panel yield over the expected price path, consumption growing by its trend."""
    rate = col(tariff) + col(topup)
    return df.withColumn(
        "revenue", discounted_yield(c(path), c("powercons"), c("trend"), c("discount"), rate, capacity, own_use)
    )


def adoption_utility(df: DataFrame, cost: Value, beta: float, subsidy: Value = 0.0) -> DataFrame:
    """Expected profit, peers and attitude; only the profit for former owners who gained.

    The rationed, the infeasible and owners have utility 0.
    """
    gain = c("revenue") - (1 - col(subsidy)) * col(cost) - c("loancost")
    again = (c("adopted") == 1) & (c("profit") > 0) & (c("pv") == 0)
    out = (c("rationed") == 1) | (c("feasible") == 0) | (c("pv") == 1)
    social = c("influence") * (2 * c("peer_share") - 1) + beta * c("attitude")
    return df.withColumn("expected_profit", gain).withColumn(
        "utility", F.when(out, 0.0).when(again, c("expected_profit")).otherwise(c("expected_profit") + social)
    )


def adoption_update(df: DataFrame, cost: Value, tariff: Value, periods: int, subsidy: Value = 0.0) -> DataFrame:
    """Households with positive utility become owners; their loans are merged with older debt.

    Former owners who made a loss start again from a profit of 0.
    """
    price = (1 - col(subsidy)) * col(cost)
    buys, borrows = c("utility") > 0, (c("utility") > 0) & (c("loan") > 0)
    lost = (c("adopted") == 1) & (c("profit") <= 0) & (c("pv") == 0)
    blended = (c("offerrate") * c("loan") + c("loanrate") * c("debt")) / (c("loan") + c("debt"))
    return df.withColumns(
        {
            "adopter": F.when(buys, 1).otherwise(0),
            "profit": F.when(buys, -price).when(lost, 0.0).otherwise(c("profit")),
            "liquidity": F.when(buys, c("liquidity") - price + c("loan")).otherwise(c("liquidity")),
            "tariff": F.when(buys, col(tariff)).otherwise(c("tariff")),
            "loanrate": F.when(borrows, blended).otherwise(c("loanrate")),
            "debt": F.when(borrows, c("debt") + c("loan")).otherwise(c("debt")),
            "pv": F.when(buys, 1).otherwise(c("pv")),
            "adopted": F.when(buys, 1).otherwise(c("adopted")),
            "_borrows": borrows,
        }
    ).withColumn(
        "debtservice", F.when(c("_borrows"), annuity(c("debt"), c("loanrate"), periods)).otherwise(c("debtservice"))
    ).drop("_borrows")


# --- statistics -------------------------------------------------------------------------------


def ownership_shares(df: DataFrame, keys: Sequence[str] = (), group: str = "decile") -> DataFrame:
    """Members, owners and ownership share per group."""
    return df.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("pv").alias("owners"),
        (F.sum("pv") / F.count(F.lit(1))).alias("share"),
    )


def ownership_by_decile(df: DataFrame, income: str = "income", keys: Sequence[str] = ()) -> DataFrame:
    """Members, owners and ownership share per income decile; an empty decile has no row."""
    return ownership_shares(position_groups(df, income, 10, keys, "decile"), keys)


def period_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of income, liquidity, next expected price and debt, ownership among all and among the
    feasible, and the rationed share of those who could adopt."""
    could = F.sum(F.when((c("pv") == 0) & (c("feasible") == 1), 1).otherwise(0))
    return df.groupBy(*keys).agg(
        F.avg("income").alias("AverageIncome"),
        F.avg("liquidity").alias("AverageLiquidity"),
        F.avg("expected_price").alias("AverageExpectedPrice"),
        positive_mean("debt").alias("AverageDebt"),
        F.avg("pv").alias("AdoptionRate1"),
        share_or_zero(F.sum("pv"), F.sum("feasible")).alias("AdoptionRate2"),
        share_or_zero(F.sum("rationed"), could).alias("RationedShare"),
    )


def run_series_long(
    df: DataFrame, ids: Sequence[str], variables: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Yearly statistics of several runs -> rows (ids, variable, value), renamed if a mapping is given."""
    names = dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}
    renamed = df.select(*ids, *[c(old).alias(new) for old, new in names.items()])
    return wide_to_long(renamed, ids, list(names.values()), "variable", "value")
