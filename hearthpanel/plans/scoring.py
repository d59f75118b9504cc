"""One-period adoption scoring of a household table under several policy scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.operators import households as h
from hearthpanel.operators.joins import broadcast_scalars, peer_rate_join
from hearthpanel.operators.keyed import attach, null_safe_join
from hearthpanel.operators.ranking import position_groups
from hearthpanel.operators.series import expected_price_path
from hearthpanel.workspace import materialize


@dataclass(frozen=True)
class Market:
    """Constants of a scoring run."""

    year: int
    price: float
    capacity: float
    own_use: float
    max_age: int
    max_ltv: float
    max_dti: float
    markup: float
    feasible_share: float
    beta: float
    influence: tuple[float, float]
    seed: int


def initial_households(states: DataFrame, lookups: DataFrame, market: Market) -> DataFrame:
    """Feasibility, influence, tariff and profit so far of each household.

    ``lookups`` has year, tariff, cost and baserate.
    """
    df = h.feasibility_flag(states, market.feasible_share, f"feasible{market.seed}")
    df = h.hash_uniform(df, "hid", f"influence{market.seed}", *market.influence, name="influence")
    df = h.owner_tariff(df, lookups.select("year", F.col("tariff").alias("value")), market.year)
    df = h.initial_cumulative_profit(
        df, lookups.select("year", F.col("cost").alias("value")), market.year, market.price, market.capacity, market.own_use
    )
    return df.withColumn("adopted", F.col("pv"))


def under_scenarios(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every row once per scenario, with the scenario's columns; any number of scenarios.

    Rows are repeated with the numbers of the scenarios and joined to them by number.
    """
    # One row per scenario.
    numbered = scenarios.withColumn("_scenario", F.row_number().over(Window.orderBy("scenario")) - 1)
    policies = materialize(numbered, "scenarios")
    n = policies.count()
    numbers = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    return df.withColumn("_scenario", F.explode(numbers)).join(policies, "_scenario").drop("_scenario")


def score_households(
    states: DataFrame, learned: DataFrame, lookups: DataFrame, scenarios: DataFrame, market: Market, series: str = "series"
) -> DataFrame:
    """Every household under every scenario after one decision.

    ``learned`` holds the price coefficients per series, ``states`` names the series a household
    looks at; ``scenarios`` are the rows of a policy schedule, of which those of
    the market's year count.
    """
    df = initial_households(states, lookups, market)
    df = broadcast_scalars(
        df,
        lookups.filter(F.col("year") == market.year).select(
            F.col("tariff").alias("new_tariff"), F.col("cost").alias("cost"), F.col("baserate").alias("base_rate")
        ),
    )
    df = under_scenarios(df, scenarios.filter(F.col("year") == market.year).drop("year"))

    topup, subsidy, cost = F.col("s2"), F.col("s1"), F.col("cost")
    df = h.panel_revenue(df, market.price, market.capacity, market.own_use, topup)
    df = h.net_power_cost(df, market.price)
    df = materialize(position_groups(df, "income_net", 10, ["scenario"], "decile"), "ranked")
    shares = h.ownership_shares(df, ["scenario"])
    df = attach(df, shares.select("scenario", "decile", F.col("share").alias("peer_share")), ["scenario", "decile"])

    paths = expected_price_path(learned, market.max_age).select(series, "expected")
    df = attach(df, paths, [series])
    df = h.loan_needed(df, cost, subsidy)
    df = h.loan_offer(df, cost, F.col("base_rate"), market.markup, market.max_ltv, market.max_age, subsidy)
    df = h.credit_rationing(df, cost, market.max_ltv, market.max_dti, subsidy, F.col("cp1"), F.col("cp2"))
    df = h.expected_revenue(df, F.col("new_tariff"), market.capacity, market.own_use, topup)
    df = h.discounted_loan_cost(df, market.max_age)
    df = h.adoption_utility(df, cost, market.beta, subsidy)
    df = df.withColumn("expected_price", F.col("expected")[0]).drop("expected")
    return h.adoption_update(df, cost, F.col("new_tariff"), market.max_age, subsidy)


def job_adoption_scoring(
    states: DataFrame, learned: DataFrame, lookups: DataFrame, scenarios: DataFrame, market: Market
) -> DataFrame:
    """Adopters and period statistics per scenario."""
    scored = materialize(score_households(states, learned, lookups, scenarios, market), "scored")
    stats = h.period_statistics(scored, ["scenario"])
    adopters = scored.groupBy("scenario").agg(F.count(F.lit(1)).alias("households"), F.sum("adopter").alias("adopters"))
    return null_safe_join(stats, adopters, ["scenario"])
