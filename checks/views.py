"""Household survey tables derived from the raw tables, as SQL both engines run.

Names in braces are other views or raw tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.workspace import materialize

RAW = ["customer", "orders", "lineitem", "part"]

_IMPUTED = [f"consum{k}{i}" for i in "bc" for k in range(1, 6)] + ["oheat_b", "oheat_c", "rheat_b", "rheat_c"]
CW_COLUMNS = [*_IMPUTED, "consum1f", "consum1_a"]
# Family, factor: fixed values of the test tables.
FAMILIES = {"w010h": 20, "f010h": 3, "t010h": 1, "b010h": 5, "c010h": 2, "w001h": 25}
WW_COLUMNS = [f"{v}{i}" for v in FAMILIES for i in "ab"]

CONSUMPTION_CODEBOOK = [
    ("1", "Food", "Daily"),
    ("2", "Clothes", "Daily"),
    ("3", "Transport", "Transport"),
    ("4", "Health", "Health"),
    ("5", "Insurance", "Financial"),
    ("oheat", "Heating", "Heating"),
    ("rheat", "Heating", "Heating"),
]
CONCEPTS = ["Food", "Clothes", "Transport", "Health", "Insurance", "Heating"]
WEALTH_CODEBOOK = [
    ("w010h", "HouseRaw"),
    ("f010h", "financial"),
    ("t010h", "tangible"),
    ("b010h", "business"),
    ("c010h", "ConsumerDebt"),
    ("w001h", "GrossWealth"),
]

# Model parameters: fixed values of the test tables.
PRICE = 0.30
CAPACITY, OWN_USE, MAX_AGE = 4500.0, 0.3, 20
MAX_LTV, MAX_DTI, MARKUP = 1.0, 0.02, 0.02
PERSISTENCE, FEASIBLE_PROB, BETA = 0.6, 0.3, 100.0
INFLUENCE, GAIN = (0.0, 1000.0), (0.01, 0.1)
START, BASE_RATE, SEED = 2019, 0.02, 1
OBSERVED = 70
PRICE_SCALE = 15000.0


def cost(year: int) -> float:
    return 30000.0 - 1100 * (year - 2000)


def tariff(year: int) -> float:
    return 0.50 - 0.02 * (year - 2000)


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _case_sum(k: int, factor: int) -> str:
    return f"CAST(sum(CASE WHEN l_linenumber = {k} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) / {factor}"


_cw = ", ".join(
    [f"{_case_sum(k, 100)} AS consum{k}b" for k in range(1, 6)]
    + [f"{_case_sum(k, 80)} AS consum{k}c" for k in range(1, 6)]
    + [f"{_case_sum(6, 100)} AS oheat_b", f"{_case_sum(6, 80)} AS oheat_c"]
    + [f"{_case_sum(7, 100)} AS rheat_b", f"{_case_sum(7, 80)} AS rheat_c"]
    + ["CAST(1 AS DOUBLE) AS consum1f", "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS consum1_a"]
)
_ww = ", ".join(
    f"CASE WHEN (3 * hid + syear + {k}) % 9 = 0 THEN CAST(-8 AS DOUBLE) ELSE balance * {factor} + {j} END AS {v}{i}"
    for k, (v, factor) in enumerate(FAMILIES.items())
    for j, i in enumerate("ab")
)

VIEWS = {
    "po": """SELECT o_custkey AS pid, CAST(floor(o_custkey / 3) AS BIGINT) AS hid, CAST(year(o_orderdate) AS INT) + 10 AS year,
        sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM {orders} GROUP BY 1, 2, 3""",
    "py": """SELECT pid, hid, year,
        CASE WHEN pid % 19 = 0 THEN CAST(-2 AS DOUBLE) ELSE CAST(total AS DOUBLE) END AS income,
        CAST(total AS DOUBLE) * CAST(1.25 AS DOUBLE) AS GrossIncome,
        18 + pid % 60 + (year - 2005) AS age,
        CASE WHEN pid % 23 = 0 THEN -1 ELSE 7 + pid % 12 END AS education,
        1 + hid % 5 AS Npersons, 1 + pid % 2 AS sex, 1 + pid % 3 AS head,
        CASE WHEN hid % 17 = 0 THEN -1 ELSE 1 + hid % 5 END AS owner,
        CASE WHEN hid % 5 = 0 AND year >= 2008 THEN 2008 ELSE 2000 + hid % 4 END AS YearMoved,
        CASE WHEN pid % 29 = 0 THEN -2 WHEN (pid + year) % 13 = 0 THEN 1 ELSE 2 END AS pv,
        1 + hid % 2 AS garden, 1 + (hid % 3) % 2 AS elevator,
        CASE hid % 6 WHEN 0 THEN 'Farm House' WHEN 1 THEN 'Flats in block' WHEN 2 THEN 'Terraced House'
            WHEN 3 THEN 'NA' WHEN 4 THEN 'Flat 9+' END AS LodgeEnglish,
        CASE WHEN hid % 7 = 0 THEN NULL WHEN pid % 11 = 0 THEN -2 ELSE 40 + hid % 50 + (year - 2005) END AS PowerCosts
        FROM {po}""",
    "cw": "SELECT CAST(floor(o_custkey / 3) AS BIGINT) AS hid, "
    + _cw
    + " FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1",
    "cb": """SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS hid, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS c_acctbal,
        CAST(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM {customer} GROUP BY 1""",
    "ww": "SELECT hid, syear, "
    + _ww
    + " FROM (SELECT hid, balance, 2007 AS syear FROM {cb} UNION ALL SELECT hid, balance, 2012 FROM {cb}"
    " UNION ALL SELECT hid, balance, 2017 FROM {cb}) AS c",
    "hw": """SELECT hid, year, income, age, education,
        2 * income + 1000 * age + 10 * c_acctbal AS GrossWealth, 4 * abs(c_acctbal) AS GrossDebts,
        2 * income + 1000 * age + 10 * c_acctbal - 4 * abs(c_acctbal) AS NetWealth,
        CAST(0.2 AS DOUBLE) * income AS financial, abs(c_acctbal) AS tangible,
        CASE WHEN hid % 10 = 0 THEN income ELSE CAST(0 AS DOUBLE) END AS business, income AS HouseNet
        FROM (SELECT p.hid, p.year, CAST(sum(o.total) AS DOUBLE) * CAST(1.25 AS DOUBLE) / count(*) AS income,
            max(p.age) AS age, max(p.education) AS education
            FROM {py} AS p JOIN {po} AS o ON p.pid = o.pid AND p.year = o.year GROUP BY 1, 2) AS h
        LEFT JOIN {cb} AS b USING (hid)""",
    "hs": """SELECT c_custkey AS hid, 'base' AS run, CAST(2018 + c_custkey % 5 AS INT) AS year,
        20000 + 5 * abs(c_acctbal) AS income, CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (c_custkey % 10) AS incomesd,
        CAST(1500 + 100 * (c_custkey % 60) AS DOUBLE) AS powercons,
        CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE CAST(0 AS DOUBLE) END AS liquidity,
        CAST(0.005 AS DOUBLE) * (c_custkey % 4) AS trend, CAST(0.02 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (c_custkey % 8) AS discount,
        CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS house, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS pv,
        CASE WHEN c_custkey % 10 = 0 THEN CAST(floor(c_custkey / 10) AS BIGINT) % 22 ELSE 0 END AS panelage,
        c_custkey % 4 AS attitude,
        CASE WHEN c_custkey % 20 = 0 THEN CAST(1000 + 100 * (c_custkey % 50) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS debt,
        CASE WHEN c_custkey % 20 = 0 THEN CAST(0.03 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS loanrate,
        CASE WHEN c_custkey % 20 = 0 THEN CAST(150 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS debtservice
        FROM {customer}""",
    "ps": """SELECT p_brand AS series, CAST(12 * (year(l_shipdate) - 1995) + month(l_shipdate) AS INT) AS t,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS price
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "lk_percentile": _values([(p, 95, 10) for p in range(100)], "percentile, a, b"),
    "lk_year": _values([(y,) for y in range(2000, 2020)], "year"),
    "lk_codebook": _values(CONSUMPTION_CODEBOOK, "code, concept, grp"),
    "lk_wealthbook": _values(WEALTH_CODEBOOK, "var, VarText"),
    "lk_scenario": _values(
        [
            ("base", 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0),
            ("credit", 0, 0, 0, 1, 0.0, 0.0, 0.0, 0.02),
            ("subsidy", 1, 0, 0, 0, 0.2, 0.0, 0.0, 0.0),
            ("topup", 0, 1, 0, 0, 0.0, 0.02, 0.0, 0.0),
        ],
        "scenario, subsidy1, subsidy2, credit1, credit2, s1, s2, cp1, cp2",
    ),
}
VIEWS["lk_percentile"] = (
    "SELECT percentile, CAST(0.95 AS DOUBLE) - CAST(0.004 AS DOUBLE) * percentile AS propensity, "
    "CAST(0.10 AS DOUBLE) + CAST(0.002 AS DOUBLE) * percentile AS liquidshare FROM ("
    + _values([(p,) for p in range(100)], "percentile")
    + ") AS p"
)
VIEWS["lk_year"] = (
    "SELECT year, CAST(0.50 AS DOUBLE) - CAST(0.02 AS DOUBLE) * (year - 2000) AS tariff, "
    "CAST(30000 - 1100 * (year - 2000) AS DOUBLE) AS cost, CAST(0.02 AS DOUBLE) AS baserate FROM ("
    + _values([(y,) for y in range(2000, 2020)], "year")
    + ") AS y"
)


def long_sql(view: str, ids: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS var, {c} AS value FROM {view}" for c in columns)


# Long forms used by many reference queries; only DuckDB reads these.
VIEWS["cwl"] = long_sql("{cw}", "hid", _IMPUTED)
VIEWS["wwl"] = long_sql("{ww}", "hid, syear AS year", WW_COLUMNS)

# Statements shared by several reference queries, in order of use.
SPELL = "pid, hid, YearMoved"
VIEWS["dec"] = "SELECT *, ntile(10) OVER (ORDER BY income, hid, year) AS decile FROM {hw}"
VIEWS["pyc"] = """SELECT pid, hid, year, YearMoved, sex, head, age, Npersons, LodgeEnglish,
    CASE WHEN income >= 0 THEN income END AS income, GrossIncome,
    CASE WHEN education >= 0 THEN education END AS education, CASE WHEN owner >= 0 THEN owner END AS owner,
    CASE WHEN pv = 2 THEN 0 WHEN pv >= 0 THEN pv END AS pv, CASE WHEN garden = 2 THEN 0 ELSE garden END AS garden,
    CASE WHEN elevator = 2 THEN 0 ELSE elevator END AS elevator,
    CASE WHEN PowerCosts >= 0 THEN PowerCosts END AS PowerCosts FROM {py}"""


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def _closure(names: list[str]) -> list[str]:
    """Views in an order in which each follows those it reads."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for other in _needs(VIEWS[name]):
                add(other)
            out.append(name)

    for n in names:
        add(n)
    return out


def ctes(body: str) -> str:
    """WITH-list of the views a statement reads."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)] or ["lk_year"]
    parts = []
    for name in _closure(used):
        text = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{n: n for n in _needs(text)})})")
    return ", ".join(parts)


_snapshots: dict[tuple[str, str, str], DataFrame] = {}


def snapshot(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage written once per application; later stages read it whole, as in a survey pipeline
    whose steps hand over files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _snapshots:
        _snapshots[key] = materialize(build(), name)
    return _snapshots[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a raw table) as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in dict.fromkeys(_needs(text))}
    return snapshot(spark, sf_dir, name, lambda: spark.sql(text, **inputs))


def codebook(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSUMPTION_CODEBOOK, "code string, concept string, group string")


def wealth_codebook(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEALTH_CODEBOOK, "var string, VarText string")


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households with the columns a running model adds: tariff, profit so far, adopted."""
    return view(spark, sf_dir, "hs").withColumns({"adopted": F.col("pv"), "profit": F.lit(0.0)})
