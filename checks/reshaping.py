"""Reshapes and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.cleaning import consumption_long
from checks.framework import Check
from checks.views import START, codebook, households, view
from hearthpanel.operators import clean, hot_joins, joins, reshape
from hearthpanel.operators.ranking import position_groups

CW_LONG = "SELECT * FROM cwl"


def wealth_parts(s, d):
    """Mean per wealth variable as one table per family."""
    long = clean.split_imputation(
        clean.code_to_null(reshape.wide_to_long(view(s, d, "ww"), ["hid", "syear"]), "value", -8.0)
    )
    return [long.filter(F.col("var") == v).select("hid", "syear", "var", "imp", "value") for v in views.FAMILIES]


QUANTITY_LEVELS = """SELECT l_returnflag, CAST(floor(l_quantity / 10) AS BIGINT) AS level, max(l_extendedprice) AS dearest
    FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL"""


def quantity_levels(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag <> 'A'")
    level = F.floor(F.col("l_quantity") / 10).cast("long").alias("level")
    return lines.groupBy("l_returnflag", level).agg(F.max("l_extendedprice").alias("dearest"))


def two_specs(s, d):
    hw = view(s, d, "hw")
    return [hw.select("hid", "year", F.col("income").alias("value")), hw.select("hid", "year", F.col("age").cast("double").alias("value"))]


def person_tables(s, d):
    """Person, household and lodge table that join back to the person-year view."""
    py = view(s, d, "py")
    person = py.select(
        "pid", "hid", "year", "income", "GrossIncome", "age", "education", "Npersons", "sex", "head", "pv", "PowerCosts"
    )
    household = py.select("hid", "year", "owner", "YearMoved", "garden", "elevator").distinct()
    lodge = py.select("hid", "year", "LodgeEnglish").distinct()
    return [person, household, lodge]


def decile_rates(s, d):
    hs = position_groups(view(s, d, "hs"), "income", 10, name="decile")
    return hs, hs.groupBy("decile").agg(F.avg("pv").alias("share"))


def decile_columns(s, d):
    """Ownership share per year with one column per decile 1..10."""
    hs = view(s, d, "hs").withColumn("decile", F.col("hid") % 10 + 1)
    rates = hs.groupBy("year", "decile").agg(F.avg(F.col("house").cast("double")).alias("rate"))
    return reshape.long_to_wide(rates, ["year"], "decile", "rate", [str(i) for i in range(1, 11)])


# Income decile by position, as in position_groups.
POSITION = """SELECT *, CAST((SELECT sum((h.income > cut)::INT) FROM (SELECT unnest(list_transform(range(1, 10),
    lambda i: sorted[CAST(round_even(i * (n + 1) / 10.0 - 1, 0) AS BIGINT) + 1])) AS cut FROM
    (SELECT list(income ORDER BY income) AS sorted, count(*) AS n FROM hs))) AS INT) AS decile FROM hs AS h"""

CHECKS = [
    Check("wide_to_long", "hid:i var:s value:r4", consumption_long, CW_LONG),
    Check(
        "long_to_wide",
        "hid:i consum1b:r4 consum2b:r4 oheat_c:r4",
        lambda s, d: reshape.long_to_wide(consumption_long(s, d), ["hid"], "var", "value", ["consum1b", "consum2b", "oheat_c"]),
        "SELECT hid, consum1b, consum2b, oheat_c FROM cw",
    ),
    Check(
        "metrics_to_facets",
        "hid:i year:i type:s value:r4",
        lambda s, d: clean.recode_labels(
            reshape.metrics_to_facets(
                view(s, d, "hw").withColumn("share", F.col("GrossDebts") / F.col("GrossWealth") * 100).withColumn("value", F.col("GrossDebts") / 1000),
                ["hid", "year"], ["value", "share"],
            ),
            "type", {"value": "a) Value in Ths. Euros", "share": "b) Percentage of Net Wealth"},
        ),
        """SELECT hid, year, 'a) Value in Ths. Euros' AS type, GrossDebts / 1000 AS value FROM hw
            UNION ALL SELECT hid, year, 'b) Percentage of Net Wealth', GrossDebts / GrossWealth * 100 FROM hw""",
    ),
    Check(
        "stack_with_id",
        "spec:i hid:i year:i value:r2",
        lambda s, d: reshape.stack_with_id(two_specs(s, d)),
        "SELECT 1 AS spec, hid, year, income AS value FROM hw UNION ALL SELECT 2, hid, year, age FROM hw",
    ),
    Check(
        "stack_families",
        "hid:i syear:i var:s imp:s value:r2",
        lambda s, d: reshape.stack_families(wealth_parts(s, d)),
        "SELECT hid, year AS syear, left(var, 5) AS var, right(var, 1) AS imp, nullif(value, -8) AS value FROM wwl",
    ),
    Check(
        "bind_columns_by_key",
        "hid:i year:i income:r2 other:r2",
        lambda s, d: reshape.bind_columns_by_key(
            two_specs(s, d)[0].withColumnRenamed("value", "income"), two_specs(s, d)[1].withColumnRenamed("value", "other"), ["hid", "year"]
        ),
        "SELECT hid, year, income, age AS other FROM hw",
    ),
    Check(
        "year_columns_to_rows",
        "year:i decile:i value:r4",
        lambda s, d: reshape.year_columns_to_rows(decile_columns(s, d), ["year"], [str(i) for i in range(1, 11)]),
        """SELECT y.year, k.decile, (SELECT avg(house) FROM hs WHERE hs.year = y.year AND hs.hid % 10 + 1 = k.decile) AS value
            FROM (SELECT DISTINCT year FROM hs) AS y, (SELECT unnest(range(1, 11)) AS decile) AS k""",
    ),
    Check(
        "natural_left_join",
        "pid:i hid:i year:i age:i w001ha:r2",
        # The wealth questions were asked in a few years only.
        lambda s, d: joins.natural_left_join(
            view(s, d, "py").select("pid", "hid", "year", "age"), view(s, d, "ww").select("hid", F.col("syear").alias("year"), "w001ha")
        ),
        "SELECT pid, py.hid, py.year, py.age, w001ha FROM py LEFT JOIN ww ON py.hid = ww.hid AND py.year = ww.syear",
    ),
    Check(
        "chain_left_join",
        "pid:i hid:i year:i income:r2 owner:i YearMoved:i LodgeEnglish:s",
        lambda s, d: joins.chain_left_join(person_tables(s, d)),
        "SELECT * FROM py",
    ),
    Check(
        "split_hot_join",
        "l_orderkey:i l_linenumber:i l_returnflag:s level:i dearest:r2",
        # Three return flags hold all order lines, one of them half; one has no levels.
        lambda s, d: hot_joins.split_join(
            s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag"),
            quantity_levels(s, d), ["l_returnflag"], cell_rows=1_000,
        ),
        f"""SELECT l_orderkey, l_linenumber, l.l_returnflag, level, dearest FROM lineitem AS l
            LEFT JOIN ({QUANTITY_LEVELS}) AS q ON l.l_returnflag IS NOT DISTINCT FROM q.l_returnflag""",
    ),
    Check(
        "codebook_join",
        "hid:i var:s code:s concept:s group:s value:r4",
        lambda s, d: joins.codebook_join(clean.concept_code(consumption_long(s, d)), codebook(s), "code"),
        """SELECT hid, var, code, concept, grp AS "group", value FROM (SELECT *, CASE WHEN var LIKE 'consum%' THEN substr(var, 7, 1)
            ELSE left(var, 5) END AS code FROM cwl) LEFT JOIN lk_codebook USING (code)""",
    ),
    Check(
        "first_event_join",
        "pid:i year:i YearMoved:i first_year:i",
        lambda s, d: joins.first_event_join(view(s, d, "py"), ["pid", "hid", "YearMoved"], "pv"),
        """SELECT pid, year, YearMoved, min(CASE WHEN pv = 1 THEN year END) OVER (PARTITION BY pid, hid, YearMoved) AS first_year FROM py""",
    ),
    Check(
        "broadcast_scalars",
        "hid:i year:i income:r2 mean_income:r2 families:i",
        lambda s, d: joins.broadcast_scalars(
            view(s, d, "hw"), view(s, d, "hw").agg(F.avg("income").alias("mean_income"), F.countDistinct("hid").alias("families"))
        ),
        """SELECT hid, year, income, (SELECT avg(income) FROM hw) AS mean_income,
            (SELECT count(DISTINCT hid) FROM hw) AS families FROM hw""",
    ),
    Check(
        "percentile_lookup_join",
        "hid:i percentile:i share:r4",
        lambda s, d: joins.percentile_lookup_join(
            position_groups(view(s, d, "hs"), "income", 100, name="percentile"), view(s, d, "lk_percentile"), value="propensity"
        ),
        """SELECT hid, p.percentile, 0.95 - 0.004 * p.percentile AS share FROM (""" + POSITION.replace("range(1, 10)", "range(1, 100)")
        .replace("/ 10.0", "/ 100.0").replace("AS decile", "AS percentile") + ") AS p",
    ),
    Check(
        "year_lookup_earliest_fallback",
        "hid:i panelage:i tariff:r4",
        lambda s, d: joins.year_lookup_earliest_fallback(
            view(s, d, "hs"), view(s, d, "lk_year"), START - F.col("panelage") - 1, "tariff", value="tariff"
        ),
        "SELECT hid, panelage, CASE WHEN panelage <= 18 THEN 0.5 - 0.02 * (18 - panelage) ELSE 0.5 END AS tariff FROM hs",
    ),
    Check(
        "peer_rate_join",
        "hid:i decile:i peer_share:r4",
        lambda s, d: joins.peer_rate_join(*decile_rates(s, d)),
        f"SELECT hid, decile, avg(pv) OVER (PARTITION BY decile) AS peer_share FROM ({POSITION})",
    ),
]
