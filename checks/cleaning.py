"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.framework import Check
from checks.views import view
from hearthpanel.operators import clean
from hearthpanel.operators.panel import fixed_bands
from hearthpanel.operators.reshape import wide_to_long

HEAD = {1: "Head", 2: "Partner", 3: "Child", 4: "Relative", 5: "Nonrelative"}
BANDS = [0, 50000, 100000, 150000, 200000, 300000, 400000]
IMPUTED = ["consum", "oheat", "rheat"]


def consumption_long(s, d):
    cw = clean.select_name_contains(view(s, d, "cw"), ["f", "_a"], negate=True)
    return wide_to_long(cw, ["hid"])


def with_owner(s, d):
    """Long consumption with the household's ownership code."""
    owner = view(s, d, "py").groupBy("hid").agg(F.max("owner").alias("owner"))
    return consumption_long(s, d).join(owner, "hid", "left")


CHECKS = [
    Check(
        "filter_year_range",
        "pid:i year:i income:r2",
        lambda s, d: clean.filter_year_range(view(s, d, "py"), 2007, 2010),
        "SELECT * FROM py WHERE year BETWEEN 2007 AND 2010",
    ),
    Check(
        "filter_year_in",
        "hid:i syear:i w010ha:r2",
        lambda s, d: clean.filter_year_in(view(s, d, "ww"), [2002, 2007, 2017], "syear"),
        "SELECT * FROM ww WHERE syear IN (2002, 2007, 2017)",
    ),
    Check(
        "select_name_contains",
        "hid:i syear:i w010ha:r2 w010hb:r2 w001ha:r2 w001hb:r2",
        lambda s, d: clean.select_name_contains(view(s, d, "ww"), ["W010", "w001"], keep=["hid", "syear"]),
        "SELECT hid, syear, w010ha, w010hb, w001ha, w001hb FROM ww",
    ),
    Check(
        "drop_columns",
        "pid:i year:i hid:i income:r2",
        lambda s, d: clean.drop_columns(
            view(s, d, "py"),
            ["GrossIncome", "age", "education", "Npersons", "sex", "head", "owner", "YearMoved", "pv", "garden",
             "elevator", "LodgeEnglish", "PowerCosts"],
        ),
        "SELECT pid, year, hid, income FROM py",
    ),
    Check(
        "scale_units",
        "hid:i var:s value:r4",
        lambda s, d: clean.scale_units(consumption_long(s, d), "value", 1 / 12, "var", "oheat|oelectr|outil"),
        "SELECT hid, var, CASE WHEN var LIKE 'oheat%' THEN value / 12 ELSE value END AS value FROM cwl",
    ),
    Check(
        "negatives_to_null",
        "pid:i year:i income:r2 education:i PowerCosts:i",
        lambda s, d: clean.negatives_to_null(view(s, d, "py"), ["income", "education", "PowerCosts"]),
        """SELECT pid, year, CASE WHEN income < 0 THEN NULL ELSE income END AS income,
            CASE WHEN education < 0 THEN NULL ELSE education END AS education,
            CASE WHEN PowerCosts < 0 THEN NULL ELSE PowerCosts END AS PowerCosts FROM py""",
    ),
    Check(
        "code_to_null",
        "hid:i syear:i w010ha:r2",
        lambda s, d: clean.code_to_null(view(s, d, "ww"), "w010ha", -8.0),
        "SELECT hid, syear, nullif(w010ha, -8) AS w010ha FROM ww",
    ),
    Check(
        "yes_no_to_binary",
        "pid:i year:i pv:i garden:i elevator:i",
        lambda s, d: clean.yes_no_to_binary(view(s, d, "py"), ["pv", "garden", "elevator"]),
        """SELECT pid, year, if(pv = 2, 0, pv) AS pv, if(garden = 2, 0, garden) AS garden,
            if(elevator = 2, 0, elevator) AS elevator FROM py""",
    ),
    Check(
        "collapse_categories",
        "pid:i year:i owner:i",
        lambda s, d: clean.collapse_categories(view(s, d, "py"), "owner", [2, 3, 4, 5], 0),
        "SELECT pid, year, CASE WHEN owner BETWEEN 2 AND 5 THEN 0 ELSE owner END AS owner FROM py",
    ),
    Check(
        "classify_by_pattern",
        "pid:i year:i lodge:s",
        lambda s, d: clean.classify_by_pattern(view(s, d, "py"), "LodgeEnglish", {"Flats": "Flats|Flat"}, "House", "lodge"),
        """SELECT pid, year, CASE WHEN LodgeEnglish IS NULL THEN NULL WHEN contains(LodgeEnglish, 'Flat') THEN 'Flats'
            ELSE 'House' END AS lodge FROM py""",
    ),
    Check(
        "recode_labels",
        "hid:i year:i var:s value:r2",
        lambda s, d: clean.recode_labels(
            wide_to_long(view(s, d, "hw"), ["hid", "year"], ["tangible", "business", "HouseNet", "NetWealth"]),
            "var", {"tangible": "Tangible", "business": "Business", "HouseNet": "Main Property"},
        ),
        """SELECT hid, year, 'Tangible' AS var, tangible AS value FROM hw UNION ALL SELECT hid, year, 'Business', business FROM hw
            UNION ALL SELECT hid, year, 'Main Property', HouseNet FROM hw UNION ALL SELECT hid, year, 'NetWealth', NetWealth FROM hw""",
    ),
    Check(
        "rename_in_select",
        "hid:i gross:r2 debt:r2",
        lambda s, d: clean.rename_in_select(view(s, d, "hw"), {"hid": "hid", "GrossWealth": "gross", "GrossDebts": "debt"}),
        "SELECT hid, GrossWealth AS gross, GrossDebts AS debt FROM hw",
    ),
    Check(
        "value_labels",
        "pid:i year:i head:i label:s",
        lambda s, d: clean.value_labels(view(s, d, "py"), "head", HEAD, "label"),
        """SELECT pid, year, head, CASE head WHEN 1 THEN 'Head' WHEN 2 THEN 'Partner' WHEN 3 THEN 'Child'
            WHEN 4 THEN 'Relative' WHEN 5 THEN 'Nonrelative' END AS label FROM py""",
    ),
    Check(
        "text_null_token",
        "pid:i year:i LodgeEnglish:s",
        lambda s, d: clean.text_null_token(view(s, d, "py"), "LodgeEnglish"),
        "SELECT pid, year, nullif(LodgeEnglish, 'NA') AS LodgeEnglish FROM py",
    ),
    Check(
        "rule_impute",
        "pid:i year:i LodgeEnglish:s",
        lambda s, d: clean.rule_impute(
            view(s, d, "py"), "LodgeEnglish", [(F.col("garden") == 1, "House"), (F.col("elevator") == 1, "Flat")]
        ),
        """SELECT pid, year, CASE WHEN LodgeEnglish IS NOT NULL THEN LodgeEnglish WHEN garden = 1 THEN 'House'
            WHEN elevator = 1 THEN 'Flat' END AS LodgeEnglish FROM py""",
    ),
    Check(
        "infinite_to_null",
        "pid:i year:i rate:r4",
        lambda s, d: clean.infinite_to_null(
            view(s, d, "py").withColumn("rate", F.when(F.col("pv") == 1, F.lit(float("-inf"))).otherwise(F.col("income"))), ["rate"]
        ),
        "SELECT pid, year, CASE WHEN pv = 1 THEN NULL ELSE income END AS rate FROM py",
    ),
    Check(
        "parse_variable_name",
        "hid:i name:s code:s imp:s",
        lambda s, d: clean.concept_code(consumption_long(s, d)).select("hid", F.col("var").alias("name"), "code", F.lit(None).alias("imp"))
        .unionByName(
            clean.split_imputation(wide_to_long(view(s, d, "ww"), ["hid", "syear"]), "var")
            .select("hid", F.concat("var", "imp").alias("name"), F.col("var").alias("code"), "imp")
        ),
        """SELECT hid, var AS name, CASE WHEN var LIKE 'consum%' THEN substr(var, 7, 1) ELSE split_part(var, '_', 1) END AS code,
            CAST(NULL AS VARCHAR) AS imp FROM cwl UNION ALL SELECT hid, var, left(var, 5), right(var, 1) FROM wwl""",
    ),
    Check(
        "parse_interval_label",
        "pid:i year:i band:i LowAmt:r2 HighAmt:r2",
        lambda s, d: clean.parse_interval_label(fixed_bands(view(s, d, "py"), "GrossIncome", BANDS, label="amt"), "amt"),
        """SELECT pid, year, band, list_extract([0, 50000, 100000, 150000, 200000, 300000, 400000], band) AS LowAmt,
            list_extract([50000, 100000, 150000, 200000, 300000, 400000, top], band) AS HighAmt FROM (
            SELECT pid, year, (SELECT max(GrossIncome) FROM py) AS top,
            1 + (GrossIncome >= 50000)::INT + (GrossIncome >= 100000)::INT + (GrossIncome >= 150000)::INT
            + (GrossIncome >= 200000)::INT + (GrossIncome >= 300000)::INT + (GrossIncome >= 400000)::INT AS band FROM py)""",
    ),
    Check(
        "split_stat_name",
        "hid:i year:i term:s stat:s value:r2",
        lambda s, d: clean.split_stat_name(
            wide_to_long(
                view(s, d, "hw").withColumnsRenamed({"income": "(Intercept)_est", "GrossWealth": "income_se"}),
                ["hid", "year"], ["(Intercept)_est", "income_se"],
            ),
            "var",
        ),
        """SELECT hid, year, 'Intercept' AS term, 'est' AS stat, income AS value FROM hw
            UNION ALL SELECT hid, year, 'income', 'se', GrossWealth FROM hw""",
    ),
    Check(
        "row_total",
        "hid:i total:r4",
        lambda s, d: clean.row_total(view(s, d, "cw").select("hid", *[f"consum{k}b" for k in range(1, 6)]), ["hid"]),
        "SELECT hid, consum1b + consum2b + consum3b + consum4b + consum5b AS total FROM cw",
    ),
    Check(
        "round_half_even",
        "pid:i year:i half:i",
        lambda s, d: clean.round_half_even(view(s, d, "py").withColumn("half", F.col("age") / 2), ["half"]),
        "SELECT pid, year, round_even(age / 2.0, 0) AS half FROM py",
    ),
    Check(
        "percent_label",
        "hid:i label:s",
        lambda s, d: clean.percent_label(
            view(s, d, "cw").withColumn("part", F.col("consum1b") / F.col("consum1_a") * 10000 + F.lit(0.0037)), "part"
        ),
        "SELECT hid, format('{:.1f}', round(consum1b / consum1_a * 10000 + 0.0037::DOUBLE, 1)) || '%' AS label FROM cw",
    ),
    Check(
        "log_column",
        "hid:i var:s logged:r6",
        lambda s, d: clean.log_column(consumption_long(s, d), "value", "logged"),
        "SELECT hid, var, CASE WHEN value > 0 THEN ln(value) END AS logged FROM cwl",
    ),
    Check(
        "clamp",
        "hid:i income:r4",
        lambda s, d: clean.clamp(view(s, d, "hs"), "income", 25000.0, 50000.0),
        "SELECT hid, CASE WHEN income < 25000 THEN 25000 WHEN income > 50000 THEN 50000 ELSE income END AS income FROM hs",
    ),
    Check(
        "drop_null_rows",
        "pid:i year:i PowerCosts:i LodgeEnglish:s",
        lambda s, d: clean.drop_null_rows(view(s, d, "py"), ["PowerCosts", "LodgeEnglish"]),
        "SELECT * FROM py WHERE PowerCosts IS NOT NULL AND LodgeEnglish IS NOT NULL",
    ),
    Check(
        "owner_renter_rows",
        "hid:i var:s owner:i value:r4",
        lambda s, d: clean.owner_renter_rows(with_owner(s, d), owner_only="oheat|oeletr", renter_only="rheat|reletr"),
        """SELECT hid, var, owner, value FROM cwl LEFT JOIN (SELECT hid, max(owner) AS owner FROM py GROUP BY hid) USING (hid)
            WHERE (owner = 1 AND var NOT LIKE 'rheat%') OR (owner IS DISTINCT FROM 1 AND var NOT LIKE 'oheat%')""",
    ),
    Check(
        "ratio_percent",
        "hid:i share:r4",
        lambda s, d: clean.ratio_percent(view(s, d, "cw"), "consum1b", "consum2b", "share"),
        "SELECT hid, consum1b / consum2b * 100 AS share FROM cw WHERE consum2b > 0",
    ),
    Check(
        "select_column_range",
        "hid:i GrossWealth:r2 GrossDebts:r2 NetWealth:r2 financial:r2",
        lambda s, d: clean.select_column_range(view(s, d, "hw"), "GrossWealth", "financial", ["hid"]),
        "SELECT hid, GrossWealth, GrossDebts, NetWealth, financial FROM hw",
    ),
    Check(
        "cast_numeric",
        "pid:i year:i age:r2 LodgeEnglish:r2",
        lambda s, d: clean.cast_numeric(
            view(s, d, "py").withColumn("age", F.col("age").cast("string")), ["age", "LodgeEnglish"]
        ),
        "SELECT pid, year, age, TRY_CAST(LodgeEnglish AS DOUBLE) AS LodgeEnglish FROM py",
    ),
]
