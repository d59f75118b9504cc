"""Null rules and other traps of the cleaning steps on tiny tables."""

from pyspark.sql import functions as F

from hearthpanel.operators import aggregates, clean, reshape
from hearthpanel.plans import jobs


def test_missing_codes(spark, rows):
    df = spark.createDataFrame([(-2, -8.0, "NA"), (0, 1.0, "x"), (None, None, None)], "a int, b double, c string")
    out = clean.text_null_token(clean.code_to_null(clean.negatives_to_null(df, ["a"]), "b", -8.0), "c")
    assert rows(out) == [(None, None, None), (None, None, None), (0, 1.0, "x")]


def test_yes_no_keeps_other_codes(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,), (-1,)], "a int")
    assert rows(clean.yes_no_to_binary(df, ["a"])) == [(None,), (-1,), (0,), (1,)]


def test_pattern_null_before_default(spark, rows):
    df = spark.createDataFrame([("Flat 9+",), ("Farm",), (None,)], "l string")
    out = clean.classify_by_pattern(df, "l", {"Flats": "Flats|Flat"}, "House", "k")
    assert rows(out) == [(None, None), ("Farm", "House"), ("Flat 9+", "Flats")]


def test_rules_in_order(spark, rows):
    df = spark.createDataFrame([("x", 1, 1), (None, 1, 1), (None, 0, 1), (None, None, 0)], "l string, g int, e int")
    out = clean.rule_impute(df, "l", [(F.col("g") == 1, "House"), (F.col("e") == 1, "Flat")])
    assert rows(out, "l") == [(None,), ("Flat",), ("House",), ("x",)]


def test_names(spark, rows):
    df = spark.createDataFrame([("consum1b",), ("consum17e",), ("oheat_b",), ("reletr_c",)], "var string")
    assert rows(clean.concept_code(df), "code") == [("1",), ("17",), ("oheat",), ("reletr",)]
    assert [jobs._code(v) for v in ("consum1b", "consum17e", "oheat_b", "reletr_c")] == ["1", "17", "oheat", "reletr"]
    stats = spark.createDataFrame([("(Intercept)_est",), ("age_se",)], "var string")
    assert rows(clean.split_stat_name(stats, "var"), "term", "stat") == [("Intercept", "est"), ("age", "se")]


def test_interval_labels(spark, rows):
    df = spark.createDataFrame([("[ 500,900)",), ("[5e3,1.5]",), ("rest",)], "a string")
    assert rows(clean.parse_interval_label(df, "a"), "LowAmt", "HighAmt") == [(None, None), (500.0, 900.0), (5000.0, 1.5)]


def test_clamp_and_infinite_keep_null(spark, rows):
    df = spark.createDataFrame([(None,), (-5.0,), (float("inf"),), (3.0,)], "v double")
    assert rows(clean.clamp(df, "v", 0.0, 10.0)) == [(None,), (0.0,), (10.0,), (3.0,)]
    assert rows(clean.infinite_to_null(df, ["v"])) == [(None,), (None,), (-5.0,), (3.0,)]


def test_row_total_needs_every_value(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, None)], "id int, a double, b double")
    assert rows(clean.row_total(df, ["id"]), "id", "total") == [(1, 3.0), (2, None)]


def test_half_even(spark, rows):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "v double")
    assert rows(clean.round_half_even(df, ["v"])) == [(-2.0,), (0.0,), (2.0,), (2.0,)]


def test_unknown_owner_is_a_renter(spark, rows):
    data = [(o, v) for o in (1, 2, None) for v in ("rheat_b", "oheat_b", "consum1b")]
    df = spark.createDataFrame(data, "owner int, var string")
    kept = rows(clean.owner_renter_rows(df))
    assert kept == [(None, "consum1b"), (None, "rheat_b"), (1, "consum1b"), (1, "oheat_b"), (2, "consum1b"), (2, "rheat_b")]


def test_means_over_imputations(spark, rows):
    wide = spark.createDataFrame([(1, 1.0, 3.0, 5.0), (1, None, 5.0, 7.0), (2, None, None, 1.0)], "hid int, xa double, xb double, ya double")
    long = reshape.wide_to_long(wide, ["hid"]).withColumn("var", F.substring("var", 1, 1))
    for skip in (True, False):
        melted = aggregates.mean_over_imputations(long, ["hid", "var"], skip_null=skip)
        spread = reshape.long_to_wide(melted, ["hid"], "var", "value", ["x", "y"])
        placed = aggregates.mean_over_imputation_columns(wide, ["hid"], {"x": ["xa", "xb"], "y": ["ya"]}, skip_null=skip)
        assert rows(spread) == rows(placed)
    assert rows(placed) == [(1, None, 6.0), (2, None, 1.0)]


def test_sum_of_nothing_is_zero(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 2.0), (2, None)], "k int, value double")
    assert rows(aggregates.sum_null_as_zero(df, ["k"])) == [(1, 0.0), (2, 2.0)]


def test_first_non_null(spark, rows):
    df = spark.createDataFrame([(1, 2006, "b"), (1, 2005, None), (1, 2007, "a"), (2, 2005, None)], "k int, year int, v string")
    assert rows(aggregates.first_non_null(df, ["k"], "v", ["year"]).distinct(), "k", "year", "v") == [
        (1, 2005, "b"), (1, 2006, "b"), (1, 2007, "b"), (2, 2005, None)
    ]


def test_rates_and_guards(spark, rows):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", None, 0.0), ("b", None, 2.0)], "k string, f int, v double")
    assert rows(aggregates.rate_by_group(df, ["k"], "f")) == [("a", 2, 1, 50.0), ("b", 1, 0, 0.0)]
    assert rows(aggregates.mean_positive_only(df, ["k"], "v", "m")) == [("a", 0.0), ("b", 2.0)]
    assert rows(aggregates.guarded_share(df, ["k"], "f", "v", "s")) == [("a", 0.0), ("b", None)]


def test_ratio_drops_non_positive(spark, rows):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (1.0, -1.0), (1.0, None)], "a double, b double")
    assert rows(clean.ratio_percent(df, "a", "b", "s")) == [(1.0, 4.0, 25.0)]


def test_two_level_share_tells_means_apart(spark, rows):
    data = [(1, "g", "x", 1.0, 10.0), (1, "g", "x", 3.0, 10.0), (1, "g", "y", 5.0, 10.0), (1, "h", "z", 4.0, 20.0)]
    df = spark.createDataFrame(data, "decile int, grp string, var string, value double, income double")
    assert rows(aggregates.two_level_mean_share(df, ["decile", "grp"])) == [(1, "g", 10.0, 7.0, 70.0), (1, "h", 20.0, 4.0, 20.0)]


def test_harmonise(spark, rows):
    columns = "pid int, hid int, year int, income double, GrossIncome double, age int, education int, Npersons int, sex int, " \
              "head int, owner int, YearMoved int, pv int, garden int, elevator int, LodgeEnglish string, PowerCosts int"
    base = dict(income=2000.0, GrossIncome=-1.0, age=30, education=10, Npersons=2, sex=1, head=1, YearMoved=2000, garden=2, elevator=2, PowerCosts=40)
    def row(pid, year, owner, pv, lodge, **other):
        r = {**base, **other, "pid": pid, "hid": 1, "year": year, "owner": owner, "pv": pv, "LodgeEnglish": lodge}
        return tuple(r[c.split()[0]] for c in columns.split(", "))
    df = spark.createDataFrame(
        [row(1, 2005, -1, 2, "NA"), row(1, 2006, 3, 1, "Flat 9+"), row(1, 2007, 1, 2, None, elevator=1), row(2, 2005, 1, -2, "Farm")], columns
    )
    got = rows(jobs.harmonise(df), "pid", "year", "owner", "lodge", "PanelYear", "pv", "income", "GrossIncome")
    # Person 2 never has a known flag and drops out; owner and dwelling type fill the whole spell.
    assert got == [(1, y, 0, "Flats", 2006, 1, 2.0, None) for y in (2005, 2006, 2007)]
