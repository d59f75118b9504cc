"""Ranks and quantiles against brute force, with ties, nulls, hot values and any partitioning."""

import random

import numpy as np
import pytest

from hearthpanel.operators import ranking
from hearthpanel.operators.panel import fixed_bands, order_groups_by_median
from hearthpanel.operators.aggregates import quantile_trim

GROUPS = ["a", "b", None]


@pytest.fixture(scope="module")
def data():
    """A third of all rows hold one value, some none, one group is much larger than the others."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "a" if rng.random() < 0.8 else rng.choice(GROUPS)
        value = 7.0 if rng.random() < 0.34 else None if rng.random() < 0.05 else round(rng.gauss(0, 50), 1)
        rows.append((i, group, value))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "id long, g string, v double")


def sql_ntile(values, n):
    size, out = len(values), {}
    for rank, (_, i) in enumerate(sorted(values)):
        big, small = size % n, size // n
        out[i] = rank // (small + 1) + 1 if rank < big * (small + 1) else big + (rank - big * (small + 1)) // max(small, 1) + 1
    return out


@pytest.mark.parametrize("partitions", ["1", "30"])
def test_ntile(spark, frame, data, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: (r.one, r.per) for r in ranking.ntile_groups(
            ranking.ntile_groups(frame, "v", 10, ["id"], name="one"), "v", 7, ["id"], ["g"], "per"
        ).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = sql_ntile([(v, i) for i, _, v in data if v is not None], 10)
    per = {}
    for g in GROUPS:
        per |= sql_ntile([(v, i) for i, h, v in data if v is not None and h == g], 7)
    assert got == {i: (whole.get(i), per.get(i)) for i, _, _ in data}


def test_ntile_of_small_groups(spark, rows):
    df = spark.createDataFrame([("x", 1, 5.0), ("y", 2, 1.0), ("y", 3, 2.0), ("z", 4, None)], "g string, id int, v double")
    assert rows(ranking.ntile_groups(df, "v", 4, ["id"], ["g"]), "id", "group") == [(1, 1), (2, 1), (3, 2), (4, None)]
    assert rows(ranking.ntile_groups(df.filter("id = 4"), "v", 4, ["id"]), "id", "group") == [(4, None)]
    assert rows(ranking.ntile_groups(df, "v", 1, ["id"]), "id", "group") == [(1, 1), (2, 1), (3, 1), (4, None)]


def test_unknown_tiebreaks_come_first(spark, rows):
    """Rows whose tiebreak is unknown take part: groups of five, not of three."""
    data = [(float(i // 2), None if i % 2 else i, i) for i in range(20)]
    df = spark.createDataFrame(data, "income double, moved int, id int")
    got = rows(ranking.ntile_groups(df, "income", 4, ["moved", "id"]), "id", "group")
    place = {i: k for k, (_, _, i) in enumerate(sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0)))}
    assert got == sorted(((i, place[i] // 5 + 1) for i in range(20)), key=lambda r: tuple((True, str(v)) for v in r))


def test_a_limit_is_met_in_one_comparison(spark):
    """Nulls first, as rows are sorted; one comparison a limit keeps the code short."""
    places = [float("-inf"), -2.0, 0.0, 1.5, float("inf")]
    data = [(v, t, i) for v in places for t, i in ((4, 0), (None, 2), (3, 1), (None, 1), (3, None))]
    df = spark.createDataFrame(data, "v double, t int, i int")
    ranked = ranking.ntile_groups(df, "v", 10, ["t", "i"])
    # The five rows of a value by hand: nulls of t, then of i, come first; 25 rows make five groups of 3 and five of 2.
    at = {(v, t, i): 5 * k + place for k, v in enumerate(places)
          for place, (t, i) in enumerate(((None, 1), (None, 2), (3, None), (3, 1), (4, 0)))}
    for r in ranked.collect():
        rank = at[r.v, r.t, r.i]
        assert r.group == (rank // 3 + 1 if rank < 15 else 6 + (rank - 15) // 2)
    assert "<=>" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_ranked(spark, rows):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("dbacfe")], "v string, id int")
    assert rows(ranking.ntile_groups(df, "v", 3, ["id"]), "v", "group") == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("f", 3)]


def test_too_few_rows_for_the_places(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    with pytest.raises(Exception, match="fewer than 9 rows"):
        ranking.position_groups(df, "v", 10).collect()


def test_group_sizes_differ_by_one(frame):
    sizes = [r["count"] for r in ranking.ntile_groups(frame.dropna(), "v", 10, ["id"]).groupBy("group").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles(frame, data, keys):
    probs = [0.0, 0.025, 0.1, 0.5, 0.975, 1.0]
    for r in ranking.quantile_table(frame, keys, "v", probs).collect():
        mine = [v for _, g, v in data if v is not None and (not keys or g == r["g"])]
        assert r["n"] == len(mine)
        assert np.allclose(r["quantiles"], np.quantile(mine, probs), rtol=1e-12)


def test_quantile_groups_keep_ties_together(frame, data):
    known = [v for _, _, v in data if v is not None]
    cuts = np.quantile(known, [i / 10 for i in range(1, 10)])
    for r in ranking.quantile_groups(frame, "v", 10).collect():
        assert r["group"] == (None if r["v"] is None else 1 + int(sum(c <= r["v"] for c in cuts)))


@pytest.mark.parametrize("n", [2, 40])
def test_position_groups(frame, data, n):
    known = np.sort([v for _, _, v in data if v is not None])
    places = np.round(np.arange(1, n) * (len(known) + 1) / n - 1).astype(int)
    for r in ranking.position_groups(frame, "v", n).collect():
        assert r["group"] == (None if r["v"] is None else int((known[places] < r["v"]).sum()))


def test_dense_ranks(frame, data):
    distinct = sorted({v for _, _, v in data if v is not None}, reverse=True)
    for r in ranking.dense_ranks(frame, "v", desc=True).collect():
        assert r["position"] == (None if r["v"] is None else distinct.index(r["v"]) + 1)


def test_trim_is_strict(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert rows(quantile_trim(df, "v", 0.25, 0.75)) == [(3.0,)]


def test_median_order(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 5.0), ("c", 2.0), ("c", None)], "k string, v double")
    assert rows(order_groups_by_median(df, "k", "v")) == [("a", 5.0, 2), ("b", 5.0, 2), ("c", 2.0, 1)]


def test_bands(spark, rows):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (20.0,), (35.0,), (None,)], "v double")
    got = rows(fixed_bands(df, "v", [0, 10, 20], label="text"), "v", "band", "text")
    assert [r[1:] for r in got] == [(None, None), (1, "[0,10)"), (2, "[10,20)"), (3, "[20,35]"), (3, "[20,35]"), (1, "[0,10)")]
    closed = rows(fixed_bands(df.filter("v <= 20"), "v", [0, 10, 20]), "v", "band")
    assert closed == [(0.0, 1), (10.0, 2), (20.0, 2), (9.9, 1)]
