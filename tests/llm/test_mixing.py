import hashlib
import re

import duckdb
import pytest

from hearthpanel.llm import mixing, queries


def brute_targets(sizes, weights, share, cap):
    budget, free, target = sum(sizes) * share, set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = budget / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > sizes[i] * cap}
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = sizes[i] * cap
        budget -= sum(target[i] for i in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 300, 7], [0, 0, 10], [0], [3, 3, 3, 3, 900]])
def test_water_fill(spark, sizes):
    weights = [float((3, 1, 2)[i % 3]) for i in range(len(sizes))]
    rows = [(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))]
    df = spark.createDataFrame(rows, "source string, source_size bigint, weight double")
    got = [r.target for r in mixing.water_fill(df, 1.5, 2.0).orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes, weights, 1.5, 2.0))


def test_weights_follow_code_points_with_null_last(spark):
    names = ["b", "a", None, "Z", "é", "aa"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r.source: r.weight for r in mixing.cyclic_weights(df, (3, 1, 2)).collect()}
    assert got == {"Z": 3, "a": 1, "aa": 2, "b": 3, "é": 1, None: 2}


def check_contract(rows, given):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(i), words(t)) for i, t, _, _ in given) == sorted((str(r.doc_id), r.size) for r in rows)
    assert all(r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0 for r in rows)


def test_edges_and_reruns(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    one, two = ([tuple(r) for r in mixing.mix_counts(docs).collect()] for _ in range(2))
    key = lambda r: tuple(map(str, r))
    assert sorted(one, key=key) == sorted(two, key=key)
    check_contract(mixing.mix_counts(docs).collect(), edge_rows)
    assert mixing.mix_counts(make_docs([])).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r[5] for r in one)


def test_part_of_a_source_is_near_its_target(make_docs):
    rows = [(i, "w " * (1 + int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 90), "en", f"s{i % 3}") for i in range(900)]
    got = mixing.mix_counts(make_docs(rows)).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r[2] - r.target) <= 2 for r in got)


def test_against_sql_on_edges(spark, make_docs, edge_rows, tmp_path):
    from checks.compare import difference

    more = [(100 + i, "a b c " * (i % 17), "en", f"s{i % 4}") for i in range(200)]
    make_docs(edge_rows + more).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.op1_mixing(spark, str(tmp_path)).toPandas()
    want = con.execute(queries.ORACLES["op1_mixing"]).df().drop_duplicates()
    assert difference(got.drop_duplicates(), want) is None


def test_cut_reads_more_digits(make_docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 13), "en", f"s{i % 2}") for i in range(300)]
    want = sorted(map(tuple, mixing.mix_counts(make_docs(rows)).collect()))
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert sorted(map(tuple, mixing.mix_counts(make_docs(rows)).collect())) == want
