import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from hearthpanel.llm import conversations, queries
from hearthpanel.llm.common import prepare_workers

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, copies string, said int, conv_key int"
WORD = r"[^\x20\x09-\x0D]"


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 by trying all edits."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(WORD, text)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "cut" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(kind)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(i, roles, inserted):
        """Cheapest (cost, audit, output) from row i on, after initials ``roles`` (the last two matter)."""
        found = []
        if i == len(rows):
            if roles in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, o = best(i + 1, roles, 0)
            found.append((c + 3, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "cut")
                for new, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if new and roles + new[0] in ("s", "u", "su", "ua", "au"):
                        c, a, o = best(i + 1, new[0], 0)
                        found.append((c + price + extra, letter + a, (f"{new}:{text}", *o)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if roles + new[0] in ("u", "su", "ua", "au"):
                    c, a, o = best(i, new[0], inserted + 1)
                    found.append((c + 2, "I" + a, (f"{new}:", *o)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    cost, audit, out = best(0, "", 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("cut"), illegal, cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def made(spark, rows):
    prepare_workers(spark)
    return spark.createDataFrame([(*r, "p", "c", 1, 2) for r in rows], SCHEMA)


def random_rows(seed, conversations=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", "why?  ", "é.", None, "a.b", "x"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3, turn * 10**15]), role, text))
    return rows


@pytest.mark.parametrize("seed,held", [(1, 8 << 20), (2, 1), (3, 300)])
def test_random_conversations(spark, monkeypatch, seed, held):
    rows = random_rows(seed)
    df = conversations.damaged(made(spark, rows))
    if held < 8 << 20:  # small pieces, in this process
        monkeypatch.setattr(conversations, "HELD_BYTES", held)
        for conv, want in [(c, brute(r)) for c, r in brute_damage(rows).items()]:
            one, order = conversations._Conversation(str(conv)), brute_damage(rows)[conv]
            for i in reversed(range(len(order))):
                one.add(*order[i], order[i][1:] in [o[1:] for o in order[:i]])
            assert one.result()[1:] == want
    assert got(conversations.repair(df)) == {c: brute(r) for c, r in brute_damage(rows).items()}


def test_small_batches(spark):
    rows = random_rows(4, 60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(conversations.repair_damaged(made(spark, rows))) == {c: brute(r) for c, r in brute_damage(rows).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_giant_conversation(spark):
    """One conversation with most rows, long texts, written in pieces."""
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"text {i % 9000}. " + "word " * 60 + rng.choice([".", ""])) for i in range(40_000)]
    rows += [(2, 0, "user", "x" * 500_000 + "."), (2, 1, "assistant", "y" * 500_000)]
    by = got(conversations.repair_damaged(made(spark, rows).repartition(8)))
    whole = brute_damage(rows)
    assert by[2] == brute(whole[2])
    one = conversations._Conversation("1")
    seen, marked = set(), []
    for turn, role, text in whole[1]:
        marked.append((turn, role, text, (role, text) in seen))
        seen.add((role, text))
    for row in reversed(marked):
        one.add(*row)
    assert by[1] == one.result()[1:]
    assert len(by[1][6]) >= len(whole[1])


def test_edges(spark):
    assert got(conversations.repair_damaged(made(spark, []))) == {}
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (5, None, "user", "a."),
        (6, 1, "user", "tie."), (6, 1, "user", "tie."), (6, 1, "assistant", "tie."), (7, -3, "system", "s."), (7, 2, "user", "q?"),
    ]
    assert got(conversations.repair_damaged(made(spark, rows))) == {c: brute(r) for c, r in brute_damage(rows).items()}
    dropped = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(conversations.repair_damaged(made(spark, [(9, dropped, "user", "gone.")]))) == {9: (0, 0, 0, 0, 0, 0, "", empty)}
    plain = conversations.repair(conversations.untouched(made(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "b")])))
    assert got(plain)[1][5:7] == (1, "KK")


def test_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    result = queries.op12_conversations(spark, SF)
    assert result.columns == ["conv_id", *[c.split()[0] for c in conversations.RESULT.split(", ")[1:]]]
    assert got(result) == {c: brute(r) for c, r in brute_damage(rows).items()}
