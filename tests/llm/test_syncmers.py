import hashlib
import re
import struct

import pytest
import xxhash

from hearthpanel.llm import queries, syncmers

SF = "/root/testdata/sf0.01"


def spark_hash(*values):
    """XXH64 of values one after the other, the hash of one being the seed of the next."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute_anchors(text):
    words = [spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    found = []
    for i in range(len(words) - 5):
        inside = [spark_hash(words[i + j], words[i + j + 1]) for j in range(5)]
        if min(inside) in (inside[0], inside[-1]):
            found.append((i, spark_hash(inside[0], inside[2], inside[4])))
    if not found and words:
        found = [(0, spark_hash(*words))]
    return found


def brute_marks(text):
    return [(i, (h % (1 << 64)) >> 33) for i, h in brute_anchors(text)]


def brute_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def written(marks):
    return " ".join(f"{i:x}:{h:08x}" for i, h in marks)


def check(rows, docs):
    """``docs`` in ring order as (id, text); equal rows once."""
    text = {i: t or "" for i, t in docs}
    after = {i: docs[(k + 1) % len(docs)][0] for k, (i, _) in enumerate(docs)}
    for r in rows:
        own, follower = text[r.doc_id], text[after[r.doc_id]]
        half = len(own) // 2
        edited = own[: len(own) - half] + follower[:half]
        a, b, c = brute_marks(own), brute_marks(edited), brute_marks(follower)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == written(a) and r.edited_fingerprint == written(b)
        assert r.near_edited == pytest.approx(brute_likeness(a, b)) and r.near_next == pytest.approx(brute_likeness(a, c))


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = queries.op8_syncmers(spark, SF).collect()
    assert len(rows) == len(docs)
    check(rows[:150], docs)
    near, other = (sorted(r[k] for r in rows) for k in ("near_edited", "near_next"))
    assert near[len(near) // 2] > 0.25 and other[int(0.95 * len(other))] < 0.05


def test_small_overlaps_of_long_texts(make_docs):
    """All anchors of a text count: a passage of 60 words in texts of 9,000 words is seen, and parts in another order differ."""
    one, two, passage = ([f"{c}{i * i % 9973}" for i in range(n)] for c, n in (("a", 9000), ("b", 9000), ("p", 60)))
    first, second = " ".join(one[:4000] + passage + one[4000:]), " ".join(two[:7000] + passage + two[7000:])
    turned = " ".join(one[4000:] + passage + one[:4000])
    got = {r.doc_id: r for r in syncmers.fingerprint_edits(make_docs([(1, first, "en", "a"), (2, second, "en", "a"), (3, turned, "en", "a")])).collect()}
    assert 0 < got[1].near_next == pytest.approx(brute_likeness(brute_marks(first), brute_marks(second)))
    assert got[3].near_next > 0.99 and got[3].fingerprint != got[1].fingerprint
    assert got[1].fingerprint == written(brute_marks(first)) and len(brute_marks(first)) > 3000


def test_anchors_keep_their_positions_and_do_not_see_their_surroundings(make_docs):
    shared = " ".join(f"w{i % 23}x{i}" for i in range(40))
    docs = make_docs([(1, "a b c " + shared, "en", "a"), (2, shared + " z y", "en", "a")])
    one, two = (r.anchors for r in syncmers.with_anchors(docs).orderBy("doc_id").collect())
    assert [(a.position, a.hash) for a in one] == brute_anchors("a b c " + shared)
    assert {(a.position - 3, a.hash) for a in one if a.position >= 3} == {(a.position, a.hash) for a in two if a.position <= 34}


def test_edges(make_docs, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None]
    docs = make_docs(rows)
    got = syncmers.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    once = sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0])
    check([r for r in got if r.doc_id != 7], once)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 6)} == {""}
    assert len(syncmers.fingerprint_edits(make_docs(edge_rows)).collect()) == len(edge_rows)
    assert syncmers.fingerprint_edits(make_docs([])).count() == 0
    (alone,) = syncmers.fingerprint_edits(make_docs([(5, "one two three four", "en", "a")])).collect()
    assert alone.near_next == 1.0 and alone.n_chars == 18
