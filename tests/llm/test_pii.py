import datetime
import ipaddress
import re
import unicodedata

import pytest

from hearthpanel.llm import pii, queries

P = pii.Pseudonyms(b"k")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 100, 260, 1000])
def test_permutation(size):
    feistel = pii.Feistel(b"key")
    image = [feistel.permute(x, size, b"t") for x in range(size)]
    assert sorted(image) == list(range(size))
    assert [feistel.permute(y, size, b"t", back=True) for y in image] == list(range(size))
    even = [feistel.permute(x, size, b"t", lambda v: v % 2 == 0) for x in range(0, size, 2)]
    assert sorted(even) == list(range(0, size, 2))


def test_dates_are_permuted_within_their_format():
    seen = set()
    for day in range(0, 73049, 97):
        text = datetime.date.fromordinal(pii._FIRST_DAY + day).isoformat()
        new = P.value("iso", text)
        datetime.date.fromisoformat(new)
        seen.add(new)
    assert len(seen) == len(range(0, 73049, 97))
    for text in ("1.2.1999", "31/12/2001", "01.1.2020"):
        assert re.sub(r"\d", "9", P.value("dmy", text)) == re.sub(r"\d", "9", text)


@pytest.mark.parametrize(
    "text,form",
    [
        ("mail und.34@mail7.example.com.", r"mail [a-z]{3}\.\d\d@mail7\.example\.com\."),
        ("call +1 (017) 555-7713!!", r"call \+1 \(\d{3}\) \d{3}-\d{4}!!"),
        ("card 4111111111111111$$$", r"card \d{16}\$\$\$"),
        ("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"),
        ("ip 97.51.17.173, x", r"ip \d+\.\d+\.\d+\.\d+, x"),
        ("born 1984-02-29.", r"born \d{4}-\d\d-\d\d\."),
        ("ssn 078-05-1120", r"ssn \d{3}-\d\d-\d{4}"),
        ("DE89370400440532013000", r"DE\d{20}"),
        ("+1 (826) 555-4081 190.137.223.204 of.92@mail6.example.com", r"\+1 \(\d{3}\) \d{3}-\d{4} [\d.]+ [a-z]{2}\.\d\d@mail6.example.com"),
    ],
)
def test_values_are_replaced_in_their_format(text, form):
    new, n = P.text(text)
    assert new != text and n >= 1 and re.fullmatch(form, new)


def test_check_digits_hold():
    new = P.value("card", "4111111111111111")
    assert pii.luhn(new) and not pii.luhn(P.value("card", "4111111111111112"))
    assert pii.iban(P.value("iban", "DE89370400440532013000"))


@pytest.mark.parametrize(
    "text",
    [
        "Apache License, Version 2.0, CC BY-NC 4.0.", 'token = "40d78ab1234567890123456789cdef0011223344"', "version 3.", "1999-02-30",
        "999.1.2.3", "1.2.3", "a@b", "12:30 on 5 May", "page 123-4567", "v1.2.3.4.5", "DE00370400440532013000", "", None,
    ],
)
def test_other_texts_stay(text):
    assert P.text(text) == (text, 0)


def test_equal_values_stay_linked_and_keys_differ(make_docs, edge_rows):
    rows = [(20, "a 97.51.17.173 b", "en", "a"), (21, "97.51.17.173, 97.51.17.174", "en", "a")]
    docs = make_docs(edge_rows + rows)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    one = got[20].text.split()[1]
    assert got[21].text.startswith(one + ",") and got[21].n_values == 2
    assert pii.Pseudonyms(b"other").value("ip", "97.51.17.173") != one
    texts = {r[0]: r[1] for r in edge_rows}
    assert all(got[i].text == texts[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9))
    assert pii.hide(docs).columns == docs.columns and pii.report(make_docs([])).count() == 0


def test_query_leaves_no_value(spark):
    sf = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = {r.doc_id: r for r in queries.op7_pii(spark, sf).collect()}
    values = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d+\) \d+-\d+|(?<!\w)\d{16}(?!\w)|(?<![\w.])\d+\.\d+\.\d+\.\d+")
    found = 0
    assert before.keys() == after.keys()
    for i, text in before.items():
        old = values.findall(text)
        found += len(old)
        assert not [v for v in old if v in after[i].text]
        assert after[i].n_values == len(old) and (old or after[i].text == text)
        assert values.sub("#", text) == values.sub("#", after[i].text)
    assert found > 20


@pytest.mark.parametrize(
    "value",
    [
        "(017) 555-7713", "(017)555 7713", "+1222222", "+49 30 1234 5678", "017.555.7713", "078-05-1120", "1984-02-29", "31/12/2024",
        "1/2/2024", "1.2.2024", "12/31/2024", "2/13/2024", "1.2.3.4", "4111-1111-1111-1111", "4222222222222", "NO9386011117947",
        "GB82 WEST 1234 5698 7654 32", "a.1@b.de",
    ],
)
def test_every_form_alone_in_a_document(value):
    for text in ("Born on {} in Rome.", "{}"):
        new, n = P.text(text.format(value))
        assert n == 1 and new != text.format(value)
    both, n = P.text(f"{value} and 97.51.17.173")
    assert n == 2 and both.startswith(new)


def test_dates_with_the_month_first_are_permuted_among_themselves():
    days = [datetime.date.fromordinal(pii._FIRST_DAY + i) for i in range(0, 73049, 31)]
    old = [f"{d.month}/{d.day}/{d.year}" for d in days]
    new = [P.value("dmy", t) for t in old]
    assert len(set(new)) == len(set(old))
    for a, b in zip(old, new):
        assert [len(x) for x in a.split("/")] == [len(x) for x in b.split("/")]
        if int(a.split("/")[1]) > 12:
            datetime.datetime.strptime(b, "%m/%d/%Y")
            assert int(b.split("/")[1]) > 12


@pytest.mark.parametrize(
    "kind,forms",
    [
        ("card", ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]),
        ("iban", ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]),
        ("phone", ["+1 222 333 4444", "+12223334444", "+1 (222) 333-4444", "(222) 333-4444", "222.333.4444", "222-333-4444"]),
        ("phone", ["+49 30 1234 5678", "+493012345678", "+49-30-12345678"]),
        ("ip6", ["2001:db8:0:0:8:800:200c:417a", "2001:0db8:0000:0000:0008:0800:200c:417a", "2001:DB8::8:800:200C:417A"]),
    ],
)
def test_a_value_has_one_pseudonym_in_all_its_forms(kind, forms):
    def plain(text):
        return ipaddress.ip_address(text).exploded if kind == "ip6" else re.sub(r"\W", "", text)[-22 if kind == "iban" else -10 :]

    new = [P.text(f"see {f}, please")[0][4:-8] for f in forms]
    assert len({plain(n) for n in new}) == 1 and not {plain(f) for f in forms} & {plain(n) for n in new}
    if kind != "ip6":
        assert [re.sub(r"\w", "9", f) for f in forms] == [re.sub(r"\w", "9", n) for n in new]


def test_a_day_has_one_pseudonym_in_all_its_forms():
    seen = set()
    for i in range(0, 73049, 53):
        d = datetime.date.fromordinal(pii._FIRST_DAY + i)
        new = datetime.date.fromisoformat(P.value("iso", d.isoformat()))
        seen.add(new)
        assert P.value("dmy", f"{d.day}.{d.month}.{d.year}") == f"{new.day}.{new.month}.{new.year}"
        assert P.value("dmy", f"{d.day:02}/{d.month:02}/{d.year}") == f"{new.day:02}/{new.month:02}/{new.year}"
        if d.day > 12:
            assert P.value("dmy", f"{d.month}/{d.day}/{d.year}") == f"{new.month}/{new.day}/{new.year}"
    assert len(seen) == len(range(0, 73049, 53))


@pytest.mark.parametrize("days", [days for days in pii._days().values() if len(days) < 6000])
def test_days_are_permuted_within_their_class(days):
    new = {P.value("iso", datetime.date.fromordinal(d).isoformat()) for d in days}
    assert new == {datetime.date.fromordinal(d).isoformat() for d in days}


@pytest.mark.parametrize("name", ["müller", "müller", "Ångström.É", "иванов", "νίκος", "o_neil+x"])
def test_mail_names_of_other_alphabets(name):
    new, n = P.text(f"an <{name}@example.com> und")
    assert n == 1 and new.startswith("an <") and new.endswith("@example.com> und") and name[:2] not in new
    assert len(new) == len(f"an <{name}@example.com> und")
    assert [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in f"an <{name}@example.com> und"]


def test_words_before_an_address_stay():
    new, n = P.text("我的邮箱是abc@example.com")
    assert n == 1 and new.startswith("我的邮箱是") and "abc@" not in new


@pytest.mark.parametrize(
    "text,form",
    [
        ("020 7946 0958", r"\d{3} \d{4} \d{4}"), ("01 23 45 67 89", r"\d\d( \d\d){4}"), ("0170 1234567", r"\d{4} \d{7}"),
        ("fe80::1", r"fe80::[0-9a-f]{1,4}"), ("2001:db8::ff00:42:8329", r"2001:[0-9a-f]+::[0-9a-f]+:[0-9a-f]+:[0-9a-f]+"),
    ],
)
def test_national_numbers_and_long_addresses(text, form):
    new, n = P.text(f"call {text} now")
    assert n == 1 and new != f"call {text} now" and re.fullmatch(f"call {form} now", new)


@pytest.mark.parametrize("text", ["at 1234:56:78", "add1::face", "01 02 03", "0123 456 78", "dead::", "cafe:babe", "2001::", "12:30:45:99"])
def test_what_only_looks_alike_stays(text):
    assert P.text(text) == (text, 0)


def test_query_against_every_value_alone(spark):
    """The whole query against each document on its own, by a fresh state without its cache."""
    sf = "/root/testdata/sf0.001"
    fresh = pii.Pseudonyms(pii.KEY)
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op7_pii(spark, sf).collect():
        fresh.known.clear()
        assert (r.text, r.n_values) == fresh.text(before[r.doc_id])
