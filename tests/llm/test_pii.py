import hashlib
import time

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import pii

KEY = "a key for tests"

TEXTS = {
    0: "card 4491382641088554 and 4491 3826 4108 8554, bad 4491382641088555",
    1: "+1 (702) 555-0742 or 702-555-0742 or +491701234567",
    2: "173.33.203.46 and 300.1.1.1 version 2.0.",
    3: "rely.72@mail3.example.com, a@b.co",
    4: "ssn 123-45-6789 000-12-3456 666-12-1234 900-12-1234",
    5: "DE89370400440532013000 and GB82 WEST 1234 5698 7654 32 bad DE89370400440532013001",
    6: "born 1984-02-29, 31/12/1999, 01.02.2003, no 1984-02-30",
    7: "nothing here 12 345 of interest",
    8: "",
    9: None,
}


def luhn(digits):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(digits)))) % 10 == 0


def shuffled(a, b, sizes, key, kind):
    for i in range(pii.ROUNDS):
        other = b if i % 2 == 0 else a
        shift = int(hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16)
        a, b = ((a + shift) % sizes[0], b) if i % 2 == 0 else (a, (b + shift) % sizes[1])
    return a, b


def digits(text, key, kind):
    left = len(text) // 2
    a, b = shuffled(int(text[:left] or 0), int(text[left:]), (10**left, 10 ** (len(text) - left)), key, kind)
    return (f"{a:0{left}d}" if left else "") + f"{b:0{len(text) - left}d}"


@pytest.fixture(scope="module")
def done(frame):
    return {r.doc_id: r for r in pii.report(frame(list(TEXTS.items())), KEY).collect()}


def test_card_against_a_plain_network(done):
    head = "4" + digits("49138264108855", KEY, "card")
    card = next(head + str(c) for c in range(10) if luhn(head + str(c)))
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    assert done[0].text == f"card {card} and {spaced}, bad 4491382641088555" and done[0].n_replaced == 2


def test_address_against_a_plain_network(done):
    a, b = shuffled(173 * 256 + 33, 203 * 256 + 46, (65536, 65536), KEY, "ip")
    assert done[2].text == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255} and 300.1.1.1 version 2.0."


def test_formats_stay_valid(done):
    phone = done[1].text
    assert phone.startswith("+1 (") and phone[4:7] == phone[21:24] and "555-0742" not in phone and done[1].n_replaced == 3
    assert done[3].text.endswith("@b.co") and "rely" not in done[3].text and "@mail3.example.com" in done[3].text
    assert done[4].text.endswith("000-12-3456 666-12-1234 900-12-1234") and done[4].n_replaced == 1
    iban = done[5].text.split()[0]
    number = int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))
    assert iban[:2] == "DE" and number % 97 == 1 and done[5].n_replaced == 2 and done[5].text.endswith("DE89370400440532013001")
    assert "1984-02-29" not in done[6].text and "1984-02-30" in done[6].text and done[6].n_replaced == 3


def test_other_texts_are_left_alone(done):
    assert [done[i].text for i in (7, 8, 9)] == [TEXTS[7], "", ""] and all(done[i].n_replaced == 0 for i in (7, 8, 9))


def test_equal_values_link_and_the_key_undoes(frame, spark):
    docs = frame(list(TEXTS.items()) + [(None, "4491382641088554"), (0, "x 4491382641088554.")] )
    found = pii.report(docs, KEY)
    text = {str(r.doc_id) + r.text[:1]: r.text for r in found.filter("doc_id IS NULL OR text LIKE 'x%'").collect()}
    assert len({t.strip("x .") for t in text.values()}) == 1
    back = found.filter("doc_id < 6").select("doc_id", pii.replaced(F.col("text"), KEY, undo=True)["text"].alias("text")).collect()
    assert all(r.text == TEXTS[r.doc_id] for r in back if not r.text.startswith("x"))
    other = pii.report(docs, "another key").filter("doc_id = 1").first()
    assert other.text != found.filter("doc_id = 1").first().text


def test_different_values_stay_different(spark):
    days = spark.range(20_000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    moved = days.select(pii.replaced(F.col("t"), KEY)["text"].alias("t"))
    assert moved.distinct().count() == 20_000 and moved.filter("t < '1900-01-01' OR t > '2099-12-31'").isEmpty()


def test_columns_and_empty(frame):
    docs = frame([(1, None), (2, "call 702-555-0742 now")])
    out = pii.pseudonymised(docs, KEY)
    assert out.columns == docs.columns and [r.text for r in out.orderBy("doc_id").collect()][0] is None
    assert pii.report(frame([]), KEY).collect() == [] and pii.pseudonymised(frame([]), KEY).collect() == []
    long = "word " * 100_000 + "4491382641088554"
    assert pii.report(frame([(1, long)]), KEY).first().n_replaced == 1


def test_addresses_keep_their_case_apart(frame):
    rows = pii.report(frame([(0, "John.Doe@x.org"), (1, "john.doe@x.org"), (2, "JOHN.DOE@x.org"), (3, "John.Doe@x.org!")]), KEY)
    text = {r.doc_id: r.text for r in rows.collect()}
    assert len({text[0], text[1], text[2]}) == 3 and text[3] == text[0] + "!"
    back = rows.select(pii.replaced(F.col("text"), KEY, undo=True)["text"].alias("t"), "doc_id").collect()
    assert {r.doc_id: r.t for r in back} == {0: "John.Doe@x.org", 1: "john.doe@x.org", 2: "JOHN.DOE@x.org", 3: "John.Doe@x.org!"}


def test_addresses_of_many_labels_and_long_runs(frame):
    many = "me@" + "a." * 30 + "org"
    found = pii.report(frame([(0, many), (1, "x" * 64 + "@b.org"), (2, "x" * 65 + "@b.org"), (3, "--me@b.org")]), KEY)
    assert [r.n_replaced for r in found.orderBy("doc_id").collect()] == [1, 1, 0, 1]


@pytest.mark.parametrize("run", ["a", "a.", "1 ", "A1", "x@a.", "x@", "12 ", "1.", "-", "AB12 ", "a@b.c ", "+1 "])
def test_long_runs_take_time_in_proportion(frame, run):
    docs = frame([(0, "x@y " + run * (1_000_000 // len(run))), (1, "x@" + run * (10_000 // len(run)))])
    start = time.perf_counter()
    assert len(pii.report(docs, KEY).collect()) == 2
    assert time.perf_counter() - start < 30


def test_odd_texts_stay(frame, odd):
    rows = pii.report(frame(list(enumerate(odd))), KEY).collect()
    assert {r.doc_id: r.text for r in rows} == {i: t or "" for i, t in enumerate(odd)}


def test_lengths_follow(frame):
    row = pii.pseudonymised(frame([(0, "173.33.203.46"), (1, "none"), (2, None)]), KEY).orderBy("doc_id").collect()
    assert [r.n_chars for r in row] == [len(row[0].text), 4, 0]


def test_a_session_keeps_its_key(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32
