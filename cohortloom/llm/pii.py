"""Format-preserving pseudonyms for personal data.

Validated card numbers, phone numbers, social security numbers, IP addresses, IBANs, dates and the local parts of
e-mail addresses are replaced by keyed permutations within their format. A permutation is a Feistel network over two
coordinates: in turn each is shifted by a keyed hash of the other. Equal values get equal pseudonyms in every
document, different values different ones, and the holder of the key can undo it. All of it is column expressions.

Patterns hold runs of bounded length only, tried once per run: mail addresses are found up to the lengths that RFC 5321
allows (64 characters before the @, labels of 63), so no text takes more than time in proportion to its length.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Names the key of a session.
KEY_CONF = "spark.cohortloom.pii.key"
ROUNDS = 10

# What the formats look like.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[._%+-]{0,63}+[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@"
    r"(?:[A-Za-z0-9-]{1,63}+\.){1,32}[A-Za-z]{2,63}"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?[0-9]{6,12}(?![0-9A-Za-z])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
DATE = (
    r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"(?![0-9A-Za-z/-]|\.[0-9])"
)
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, DATE, IP, SSN, CARD, PHONE))
#: Every match of ANY holds one of these; texts without are passed on after one quick scan.
HINT = r"@|(?:[0-9][ ()./+-]{0,2}){4}"
#: Days from 1900-01-01 to 2099-12-31, as a product.
DAYS = (17, 4297)
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def keyed(key: str, kind: str, step: Column, value: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, sizes: tuple, key: str, kind: str, undo: bool = False) -> Column:
    """A permutation of pairs (``a`` below sizes[0], ``b`` below sizes[1]), as a struct of ``a`` and ``b``."""
    big_a, big_b = (s if isinstance(s, Column) else F.lit(s).cast("bigint") for s in sizes)
    sign = F.lit(-1 if undo else 1).cast("bigint")

    def turn(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        even = i % 2 == 0
        shift = keyed(key, kind, i, F.when(even, b).otherwise(a))
        return F.struct(
            F.when(even, F.pmod(a + sign * (shift % big_a), big_a)).otherwise(a).alias("a"),
            F.when(even, b).otherwise(F.pmod(b + sign * (shift % big_b), big_b)).alias("b"),
        )

    steps = [F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))]
    return F.aggregate(F.array(*steps), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of up to 30 digits as another one of that length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    head = F.coalesce(F.try_to_number(F.nullif(F.substring(digits, F.lit(1), left), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0))
    tail = F.substring(digits, left + 1, n - left).cast("bigint")
    out = feistel(head, tail, (ten(left), ten(n - left)), key, kind, undo)
    return F.transform(F.array(out), lambda p: F.concat(
        F.when(left > 0, F.lpad(p["a"].cast("string"), left, "0")).otherwise(""), F.lpad(p["b"].cast("string"), n - left, "0")
    ))[0]


def refilled(template: Column, wanted: str, filling: Column) -> Column:
    """``template`` with its characters of class ``wanted`` replaced, in order, by those of ``filling``."""
    chars = F.split(template, "")
    seen = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), f"[^{wanted}]", ""))
    return F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike(f"^[{wanted}]$"), F.substring(filling, seen(i), F.lit(1))).otherwise(c)), ""
    )


def luhn_sum(digits: Column) -> Column:
    """The sum of a card number's digits, every second from the right doubled."""
    backwards = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters (A = 10 … Z = 35) read as one number."""
    def turn(r: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(r * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), turn)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def card(text: Column, key: str, undo: bool) -> Column:
    """The first digit and the length stay, the check digit follows."""
    def changed(d: Column) -> Column:
        head = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", undo))
        return let(head, lambda h: refilled(text, "0-9", F.concat(h, F.pmod(10 - luhn_sum(F.concat(h, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return let(digits_of(text), lambda d: F.when(luhn_sum(d) % 10 == 0, changed(d)).otherwise(text))


def phone(text: Column, key: str, undo: bool) -> Column:
    """The country code stays."""
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    return let(code, lambda c: let(
        F.substring(text, F.length(c) + 1, F.length(text)),
        lambda rest: F.concat(c, refilled(rest, "0-9", permuted_digits(digits_of(rest), key, "phone", undo))),
    ))


def ssn(text: Column, key: str, undo: bool) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999: numbers stay within those in use."""
    area, group, serial = (F.element_at(F.split(text, "-"), i).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(place, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn", undo)
    area_of = lambda a: F.when(a > 664, a + 2).otherwise(a + 1)
    return F.when(valid, let(out, lambda p: F.format_string(
        "%03d-%02d-%04d", area_of(p["a"]), F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1
    ))).otherwise(text)


def ip(text: Column, key: str, undo: bool) -> Column:
    part = [F.element_at(F.split(text, r"\."), i).cast("int") for i in range(1, 5)]
    valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
    out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], (65536, 65536), key, "ip", undo)
    octets = lambda p: [F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256]
    return F.when(valid, let(out, lambda p: F.concat_ws(".", *[x.cast("string") for x in octets(p)]))).otherwise(text)


def iban(text: Column, key: str, undo: bool) -> Column:
    """The country and the letters stay, the check digits follow."""
    def changed(t: Column) -> Column:
        account = F.substring(t, F.lit(5), F.length(t))
        return let(refilled(account, "0-9", permuted_digits(digits_of(account), key, "iban", undo)), lambda a: let(
            F.concat(F.substring(t, 1, 2), F.lpad((98 - mod97(F.concat(a, F.substring(t, 1, 2), F.lit("00")))).cast("string"), 2, "0"), a),
            lambda whole: refilled(text, "A-Z0-9", whole),
        ))

    whole = F.regexp_replace(text, " ", "")
    valid = lambda t: mod97(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))) == 1
    return let(whole, lambda t: F.when(valid(t), changed(t)).otherwise(text))


def date(text: Column, key: str, undo: bool) -> Column:
    """A day from 1900 to 2099 as another one, in the same notation; of 03/04/2020 the day comes first if it can."""
    def shown(pattern: str) -> Column:
        day = F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
        n = F.date_diff(day, F.lit("1900-01-01").cast("date"))
        out = feistel(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date", undo)
        moved = let(out, lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")), pattern))
        return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), moved)

    return F.when(text.contains("-"), F.coalesce(shown("yyyy-MM-dd"), text)).when(
        text.contains("/"), F.coalesce(shown("dd/MM/yyyy"), shown("MM/dd/yyyy"), text)
    ).otherwise(F.coalesce(shown("dd.MM.yyyy"), text))


def email(text: Column, key: str, undo: bool) -> Column:
    """Letters (capital or small) and digits before the @ are permuted as one string; the domain stays."""
    symbol = lambda c: F.locate(c, F.lit(ALPHABET)) - 1 if isinstance(c, str) else F.instr(F.lit(ALPHABET), c) - 1

    def shifted(own: Column, other: Column, i: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            shift = keyed(key, "email", F.concat_ws(".", i, j), other) % len(ALPHABET)
            return F.substring(F.lit(ALPHABET), (F.pmod(symbol(c) + (-shift if undo else shift), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))

        return F.array_join(F.transform(F.filter(F.split(own, ""), lambda c: c != ""), one), "")

    def turn(pair: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, shifted(pair["a"], pair["b"], i)).otherwise(pair["a"]).alias("a"),
            F.when(i % 2 == 0, pair["b"]).otherwise(shifted(pair["b"], pair["a"], i)).alias("b"),
        )

    steps = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))])

    def changed(local: Column) -> Column:
        core = F.regexp_replace(local, "[^A-Za-z0-9]", "")
        half = F.ceil(F.length(core) / 2).cast("int")
        start = F.struct(F.substring(core, F.lit(1), half).alias("a"), F.substring(core, half + 1, F.length(core)).alias("b"))
        return let(F.aggregate(steps, start, turn), lambda p: refilled(local, "A-Za-z0-9", F.concat(p["a"], p["b"])))

    local = F.substring_index(text, "@", 1)
    return F.concat(let(local, changed), F.lit("@"), F.substring_index(text, "@", -1))


def pseudonym(text: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match of ANY; a match that fails its validation stays as it is."""
    whole = lambda pattern: text.rlike(f"^(?:{pattern})$")
    kinds = ((EMAIL, email), (IBAN, iban), (DATE, date), (IP, ip), (SSN, ssn), (CARD, card), (PHONE, phone))
    chain = None
    for pattern, change in kinds:
        now = change(text, key, undo)
        chain = F.when(whole(pattern), now) if chain is None else chain.when(whole(pattern), now)
    return chain.otherwise(text)


def replaced(text: Column, key: str, undo: bool = False) -> Column:
    """A struct of the ``text`` with all pseudonyms and the number of values replaced, ``n``."""
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    between = F.split(text, f"(?:{ANY})", -1)
    changed = F.transform(found, lambda m: F.struct(m.alias("was"), pseudonym(m, key, undo).alias("now")))

    def joined(pairs: Column) -> Column:
        pieces = F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(pairs, i)["now"], F.lit(""))))
        return F.struct(
            F.array_join(pieces, "").alias("text"),
            F.size(F.filter(pairs, lambda p: p["was"] != p["now"])).cast("bigint").alias("n"),
        )

    same = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
    return F.when(text.rlike(HINT), let(changed, joined)).otherwise(same)


def session_key(spark: SparkSession) -> str:
    """The key that ``spark.cohortloom.pii.key`` names; without one the session gets a random key of its own, whose
    pseudonyms nobody can undo afterwards and which link within the session only."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_CONF, key)
    return key


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every personal value in ``text`` replaced; other columns and the column order stay, null texts
    stay null. ``n_chars``, if there is one, is counted anew where a value was replaced."""
    done = docs.withColumn("_r", F.when(F.col("text").isNotNull(), replaced(F.col("text").cast("string"), key)))
    length = F.when(F.col("_r.n") > 0, F.length("_r.text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return done.select(*[
        F.col("_r.text").alias("text") if c == "text"
        else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns
    ])


def report(docs: DataFrame, key: str) -> DataFrame:
    """Per document (``doc_id``, ``text``) its ``text`` with pseudonyms and ``n_replaced``.

    A null text counts as empty. Values are replaced row by row, so null and repeated doc_ids and repeated rows
    stay; texts of any length are searched whole; other columns are not read; an empty table gives an empty result.
    """
    done = docs.select(F.col("doc_id").cast("bigint"), replaced(text_of(), key).alias("r"))
    return done.select("doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("n_replaced"))
