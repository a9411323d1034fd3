"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation [native].

Validated values (card numbers by their check digit, dates by the calendar, addresses by their octets, telephone numbers
and mail addresses by their form) are replaced by other values of the same format. A value becomes an array of small
numbers, each with its own radix: digits 10, letters 26, octets 256, days as below. The array is cut in halves, and in
each round one half is added, place by place and modulo its radix, to a keyed hash of the other. That is a permutation
of the format's values, so different values stay different and equal ones stay linked across documents and spellings
(separators, letter case, formats of dates), and whoever has the key can undo it.

A date like 12/14/2001 is read as month/day only since no month is 14, so its pseudonym must have such a day too. The
days of the 400-year cycle are therefore permuted in two parts, those up to the 12th of a month (4800 months x 12) and
those after it (9 x 9833), whatever their format: one day has one pseudonym in all formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
NUMBERS = (
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"),
    ("card", r"(?<![\w.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\w-])"),
    ("phone", r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("date", r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-])"),
)
KINDS = ("email", *(k for k, _ in NUMBERS))
FIRST_DAY = "1800-01-01"  # of 400 years
LATE_DAYS = (9, 9833)  # their days after the 12th of a month are 88,497
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def feistel(values: Column, radices: Column, tweak: Column, key: str, undo: bool = False) -> Column:
    """Permute an array of numbers below their radices. `tweak` keeps formats apart."""
    half = F.floor(F.size(values) / 2).cast("int")
    kind = "struct<a:array<bigint>,b:array<bigint>>"
    rest = F.size(values) - half
    start = F.struct(F.slice(values, 1, half).alias("a"), F.slice(values, half + 1, rest).alias("b")).cast(kind)

    def added(mine: Column, other: Column, radix: Column, r: Column) -> Column:
        said = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ",")).cast("binary"), 256)
        draw = lambda h, i: F.conv(F.substring(F.sha2(F.concat_ws("|", h, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint")
        drawn = let(said, lambda h: F.transform(mine, lambda x, i: -draw(h, i) if undo else draw(h, i)))
        return F.zip_with(F.zip_with(mine, drawn, lambda x, d: x + d), radix, lambda x, m: F.pmod(x, m.cast("bigint")))

    def step(s: Column, r: Column) -> Column:
        first = r % 2 == 0
        a = F.when(first, added(s["a"], s["b"], F.slice(radices, 1, half), r)).otherwise(s["a"])
        b = F.when(first, s["b"]).otherwise(added(s["b"], s["a"], F.slice(radices, half + 1, rest), r))
        return F.struct(a.alias("a"), b.alias("b")).cast(kind)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["a"], s["b"]))


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26)


def _low(c: Column) -> Column:
    """Code of the first character of c's class."""
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _put_back(text: Column, n: Column) -> Column:
    """The text with its digits and letters replaced, in order, by the numbers n in the same character classes."""
    kind = "struct<at:int,s:string>"

    def step(s: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        moved = F.char(F.try_element_at(n, s["at"] + 1) + _low(c))
        return F.struct((s["at"] + own.cast("int")).alias("at"), F.concat(s["s"], F.when(own, moved).otherwise(c)).alias("s")).cast(kind)

    return F.aggregate(_characters(text), F.struct(F.lit(0).alias("at"), F.lit("").alias("s")).cast(kind), step, lambda s: s["s"])


def luhn_sum(digits: Column) -> Column:
    """Sum that a check digit completes to a multiple of ten; the digits are those before it."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("bigint"), lambda s, d: s + d)


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("bigint"))


def _check_digit(digits: Column) -> Column:
    return F.pmod(F.lit(10) - luhn_sum(digits) % 10, F.lit(10))


def kind_of(token: Column) -> Column:
    """The kind of a match, or null where it does not hold as that kind's value."""
    digits = _digits(token)
    day = F.coalesce(*[F.try_to_timestamp(token, F.lit(f)) for f in DATES])
    within = (day >= F.lit("1800-01-01").cast("timestamp")) & (day < F.lit("2200-01-01").cast("timestamp"))
    whole = {k: token.rlike(f"^(?:{p})$") for k, p in NUMBERS}
    return (
        F.when(token.contains("@"), "email")
        .when(whole["ip"], F.when(~F.exists(F.split(token, r"\."), lambda o: o.cast("int") > 255), "ip"))
        .when(whole["card"], F.when(F.element_at(digits, -1) == _check_digit(F.slice(digits, 1, F.size(digits) - 1)), "card"))
        .when(whole["date"], F.when(within, "date"))
        .when(whole["ssn"], "ssn")
        .when(whole["phone"], "phone")
    )


def _first() -> Column:
    return F.lit(FIRST_DAY).cast("date")


def _month(n: Column) -> Column:
    """The first of the n-th month."""
    return F.add_months(_first(), n.cast("int"))


def _late_before(n: Column) -> Column:
    """How many days after the 12th of a month there are before the n-th month."""
    return F.datediff(_month(n), _first()) - 12 * n


def day_numbers(day: Column) -> Column:
    """A day as two numbers: month and day of it, or the place among the days after the 12th, in two digits."""
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    place = F.datediff(day, _first()) - 12 * (month + 1)
    late = F.array(F.floor(place / LATE_DAYS[1]), place % LATE_DAYS[1])
    return F.when(F.dayofmonth(day) > 12, late).otherwise(F.array(month, F.dayofmonth(day) - 1)).cast("array<bigint>")


def numbered_day(n: Column, late: Column) -> Column:
    a, b = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))

    def after(place: Column) -> Column:
        near = F.floor(place * 4800 / (LATE_DAYS[0] * LATE_DAYS[1]))  # months have 16 to 19 such days: one off at most
        month = F.when(_late_before(near + 1) <= place, near + 1).when(_late_before(near) <= place, near).otherwise(near - 1)
        return let(month, lambda m: F.date_add(_month(m), (12 + place - _late_before(m)).cast("int")))

    return F.when(late, let(a * LATE_DAYS[1] + b, after)).otherwise(F.date_add(_month(a), b.cast("int")))


def canonical(token: Column, kind: Column) -> Column:
    """The value of a token in one spelling: a date as year-month-day, mail addresses in lower case, numbers without separators."""
    date = F.date_format(F.coalesce(*[F.try_to_timestamp(token, F.lit(f)) for f in DATES]), DATES[0])
    octets = F.array_join(F.transform(F.split(token, r"\."), lambda o: o.try_cast("bigint").cast("string")), ".")
    return F.when(kind == "date", date).when(kind == "email", F.lower(token)).when(kind == "ip", octets).otherwise(F.regexp_replace(token, "[^0-9+]", ""))


def pseudonym(token: Column, kind: Column, key: str, undo: bool = False) -> Column:
    """The value's pseudonym, or with `undo` the value of a pseudonym. A null kind leaves it as it is.

    There is one permutation for all kinds; what differs is which numbers go in and how they are written.
    """
    dates = [F.try_to_timestamp(token, F.lit(f)) for f in DATES]
    day = F.coalesce(*dates).cast("date")
    late = F.dayofmonth(day) > 12
    country = F.regexp_extract(token, r"^\+\d{1,3}(?=[ .(-])|^", 0)  # stays as it is, like a mail's domain
    before = F.when(kind == "phone", country).otherwise("")
    # A card's last digit follows from the others.
    end = F.when(kind == "card", F.length(token) - 1).when(kind == "email", F.length(F.substring_index(token, "@", 1))).otherwise(F.length(token))
    middle = F.substring(token, F.length(before) + 1, end - F.length(before))
    chars = F.filter(_characters(middle), lambda c: c.rlike("[0-9A-Za-z]"))
    octets = F.transform(F.split(token, r"\."), lambda o: o.try_cast("bigint"))
    values = F.when(kind == "ip", octets).when(kind == "date", day_numbers(day)).otherwise(F.transform(chars, lambda c: (F.ascii(c) - _low(c)).cast("bigint")))
    radices = F.when(kind == "ip", F.array_repeat(F.lit(256), 4)).when(kind == "date", F.when(late, F.array(*map(F.lit, LATE_DAYS))).otherwise(F.array(F.lit(4800), F.lit(12)))).otherwise(F.transform(chars, _radix))
    tweak = F.when(kind == "card", F.concat(F.lit("card"), F.size(chars).cast("string"))).otherwise(kind)

    def written(n: Column) -> Column:
        there = numbered_day(n, late)
        date = F.coalesce(*[F.when(d.isNotNull(), F.date_format(there, f)) for d, f in zip(dates, DATES, strict=True)])
        text = let(_put_back(middle, n), lambda m: F.concat(before, m, F.when(kind == "card", _check_digit(_digits(m)).cast("string")).otherwise(F.substring(token, end + 1, F.length(token)))))
        return F.when(kind == "ip", F.array_join(n.cast("array<string>"), ".")).when(kind == "date", date).otherwise(text)

    return F.when(kind.isNull(), token).otherwise(let(feistel(values, radices, tweak, key, undo), written))


def _is(kind: str):
    return lambda x: x["k"] == kind


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace personal data in whole texts by pseudonyms of the same format.

    Returns doc_id, the number of replaced values of each kind (n_email, n_ip, n_card, n_phone, n_ssn, n_date), links (the
    pseudonyms in one spelling as kind:value, in order, equal for equal values however they are written) and the new text.

    Values that fail their check (a wrong check digit, no such day, an octet over 255) stay as they are. Dates are read as
    year-month-day, day/month/year, else month/day/year, or day.month.year, from 1800 to 2199. A null text stays null,
    an empty one empty. Rows are handled on their own: repeated rows and ids stay, null ids too. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    numbers = "|".join(p for _, p in NUMBERS)
    text = F.col("_t")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_t"))
    none = F.array().cast("array<string>")

    def by(f) -> Column:
        both, plain = f(f"{EMAIL}|{numbers}"), f(numbers)
        return F.when(text.contains("@"), both).when(text.rlike("[0-9]{2}|[0-9][.]"), plain)

    rows = rows.withColumn("_found", F.coalesce(by(lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))), none))
    rows = rows.withColumn("_found", F.transform("_found", lambda t: F.struct(t.alias("t"), kind_of(t).alias("k"))))
    rows = rows.withColumn("_new", F.transform("_found", lambda x: F.struct(x["k"].alias("k"), pseudonym(x["t"], x["k"], key).alias("p"))))
    parts = F.coalesce(by(lambda p: F.split(text, p, -1)), F.array(text))
    new = F.array_join(F.zip_with(parts, F.transform("_new", lambda x: x["p"]), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    held = F.filter("_new", lambda x: x["k"].isNotNull())
    return rows.select(
        "doc_id",
        *[F.size(F.filter("_new", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.transform(held, lambda x: F.concat_ws(":", x["k"], canonical(x["p"], x["k"]))).alias("links"),
        F.when(F.size("_found") > 0, new).otherwise(text).alias("text"),
    )
