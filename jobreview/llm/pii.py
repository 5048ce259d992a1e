"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Found and validated: e-mail addresses, payment card numbers (13 to 19 digits,
Luhn), North American phone numbers, IPv4 addresses, dates (year first with
hyphens or slashes, or day and month first with slashes or dots; where that is no
date, month and day first). A value is read as a row of symbols, each with the size of its
alphabet: digits, letters of one case, address bytes, and for a date its day
number in two parts. A Feistel network permutes the symbols: every round adds
keyed hashes of the half that stays to the symbols of the other half, each
within its alphabet. So a value keeps its format, its separators and its
validity; equal values get equal pseudonyms in all documents; and who has the
key can invert it. A card gets a new check digit. A date stays a date between
``FIRST_DAY`` and ``LAST_DAY``, in the form that it had: a day or month written with
one digit keeps one digit, and a date that only reads with its month first keeps a
day above 12. What falls outside of the days with such a form is permuted again
until it is one of them (cycle walking), so that the permutation stays one to one.
The key has no default: who knows it can undo all pseudonyms.

Texts are cut wherever a value may start. At each start, from the left, the
kinds are tried in turn, for cards the usual groupings before any other and
longer ones before shorter ones; the first that passes its validation is the
value, and starts within it do not count. A start without one stays as it is
and hides nothing after it.

Defined results: null texts stay null with counts of zero; empty texts stay;
rows are treated one by one; values that overlap are read from the left, the
first kind that holds first; numbers side by side may
join into a card by chance, in a pseudonym too, which ``inverse`` then reads as
that card; other columns are carried along, and new ones get an
underscore where a name is taken; an empty table gives an empty result. Values
that touch letters, digits or underscores are not values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.llm.common import fresh

ROUNDS = 8
# 73,049 days, in two parts of 319 and 229: two numbers too many, so that two more
# steps always lead back to a day.
FIRST_DAY, LAST_DAY, DAYS = "1900-01-01", "2099-12-31", 73_049
DAY_PARTS, DAY_STEPS = (319, 229), 2
# Days above 12: 2,400 months and 19 days, of which one in 12 does not exist.
MONTH_PARTS = (2_400, 19)
# Of the days in general 22 of 100 have a day and a month of one digit, of the late
# ones two of three have such a month: so many steps lead to one of them but with a
# probability of 10**-32.
WALK_STEPS = 300

BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<!\d\.)(?:{BYTE}\.){{3}}{BYTE}(?!\.?\d)",
    "date": r"(?:(?:19|20)\d\d([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?<!\d\.)(?:0?[1-9]|[12]\d|3[01])([/.])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d)",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
KINDS = ("email", "ip", "date", "card", "phone")
# Tried in this order: a solid run, 4-4-4-4 and 4-6-5, then any grouping.
CARDS = (
    r"\d{13,19}",
    r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}",
    r"\d{4}([ -])\d{6}\1\d{5}",
    *[rf"\d(?:[ -]?\d){{{n - 1}}}" for n in range(19, 12, -1)],
)
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# No value but an e-mail address is longer, what it looks ahead at included.
CONTEXT = 48
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def start_pattern() -> str:
    """The empty place before any value, which is neither after nor before a
    letter, digit or underscore."""
    return BEFORE + "(?=(?:" + "|".join(PATTERNS.values()) + ")" + AFTER + ")"


def _hash(key: str, kind: Column, step: Column, at: Column, rest: Column) -> Column:
    """48 keyed bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, step, at, rest), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(symbols: Column, sizes: Column, kind: Column, key: str, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """A permutation of the rows of symbols with these alphabet sizes. Each
    round changes the symbols at odd or at even places by what stands at the
    others; a single symbol is shifted."""

    def step(state: Column, number: Column) -> Column:
        rest = F.array_join(
            F.transform(state, lambda s, i: F.when(i % 2 != number % 2, s.cast("string")).otherwise(F.lit("*"))), ","
        )

        def moved(s: Column, i: Column) -> Column:
            size = F.get(sizes, i)
            add = F.pmod(_hash(key, kind, number, i, rest), size)
            return F.when(i % 2 == number % 2, F.pmod(s - add if inverse else s + add, size)).otherwise(s)

        return F.transform(state, moved)

    numbers = F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(F.reverse(numbers) if inverse else numbers, symbols, step)


def _position(char: Column) -> Column:
    """Place of a character in its alphabet."""
    code = F.ascii(char).cast("long")
    return F.when(char.rlike("[0-9]"), code - 48).when(char.rlike("[a-z]"), code - 97).when(char.rlike("[A-Z]"), code - 65)


def _size(char: Column) -> Column:
    return F.when(char.rlike("[0-9]"), F.lit(10)).when(char.rlike("[a-zA-Z]"), F.lit(26)).cast("long")


def _char(symbol: Column, like: Column) -> Column:
    """The character of a symbol in the alphabet of ``like``."""
    base = F.when(like.rlike("[0-9]"), F.lit(48)).when(like.rlike("[a-z]"), F.lit(97)).otherwise(F.lit(65))
    return F.char(base + symbol)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted_chars(text: Column, kind: str, key: str, pattern: str, inverse: bool) -> Column:
    """``text`` with the characters that ``pattern`` matches permuted within
    their alphabets, all others in place."""
    chars = _chars(text)
    moving = F.filter(chars, lambda c: c.rlike(pattern))
    new = feistel(F.transform(moving, _position), F.transform(moving, _size), F.lit(kind), key, inverse=inverse)
    made = F.zip_with(new, moving, _char)
    # Between the moving characters stands what splits them.
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _digits_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one not doubled."""
    n = F.size(digits)

    def weighted(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(digits, weighted), F.lit(0).cast("long"), lambda a, b: a + b)


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("long"))


def luhn_holds(text: Column) -> Column:
    return _digits_sum(_digits(text)) % 10 == 0


def _card(text: Column, key: str, inverse: bool) -> Column:
    """All digits but the last are permuted, the last becomes the check digit."""
    head = F.regexp_replace(text, "[0-9]$", "")
    moved = _permuted_chars(head, "card", key, "[0-9]", inverse)
    check = F.pmod(-_digits_sum(_digits(F.concat(moved, F.lit("0")))), F.lit(10))
    return F.concat(moved, check.cast("string"))


def _ip(text: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    sizes = F.transform(parts, lambda p: F.lit(256).cast("long"))
    return F.array_join(feistel(parts, sizes, F.lit("ip"), key, inverse=inverse), ".")


def _year_first(text: Column) -> Column:
    return text.rlike(r"^\d{4}[-/]")


def _readings(text: Column) -> tuple[Column, Column]:
    """The date in the order that a reader tries first, and with the month first;
    null where the calendar has none."""
    plain = F.regexp_replace(text, r"[/.]", "-")
    usual = F.when(_year_first(text), F.try_to_date(plain, "yyyy-MM-dd")).otherwise(F.try_to_date(plain, "d-M-yyyy"))
    return usual, F.when(~_year_first(text), F.try_to_date(plain, "M-d-yyyy"))


def _date_of(text: Column) -> Column:
    """The date, null where the calendar has none."""
    return F.coalesce(*_readings(text))


def _walked(parts: Column, sizes: tuple[int, int], kind: str, key: str, inverse: bool, steps: Column, outside) -> Column:
    """The permutation of ``parts``, again as long as it is ``outside``."""
    alphabet = F.array(*[F.lit(p).cast("long") for p in sizes])

    def moved(state: Column) -> Column:
        return feistel(state, alphabet, F.lit(kind), key, inverse=inverse)

    return F.aggregate(F.sequence(F.lit(1), steps), moved(parts), lambda s, _: F.when(outside(s), moved(s)).otherwise(s))


def _moved_day(date: Column, key: str, inverse: bool, short_day: Column, short_month: Column) -> Column:
    """Any day to any day; with ``short_day`` and ``short_month`` those of one
    digit among themselves."""
    first, low = F.lit(FIRST_DAY).cast("date"), F.lit(DAY_PARTS[1])
    day = F.datediff(date, first).cast("long")
    parts = F.array(F.floor(day / low).cast("long"), day % low)

    def made(p: Column) -> Column:
        return F.date_add(first, (F.get(p, F.lit(0)) * low + F.get(p, F.lit(1))).cast("int"))

    def outside(p: Column) -> Column:
        too_long = (short_day & (F.dayofmonth(made(p)) > 9)) | (short_month & (F.month(made(p)) > 9))
        return (made(p) > F.lit(LAST_DAY).cast("date")) | too_long

    steps = F.when(short_day | short_month, WALK_STEPS).otherwise(DAY_STEPS)
    walked = F.array(_walked(parts, DAY_PARTS, "date", key, inverse, steps, outside))
    return F.get(F.transform(walked, made), F.lit(0))


def _moved_late_day(date: Column, key: str, inverse: bool, short_month: Column) -> Column:
    """A day above 12 of its month to another such day."""
    first = F.lit(FIRST_DAY).cast("date")
    month = ((F.year(date) - int(FIRST_DAY[:4])) * 12 + F.month(date) - 1).cast("long")
    parts = F.array(month, (F.dayofmonth(date) - 13).cast("long"))

    def start(p: Column) -> Column:
        return F.add_months(first, F.get(p, F.lit(0)).cast("int"))

    def outside(p: Column) -> Column:
        none = F.get(p, F.lit(1)) + 13 > F.dayofmonth(F.last_day(start(p)))
        return none | (short_month & (F.get(p, F.lit(0)) % 12 > 8))

    walked = F.array(_walked(parts, MONTH_PARTS, "late day", key, inverse, F.lit(WALK_STEPS), outside))
    return F.get(F.transform(walked, lambda p: F.date_add(start(p), (F.get(p, F.lit(1)) + 12).cast("int"))), F.lit(0))


def _date(text: Column, key: str, inverse: bool) -> Column:
    usual, month_first = _readings(text)
    swapped = usual.isNull()
    short_one, short_two = text.rlike(r"^\d[/.]"), text.rlike(r"[/.]\d[/.]")
    # A one-element transform makes the permutation once for all uses.
    made = F.when(swapped, _moved_late_day(month_first, key, inverse, short_one)).otherwise(
        _moved_day(usual, key, inverse, short_one, short_two)
    )
    mark = F.regexp_extract(text, "[-/.]", 0)

    def written_as(date: Column) -> Column:
        one = F.when(swapped, F.month(date)).otherwise(F.dayofmonth(date)).cast("string")
        two = F.when(swapped, F.dayofmonth(date)).otherwise(F.month(date)).cast("string")
        one = F.when(short_one, one).otherwise(F.lpad(one, 2, "0"))
        two = F.when(short_two, two).otherwise(F.lpad(two, 2, "0"))
        year = F.date_format(date, "yyyy")
        return F.when(
            _year_first(text), F.concat(year, mark, F.date_format(date, "MM"), mark, F.date_format(date, "dd"))
        ).otherwise(F.concat(one, mark, two, mark, year))

    return F.get(F.transform(F.array(made), written_as), F.lit(0))


def _email(text: Column, key: str, inverse: bool) -> Column:
    """The local part; the domain stays."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    return F.concat(_permuted_chars(local, "email", key, "[A-Za-z0-9]", inverse), F.lit("@"), domain)


def _phone(text: Column, key: str, inverse: bool) -> Column:
    """The country code stays; the first digits of area and exchange, which are
    neither 0 nor 1, have an alphabet of eight."""
    prefix = F.regexp_extract(text, r"^(\+?1[ .-]?)?", 0)
    rest = F.substring(text, F.length(prefix) + 1, F.length(text))
    least = F.array(*[F.lit(2 if i in (0, 3) else 0).cast("long") for i in range(10)])
    sizes = F.transform(least, lambda low: 10 - low)
    symbols = F.zip_with(_digits(rest), least, lambda d, low: d - low)
    new = F.zip_with(feistel(symbols, sizes, F.lit("phone"), key, inverse=inverse), least, lambda d, low: d + low)
    between = F.split(rest, "[0-9]", -1)
    return F.concat(prefix, F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b.cast("string"), F.lit("")))), ""))


def value_at(context: Column) -> Column:
    """(kind, value) of the first value that ``context`` begins with and that
    passes its validation, or null."""
    forms = [(kind, form) for kind in PATTERNS for form in (CARDS if kind == "card" else (PATTERNS[kind],))]
    tried = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.regexp_extract(context, f"^(?:{form}){AFTER}", 0).alias("value"))
            for kind, form in forms
        ]
    )

    def holds(found: Column) -> Column:
        value, kind = found["value"], found["kind"]
        valid = F.when(kind == "date", _date_of(value).isNotNull()).when(kind == "card", luhn_holds(value))
        return F.when(value == "", False).otherwise(valid.otherwise(True))

    return F.get(F.filter(tried, holds), F.lit(0))


def segments(text: Column) -> Column:
    """The text as (kind, value, after): a value, or none, and the text up to
    the next one; empty if nothing is found."""
    start = start_pattern()
    # Groups 1 and 2 are the separators of dates.
    ahead = rf"(?=({PATTERNS['email']}{AFTER}|(?s:.{{1,{CONTEXT}}})))"
    found = F.transform(F.regexp_extract_all(text, F.lit(start + ahead), F.lit(3)), value_at)
    pieces = F.split(text, start, -1)
    nothing = F.lit(None).cast("struct<kind:string,value:string>")
    # A text that begins with a value has no piece before it.
    found_at = F.when(F.size(pieces) > F.size(found), F.concat(F.array(nothing), found)).otherwise(found)
    steps = F.zip_with(pieces, found_at, lambda p, v: F.struct(p.alias("piece"), v["kind"].alias("kind"), v["value"].alias("value")))
    kind = "array<struct<kind:string,value:string,after:string>>"

    def step(state: Column, s: Column) -> Column:
        """``covered``: characters of the pieces to come that a value has taken."""
        covered, n = state["covered"], F.length(s["piece"])
        taken = F.when(covered > 0, 0).otherwise(F.coalesce(F.length(s["value"]), F.lit(0)))
        inside = covered > 0
        after = F.substring(s["piece"], F.greatest(covered, taken) + 1, n)
        none = F.lit(None).cast("string")
        one = F.struct(
            F.when(inside, none).otherwise(s["kind"]).alias("kind"),
            F.when(inside, none).otherwise(s["value"]).alias("value"),
            after.alias("after"),
        )
        out = F.when(covered >= n, state["out"]).otherwise(F.concat(state["out"], F.array(one)))
        left = F.greatest(F.greatest(covered, taken) - n, F.lit(0))
        return F.struct(left.alias("covered"), out.alias("out"))

    first = F.struct(F.lit(0).alias("covered"), F.array().cast(kind).alias("out"))
    whole = F.aggregate(steps, first, step, lambda state: state["out"])
    return F.when(F.exists(found, lambda v: v.isNotNull()), whole).otherwise(F.array().cast(kind))


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a value of a kind; the value itself for no kind. With
    ``inverse`` the value of a pseudonym."""
    return (
        F.when(kind == "email", _email(value, key, inverse))
        .when(kind == "ip", _ip(value, key, inverse))
        .when(kind == "date", _date(value, key, inverse))
        .when(kind == "phone", _phone(value, key, inverse))
        .when(kind == "card", _card(value, key, inverse))
        .otherwise(value)
    )


def _of(kind: str):
    return lambda value: value["kind"] == kind


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its text, and the counts ``n_<kind>``."""
    text = F.col(f"`{text_col}`")
    found, counts = fresh(docs, "pii_values"), {kind: fresh(docs, f"n_{kind}") for kind in KINDS}
    # Only texts with a digit or an @ can hold a value; the others skip the pattern.
    may = text.rlike("[0-9@]")
    nothing = F.array().cast("array<struct<kind:string,value:string,after:string>>")
    rows = docs.withColumn(found, F.when(may, segments(text)).otherwise(nothing))
    made = F.transform(
        F.col(found), lambda v: F.concat(F.coalesce(pseudonym(v["value"], v["kind"], key, inverse), F.lit("")), v["after"])
    )
    new = F.when(F.coalesce(F.size(found) > 0, F.lit(False)), F.array_join(made, "")).otherwise(text)
    count = {
        name: F.coalesce(F.size(F.filter(F.col(found), _of(kind))), F.lit(0)).cast("long")
        for kind, name in counts.items()
    }
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, *[F.when(text.isNull(), F.lit(0).cast("long")).otherwise(v).alias(k) for k, v in count.items()])
