"""Personal data under format-preserving Feistel pseudonyms.

Values are found by pattern and checked: card numbers and IBANs by their check
digits, addresses by their octets, dates by the calendar. Each valid one is
permuted under a key within its format: digits stay digits, letters letters,
separators, country codes and top-level domains stay, and check digits are
made anew, so a valid value becomes another valid one. Equal values have equal
pseudonyms in every document, and who holds the key can restore them.

The permutation is a Feistel network over mixed radices: in each round the
places of one parity are shifted by a keyed hash of those of the other.

DataFrame functions only, row by row: no shuffle, any number of documents.
Cards are searched in whole runs of digits, as an expiry, a CVV or another number
may stand beside one. Of the stretches of 13 to 19 digits, in groups of three or
more, whose check digit is right, those are cards that stand first in this order
and overlap none before: written as cards are (one group, or the usual groups),
then with the first digits of an issuer, then from the left, then the longest. Each is
permuted once, so it has one pseudonym whatever stands beside it; the issuer's
digits stay. If a pseudonym would make another stretch of the run a card in its
place, all cards of the run are permuted again until it doesn't, and so going back
finds the same cards.

Dates are permuted among those that are written alike: ISO; day first; month
first where only that is a date; and, with slashes, fields of one digit stay so.
29 February goes to another leap year. Years from FIRST_YEAR on are the domain of 400
years; other dates stay. Octets with leading zeros are no address. Social and
telephone numbers have no check digit: whatever has their form is taken.

The key comes to the executors as the result of a subquery, so plans and event
logs don't show it. Null texts stay null. Texts without such values, empty ones,
null ids, repeated rows and extra columns stay as they are, but for ``n_chars``,
which is counted anew where a text changed (addresses change their length). What
fails its check stays too. An empty table stays empty.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.native import let, renamed

ROUNDS = 10
#: A cycle of the calendar from here on is the domain of dates.
FIRST_YEAR, YEARS = 1800, 400

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/]|-[0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"[0-9]{3,}(?:[ -][0-9]{3,})*"
#: First digits of card issuers, and the groups in which cards are written.
ISSUER = "4|5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720|3[47]|6011|64[4-9]|65|352[89]|35[3-8][0-9]|30[0-5]|3[689]|62|50|5[6-8]|63"
USUAL = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
#: Times that a run's cards are permuted at most until it has the same cards, or a card until it has no issuer; most need one or two.
WALK = 40
#: Digits and separators that cards are searched in, between the other values.
RUN = r"(?<![0-9A-Za-z])[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z])"
ANY = "|".join((EMAIL, DATE, ADDRESS, SOCIAL, IBAN, PHONE))
#: Characters of the shortest and longest card.
CARD_CHARS = (13, 37)


def _permuted(values: Column, radices: Column, key: Column, tweak: str | Column, back: bool = False) -> Column:
    """An array of numbers below their radices, permuted."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def one(v: Column, r: Column) -> Column:
        other = F.array_join(F.filter(v, lambda x, j: j % 2 != r % 2).cast("array<string>"), ",")

        def shifted(o: Column) -> Column:
            shift = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, r.cast("string"), i.cast("string"), o), 256), 1, 12), 16, 10).cast("bigint")
            moved = lambda x, i: F.pmod(x - shift(i) if back else x + shift(i), F.get(radices, i))
            return F.transform(v, lambda x, i: F.when(i % 2 == r % 2, moved(x, i)).otherwise(x))

        return let(other, shifted)

    return F.aggregate(rounds, values.cast("array<bigint>"), one)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("bigint")


def _base(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65).cast("bigint")


def _permuted_text(text: Column, key: Column, tweak: str | Column, back: bool = False) -> Column:
    """Letters and digits of a text permuted, each within its class; the rest stays."""

    def of(cs: Column) -> Column:
        free = F.filter(cs, lambda c: _radix(c) > 1)

        def put(new: Column) -> Column:
            place = lambda i: F.size(F.filter(F.slice(cs, F.lit(1), i), lambda c: _radix(c) > 1))
            return F.array_join(F.transform(cs, lambda c, i: F.when(_radix(c) > 1, F.char(F.get(new, place(i)) + _base(c))).otherwise(c)), "")

        return let(free, lambda f: let(_permuted(F.transform(f, lambda c: F.ascii(c) - _base(c)), F.transform(f, _radix), key, tweak, back), put))

    return let(_chars(text), of)


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10, with the last digit as check digit."""
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.transform(F.reverse(digits), lambda x, i: F.when(i % 2 == 1, twice(x)).otherwise(x)), F.lit(0), lambda n, x: n + x) % 10


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN part, letters as 10 to 35."""
    step = lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_chars(text), F.lit(0), step)


def _email(m: Column, key: Column, back: bool) -> Column:
    return F.concat(_permuted_text(F.regexp_extract(m, r"^(.*)\.[^.]*$", 1), key, "email", back), F.regexp_extract(m, r"(\.[^.]*)$", 1))


_LEAP = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if calendar.isleap(y)]
_DAYS = [(month, day) for month in range(1, 13) for day in range(1, calendar.monthrange(FIRST_YEAR + 1, month)[1] + 1)]


def _numbers(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


#: Ways to write a date: order, widths of the two short fields, and the months and days that can be written so.
#: Month first only counts where day first is no date.
_FORMS = [("ymd", 2, 2, _DAYS)]
_FORMS += [("dmy", w1, w2, [(m, d) for m, d in _DAYS if (w1 == 2 or d < 10) and (w2 == 2 or m < 10)]) for w1 in (2, 1) for w2 in (2, 1)]
_FORMS += [("mdy", w1, 2, [(m, d) for m, d in _DAYS if d > 12 and (w1 == 2 or m < 10)]) for w1 in (2, 1)]


def _date(m: Column, key: Column, back: bool) -> Column:
    """A date permuted among those that are written alike: order and widths of the fields stay."""
    tables = F.array(*(_numbers([100 * month + day for month, day in days]) for *_, days in _FORMS))
    tweaks = F.array(*(F.lit(f"date {order} {w1} {w2}") for order, w1, w2, _ in _FORMS))
    fields = F.transform(F.split(m, "[-/]"), lambda x: F.struct(x.cast("int").alias("n"), F.length(x).alias("w")))

    def read(p: Column) -> Column:
        """Struct (form, y, m, d); form is null where none fits."""
        n, w = (lambda i: F.get(p, F.lit(i))["n"]), (lambda i: F.get(p, F.lit(i))["w"])
        of = {"ymd": (n(0), n(1), n(2)), "dmy": (n(2), n(1), n(0)), "mdy": (n(2), n(0), n(1))}
        form = F.when(F.lit(False), F.lit(None).cast("int"))
        for k, (order, w1, w2, _) in enumerate(_FORMS):
            widths = m.contains("-") if order == "ymd" else ~m.contains("-") & (w(0) == w1) & (w(1) == w2)
            form = form.when(widths & _real_date(*of[order]), F.lit(k))
        part = lambda i: F.when(m.contains("-"), of["ymd"][i]).when(_real_date(*of["dmy"]), of["dmy"][i]).otherwise(of["mdy"][i])
        return F.struct(form.alias("form"), part(0).alias("y"), part(1).alias("m"), part(2).alias("d"))

    def moved(x: Column) -> Column:
        """Struct (y, md): the new year, and month and day as one number."""
        coded, tweak = F.get(tables, x["form"]), F.get(tweaks, x["form"])
        leap = _permuted(F.array((F.array_position(_numbers(_LEAP), x["y"]) - 1).cast("bigint")), F.array(F.lit(len(_LEAP)).cast("bigint")), key, F.concat(tweak, F.lit(" leap")), back)
        index = F.array((x["y"] - FIRST_YEAR).cast("bigint"), (F.array_position(coded, 100 * x["m"] + x["d"]) - 1).cast("bigint"))
        other = _permuted(index, F.array(F.lit(YEARS), F.size(coded)).cast("array<bigint>"), key, tweak, back)
        of_leap = let(leap, lambda v: F.struct(F.get(_numbers(_LEAP), F.get(v, F.lit(0)).cast("int")).alias("y"), F.lit(229).alias("md")))
        of_other = let(other, lambda v: F.struct((F.get(v, F.lit(0)) + FIRST_YEAR).cast("int").alias("y"), F.get(coded, F.get(v, F.lit(1)).cast("int")).alias("md")))
        return F.when((x["m"] == 2) & (x["d"] == 29), of_leap).otherwise(of_other)

    def written(form: Column, new: Column) -> Column:
        year, month, day = new["y"].cast("string"), F.floor(new["md"] / 100).cast("string"), (new["md"] % 100).cast("string")
        field = lambda x, w: F.lpad(x, 2, "0") if w == 2 else x
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for k, (order, w1, w2, _) in enumerate(_FORMS):
            shown = {"ymd": (year, field(month, 2), field(day, 2)), "dmy": (field(day, w1), field(month, w2), year), "mdy": (field(month, w1), field(day, w2), year)}[order]
            out = out.when(form == k, F.concat_ws("-" if order == "ymd" else "/", *shown))
        return out

    fits = lambda x: x["form"].isNotNull() & x["y"].between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    return let(let(fields, read), lambda x: F.when(fits(x), let(moved(x), lambda new: written(x["form"], new))).otherwise(m))


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """Whether these numbers are a date of the calendar."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last)


def _address(m: Column, key: Column, back: bool) -> Column:
    octets = F.split(m, r"\.").cast("array<bigint>")
    moved = lambda o: F.array_join(_permuted(o, F.array_repeat(F.lit(256).cast("bigint"), F.lit(4)), key, "address", back).cast("array<string>"), ".")
    return let(octets, lambda o: F.when(F.exists(o, lambda x: x > 255) | m.rlike(r"(?:^|\.)0[0-9]"), m).otherwise(moved(o)))


def _card(m: Column, key: Column, back: bool) -> Column:
    """The issuer's digits stay, the others but the last are permuted; the last is the Luhn digit again.

    A card of no issuer becomes another of none: it is permuted until it is one.
    """
    issuer = F.regexp_extract(m, f"^(?:{ISSUER})?", 0)
    check = lambda b: F.concat(b, ((10 - _luhn(F.concat(_digits(b), F.array(F.lit(0))))) % 10).cast("string"))

    def once(t: Column) -> Column:
        rest = F.regexp_extract(t.substr(F.length(issuer) + 1, F.length(t)), r"(?s)^(.*)[0-9]$", 1)
        return F.concat(issuer, _permuted_text(rest, key, F.concat(F.lit("card "), issuer), back))

    def step(a: Column, _: Column) -> Column:
        new = lambda b: F.struct(check(b).alias("t"), ((issuer != "") | ~b.rlike(f"^(?:{ISSUER})")).alias("done"))
        return F.when(a["done"], a).otherwise(let(once(a["t"]), new))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(m.alias("t"), F.lit(False).alias("done")), step)["t"]


def _picked(run: Column) -> Column:
    """(i, n) of the cards in a run of digits and separators, from left to right."""

    def of(cs: Column) -> Column:
        digit = lambda i: F.coalesce(F.get(cs, i).rlike("[0-9]"), F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: digit(i) & ((i == 0) | ~digit(i - 1)))
        lens = F.sequence(F.lit(CARD_CHARS[0]), F.lit(CARD_CHARS[1]))
        part = lambda i, n: F.array_join(F.slice(cs, i + 1, n), "")
        fits = lambda i, n: (i + n <= F.size(cs)) & ~digit(i + n) & digit(i + n - 1) & let(part(i, n), lambda t: t.rlike(f"^{CARD}$") & F.length(F.regexp_replace(t, "[ -]", "")).between(13, 19) & (_luhn(_digits(t)) == 0))
        unlike = lambda t: F.when(t.rlike(f"^(?:{USUAL})$"), 0).otherwise(2) + F.when(t.rlike(f"^(?:{ISSUER})"), 0).otherwise(1)
        at = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lens, lambda n: fits(i, n)), lambda n: F.struct(unlike(part(i, n)).alias("unlike"), i.alias("i"), (-n).alias("less")))))
        none = F.array().cast("array<struct<i:int,n:int>>")
        clear = lambda a, c: ~F.exists(a, lambda x: (x["i"] < c["i"] - c["less"]) & (c["i"] < x["i"] + x["n"]))
        taken = F.aggregate(F.sort_array(at), none, lambda a, c: F.when(clear(a, c), F.concat(a, F.array(F.struct(c["i"].alias("i"), (-c["less"]).alias("n"))))).otherwise(a))
        return F.sort_array(taken)

    return let(_chars(run), of)


def _cards(run: Column, key: Column, back: bool) -> Column:
    """Struct (text, n) of a run of digits and separators: its cards permuted, and how many."""

    def moved(text: Column, picked: Column) -> Column:
        def one(t: Column, c: Column) -> Column:
            new = _card(t.substr(c["i"] + 1, c["n"]), key, back)
            return F.concat(t.substr(F.lit(1), c["i"]), new, t.substr(c["i"] + c["n"] + 1, F.length(t)))

        return F.aggregate(picked, text, one)

    def walk(picked: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            again = lambda t: F.struct(t.alias("text"), (_picked(t) == picked).alias("done"))
            return F.when(a["done"], a).otherwise(let(moved(a["text"], picked), again))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(run.alias("text"), F.lit(False).alias("done")), step)
        return F.struct(F.when(F.size(picked) > 0, found["text"]).otherwise(run).alias("text"), F.size(picked).alias("n"))

    return let(_picked(run), walk)


def _with_cards(part: Column, key: Column, back: bool) -> Column:
    """Struct (text, n) of text between other values."""

    def join(found: Column) -> Column:
        put = lambda new: F.struct(
            F.array_join(F.transform(F.split(part, RUN, -1), lambda p, i: F.concat(p, F.coalesce(F.get(new, i)["text"], F.lit("")))), "").alias("text"),
            F.aggregate(new, F.lit(0), lambda n, x: n + x["n"]).alias("n"),
        )
        return let(F.transform(found, lambda r: _cards(r, key, back)), put)

    return F.when(part.rlike(RUN), let(F.regexp_extract_all(part, F.lit(RUN), F.lit(0)), join)).otherwise(F.struct(part.alias("text"), F.lit(0).alias("n")))


def _iban(m: Column, key: Column, back: bool) -> Column:
    """The account part is permuted, the country stays, the check digits follow."""
    country = F.substring(m, 1, 2)
    tail = F.regexp_extract(m, r"(?s)^.{4}(.*)$", 1)
    plain = lambda x: F.regexp_replace(x, " ", "")
    valid = _mod97(F.concat(plain(tail), F.substring(m, 1, 4))) == 1
    check = lambda t: F.lpad((98 - _mod97(F.concat(plain(t), country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, let(_permuted_text(tail, key, "iban", back), lambda t: F.concat(country, check(t), t))).otherwise(m)


def _phone(m: Column, key: Column, back: bool) -> Column:
    lead = r"^(\+[0-9]{1,3}(?=[ .-]|\()[ .-]?|\+[0-9]|1[ .-](?=[0-9]{3}[.-])|)"
    return F.concat(F.regexp_extract(m, lead, 1), _permuted_text(F.regexp_replace(m, lead, ""), key, "phone", back))


def pseudonym(m: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of a found value, or the value if it fails its check. ``back`` restores."""
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(m.contains("@"), _email(m, key, back))
        .when(whole(DATE), _date(m, key, back))
        .when(whole(ADDRESS), _address(m, key, back))
        .when(whole(SOCIAL), _permuted_text(m, key, "social", back))
        .when(m.rlike("^[A-Z]{2}"), _iban(m, key, back))
        .when(whole(PHONE), _phone(m, key, back))
        .otherwise(m)
    )


def replaced(text: Column, key: Column, back: bool = False) -> Column:
    """Struct (text, n): the text with pseudonyms, and how many values changed."""

    def join(parts: Column) -> Column:
        def with_found(found: Column) -> Column:
            changed = lambda n: F.size(F.filter(F.arrays_zip(n.alias("n"), found.alias("m")), lambda x: x["n"] != x["m"]))
            put = lambda n, p: F.struct(F.array_join(F.transform(p, lambda x, i: F.concat(x["text"], F.coalesce(F.get(n, i), F.lit("")))), "").alias("text"), F.aggregate(p, changed(n), lambda k, x: k + x["n"]).cast("long").alias("n"))
            return let(F.transform(found, lambda m: pseudonym(m, key, back)), lambda n: let(F.transform(parts, lambda p: _with_cards(p, key, back)), lambda p: put(n, p)))

        return let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), with_found)

    some = text.rlike("[0-9@]") & (text.rlike(ANY) | text.rlike(RUN))
    return F.when(some, let(F.split(text, ANY, -1), join)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def pseudonymise(docs: DataFrame, key: str, back: bool = False, count: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all columns stay, with ``n_chars`` counted anew where a text changed.

    ``count`` names a column for the number of values.
    """
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    names, docs = docs.columns, renamed(docs, "text", "n_chars")
    rows = docs.withColumn("__key", secret).withColumn("__p", replaced(F.col("text"), F.col("__key"), back))
    changed = F.col("__p.n") > 0
    n_chars = lambda c: F.when(changed, F.length("__p.text").cast(docs.schema[c].dataType)).otherwise(F.col(c))
    cols = [F.col("__p.text") if c == "text" else n_chars(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*(c.alias(n) for c, n in zip(cols, names, strict=True)), *([F.col("__p.n").alias(count)] if count else []))
