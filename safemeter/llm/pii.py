"""Personal data replaced by format-preserving pseudonyms of a keyed Feistel network.

Everything is a column expression.  Numbers and dates that pass their own validation
(issuer and Luhn, IBAN check digits, octet range, calendar, issued number ranges) are permuted
within their format: a pseudonym is valid again, the permutation depends only on key, kind
and value, so equal values stay linked across documents and different values stay apart.
Candidates that fail validation are left alone.  The local part of an e-mail address and
assigned secrets are permuted the same way, character by character within digits, lower
and upper case.

A value becomes an array of cells, each below its own radix; the cells are chosen so that
every filling of them is valid.  A round adds a keyed hash (HMAC-SHA256) of one half to the
other half, cell by cell, modulo the radices; ``ROUNDS`` rounds alternate the halves.  Every
round can be undone, so the whole is a permutation.  Where a few fillings are not valid, the
permutation is walked on until it is (``WALKS``).  The key reaches the tasks as the result of
a subquery: plans and event logs do not show it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_name

ROUNDS = 8
#: Steps of a walk; a step goes on with a chance of a thousandth or less, so that no walk ends early in practice.
WALKS = 24
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")

# The formats that are looked for, in order of precedence.
_OPEN, _SHUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "secret": r"""(?i:(?<![\p{L}\p{N}])(?:token|secret|api_?key|passwd|password)\s{0,3}[:=]\s{0,3}["']?[a-z0-9_+/-]{16,}+)""",
    "iban": _OPEN + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _SHUT,
    "ip": r"(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.[0-9])",
    "date": _OPEN + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:" + _SHUT + r"|(?=[Tt](?:[01][0-9]|2[0-4])))",
    "ssn": _OPEN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _SHUT,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _SHUT,
    "card": _OPEN + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}(?:\1[0-9]{4}){2}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})" + _SHUT,
}
_CARD_ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12})$"
#: 400 years of the calendar: 146,097 days, the product of the two radices.
_FIRST_DAY, _DAY_RADICES = "1800-01-01", (189, 773)
_YEARS = range(1800, 2200)
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _pattern() -> str:
    """All formats in one pattern; the two back references are renumbered to named groups."""
    card = FORMATS["card"].replace(r"([ -])", "(?<a>[ -])", 1).replace(r"([ -])", "(?<b>[ -])", 1).replace(r"\1", r"\k<a>").replace(r"\2", r"\k<b>")
    return "|".join([FORMATS[k] for k in KINDS[:-1]] + [card])


PATTERN = _pattern()


def _text(column: Column) -> Column:
    return F.array_join(column, "")


def _cells(text: Column) -> Column:
    """The characters of ``text``."""
    return F.split(text, "(?!^)(?!$)")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Key:
    """Keyed hashing by columns that hold the two padded forms of an HMAC key."""

    def __init__(self, inner: Column, outer: Column):
        self.inner, self.outer = inner, outer

    @staticmethod
    def padded(key: str) -> tuple[bytes, bytes]:
        raw = key.encode()
        raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        return bytes(c ^ 0x36 for c in raw), bytes(c ^ 0x5C for c in raw)

    def digest(self, message: Column) -> Column:
        """HMAC-SHA256 in hexadecimal digits."""
        within = F.unhex(F.sha2(F.concat(self.inner, message.cast("binary")), 256))
        return F.sha2(F.concat(self.outer, within), 256)


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """One row: ``inner``, ``outer``.  Rows given by the driver are data, which no plan prints."""
    return spark.createDataFrame([tuple(map(bytearray, Key.padded(key)))], "inner binary, outer binary")


def feistel(cells: Column, radices: Column, key: Key, tweak: Column) -> Column:
    """The array ``cells`` (ints, each from 0 to its radix less 1) permuted under ``key`` and ``tweak``."""
    given = F.struct(cells.cast("array<int>").alias("cells"), radices.cast("array<int>").alias("radices"), tweak.alias("tweak"))
    return _let(given, lambda x: _rounds(x["cells"], x["radices"], key, x["tweak"]))


def _rounds(cells: Column, radices: Column, key: Key, tweak: Column) -> Column:
    n = F.size(cells)
    half = F.floor(n / 2).cast("int")

    def one_round(state: Column, r: Column) -> Column:
        odd = r % 2 == 1
        seen = F.when(odd, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, 1, half))
        digest = key.digest(F.concat_ws("|", tweak, r.cast("string"), n.cast("string"), F.array_join(seen.cast("array<string>"), ",")))

        def moved(d: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                added = F.conv(d.substr(F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when((i < half) == odd, F.pmod(x + added, F.element_at(radices, i + 1))).otherwise(x)

            return F.transform(state, step)

        return _let(digest, moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), cells, one_round)


def _walked(value: Column, step, valid) -> Column:
    """``step`` of ``value``, and of that again as long as the result is not valid: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), step(value), lambda x, _: F.when(valid(x), x).otherwise(step(x)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, key: Key, kind: str) -> Column:
    cells = _cells(digits).cast("array<int>")
    return _text(feistel(cells, F.transform(cells, lambda _: F.lit(10)), key, F.lit(kind)).cast("array<string>"))


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    gaps = F.split(shape, "[0-9]", -1)
    return _text(F.zip_with(gaps, _cells(digits), lambda gap, d: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(d, F.lit("")))))


def _permuted_letters(text: Column, key: Key, kind: str) -> Column:
    """Digits, lower and upper case ASCII letters permuted within themselves; other characters stay."""
    code = F.transform(_cells(text), lambda c: F.struct(c.alias("c"), F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65).otherwise(0).alias("base")))
    value = F.transform(code, lambda x: F.when(x["base"] > 0, F.ascii(x["c"]) - x["base"]).otherwise(0))
    radix = F.transform(code, lambda x: F.when(x["base"] == 48, 10).when(x["base"] > 0, 26).otherwise(1))
    fixed = F.array_join(F.transform(code, lambda x: F.when(x["base"] > 0, F.lit("")).otherwise(x["c"])), "")
    moved = feistel(value, radix, key, F.concat_ws("|", F.lit(kind), fixed))
    return _text(F.zip_with(code, moved, lambda x, v: F.when(x["base"] > 0, F.chr(v + x["base"])).otherwise(x["c"])))


def _permuted_hex(text: Column, upper: Column, key: Key, kind: str) -> Column:
    cells = F.transform(_cells(F.lower(text)), lambda c: F.conv(c, 16, 10).cast("int"))
    moved = feistel(cells, F.transform(cells, lambda _: F.lit(16)), key, F.lit(kind))
    low = _text(F.transform(moved, lambda v: F.lower(F.hex(v.cast("long")))))
    return F.when(upper, F.upper(low)).otherwise(low)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum: the last digit counts once, every second one from the right twice."""
    cells = F.reverse(_cells(digits).cast("array<int>"))
    worth = F.transform(cells, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d)


def _luhn_digit(payload: Column) -> Column:
    return F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")


def _iban_remainder(iban: Column) -> Column:
    """Remainder by 97 of the rearranged account number."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(_cells(turned), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _email(m: Column, key: Key) -> Column:
    """The local part is permuted; one with other than ASCII characters, or that the permutation leaves as it is, becomes a keyed digest."""
    local = F.substring_index(m, "@", 1)
    name = F.substring(key.digest(F.concat_ws("|", F.lit("email digest"), local)), 1, 32)
    plain = _let(_permuted_letters(local, key, "email"), lambda x: F.when(x == local, name).otherwise(x))
    return F.concat(F.when(local.rlike(r"[^\x00-\x7F]"), name).otherwise(plain), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: Key) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/-]+$", 0)
    name = m.substr(F.lit(1), F.length(m) - F.length(value))
    hexed = lambda x: x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & x.rlike("[0-9]") & x.rlike("[A-Fa-f]")
    # numbers in hexadecimal stay such, with a digit and a letter, and no other secret becomes one
    as_hex = _walked(value, lambda x: _permuted_hex(x, value.rlike("[A-F]"), key, "secret"), hexed)
    other = _walked(value, lambda x: _permuted_letters(x, key, "secret"), lambda x: ~hexed(x))
    return F.when(value.rlike("[0-9]"), F.concat(name, F.when(hexed(value), as_hex).otherwise(other)))


def _iban(m: Column, key: Key) -> Column:
    iban = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substring(m, 1, 2), iban.substr(F.lit(5), F.length(iban))
    check = lambda x: F.lpad((98 - _iban_remainder(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0")
    gaps = F.split(m, "[A-Z0-9]", -1)
    flat = _let(_permuted_letters(account, key, "iban"), lambda moved: F.concat(country, check(moved), moved))
    spaced = _text(F.zip_with(gaps, _cells(flat), lambda gap, c: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(c, F.lit("")))))
    return F.when((F.substring(iban, 3, 2) == check(account)) & F.length(iban).between(15, 34), spaced)


#: Addresses that name no host and so stay.
_NO_HOST = ("0.0.0.0", "127.0.0.1", "255.255.255.255")


def _ip(m: Column, key: Key) -> Column:
    def step(x: Column) -> Column:
        cells = F.split(x, r"\.").cast("array<int>")
        return F.array_join(feistel(cells, F.transform(cells, lambda _: F.lit(256)), key, F.lit("ip")).cast("array<string>"), ".")

    named = lambda x: ~x.isin(*_NO_HOST)
    return F.when(named(m), _walked(m, step, named))


def _days_past_12(year: Column, month: Column, day: Column) -> Column:
    """Rank of a day above 12 among such days of its year; null if there is no such day."""
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    return F.dayofyear(date) - 12 * F.month(date) - 1


def _slash_date(first: Column, second: Column, year: Column, key: Key) -> Column:
    """Permuted within what can be told from the writing alone.

    With both numbers up to 12 either may be the month: 12 by 12 by 400 values.  Otherwise
    the number above 12 is the day, and the days above 12 of leap and of other years are
    permuted among themselves.
    """
    y, a, b = year.cast("int"), first.cast("int"), second.cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    known = y.between(_YEARS[0], _YEARS[-1])
    free = feistel(F.array(a - 1, b - 1, y - _YEARS[0]), F.array(F.lit(12), F.lit(12), F.lit(len(_YEARS))), key, F.lit("date 12/12"))
    either = _let(free, lambda x: F.concat_ws("/", two(x[0] + 1), two(x[1] + 1), (x[2] + _YEARS[0]).cast("string")))

    def above(leap: bool) -> Column:
        years = [k for k in _YEARS if (k % 4 == 0 and k % 100 != 0 or k % 400 == 0) == leap]
        listed = F.array(*map(F.lit, years))
        before, ends = 0, []  # how many days above 12 the months up to each have
        for size in (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31):
            before += size - 12
            ends.append(before)
        day_first = a > 12
        rank = _days_past_12(year, F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second))
        cells = F.array((F.array_position(listed, y) - 1).cast("int"), rank.cast("int"))

        def shown(new: Column) -> Column:
            month = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= new[1]))
            day = new[1] - F.when(month > 0, F.element_at(F.array(*map(F.lit, ends)), F.greatest(month, F.lit(1)))).otherwise(0) + 13
            pair = F.when(day_first, F.concat_ws("/", two(day), two(month + 1))).otherwise(F.concat_ws("/", two(month + 1), two(day)))
            return F.concat_ws("/", pair, F.element_at(listed, new[0] + 1).cast("string"))

        return F.when(rank.isNotNull(), _let(feistel(cells, F.array(F.lit(len(years)), F.lit(before)), key, F.lit("date over 12")), shown))

    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    both = a.between(1, 12) & b.between(1, 12)
    return F.when(known & both, either).when(known & ((a > 12) != (b > 12)), F.when(leap, above(True)).otherwise(above(False)))


def _date(m: Column, key: Key) -> Column:
    def moved(year: Column, month: Column, day: Column, shape: str) -> Column:
        at = F.datediff(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))
        a, b = _DAY_RADICES
        cells = F.array(F.floor(at / b).cast("int"), at % b)
        number = _let(feistel(cells, F.array(F.lit(a), F.lit(b)), key, F.lit("date")), lambda new: new[0] * b + new[1])
        return F.when(at.between(0, a * b - 1), F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), number), shape))

    s = lambda i, n: F.substring(m, i, n)
    return (
        F.when(m.rlike(r"^\d{4}-"), moved(s(1, 4), s(6, 2), s(9, 2), "yyyy-MM-dd"))
        .when(m.rlike(r"^\d{4}/"), moved(s(1, 4), s(6, 2), s(9, 2), "yyyy/MM/dd"))
        .when(m.rlike(r"^\d{2}\."), moved(s(7, 4), s(4, 2), s(1, 2), "dd.MM.yyyy"))
        .otherwise(_slash_date(s(1, 2), s(4, 2), s(7, 4), key))
    )


def _ssn(m: Column, key: Key) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: 898 by 99 by 9999 values."""
    area, group, serial = (F.substring(m, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    cells = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(cells, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn"))
    out = _let(new, lambda x: F.format_string("%03d-%02d-%04d", x[0] + F.when(x[0] >= 665, 2).otherwise(1), x[1] + 1, x[2] + 1))
    return F.when(~m.rlike(r"^(?:000|666|9..)|-00-|-0000$"), out)


def _phone(m: Column, key: Key) -> Column:
    """The country code stays.  Where ten digits are a North American number, area code and
    exchange keep the range of their first digits (2 to 9, or 0 and 1, which are not issued)."""
    country = F.regexp_extract(m, _COUNTRY, 0)
    rest = m.substr(F.length(country) + 1, F.length(m))

    def moved(digits: Column) -> Column:
        leading = lambda i: country.isin("", "+1") & (F.size(digits) == 10) & i.isin(0, 3)
        cells = F.transform(digits, lambda d, i: F.when(leading(i) & (d > 1), d - 2).otherwise(d))
        radices = F.transform(digits, lambda d, i: F.when(leading(i), F.when(d > 1, 8).otherwise(2)).otherwise(10))
        new = feistel(cells, radices, key, F.concat_ws("|", F.lit("phone"), F.array_join(radices.cast("array<string>"), ",")))
        return F.transform(new, lambda d, i: F.when(leading(i) & (F.element_at(digits, i + 1) > 1), d + 2).otherwise(d))

    back = _let(_cells(_digits(rest)).cast("array<int>"), moved)
    return F.when(F.length(_digits(m)).between(10, 15), F.concat(country, _filled(rest, _text(back.cast("array<string>")))))


def _card(m: Column, key: Key) -> Column:
    digits = _digits(m)
    kept = F.when(digits.startswith("4"), 1).otherwise(4)
    inner = digits.substr(kept + 1, F.length(digits) - kept - 1)
    payload = F.concat(digits.substr(F.lit(1), kept), _permuted_digits(inner, key, "card"))
    return F.when(digits.rlike(_CARD_ISSUERS) & (luhn_sum(digits) % 10 == 0), _filled(m, F.concat(payload, _luhn_digit(payload))))


def kind_of(m: Column) -> Column:
    """Which format a match has."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"[:=]"), "secret").when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(m.rlike(f"^{FORMATS['date']}$"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone").otherwise("card")
    )


def _pseudonym(kind: Column, m: Column, key: Key) -> Column:
    """The pseudonym of a match, or null where it fails validation."""
    rules = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(kind == name, rules[name](m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with each validated item in ``text_col`` replaced; other columns as they are.

    ``found_col``: name of a further column, an array of (kind, value, pseudonym) in the
    order of the text, candidates that failed validation or map to themselves left out; it is an error if ``docs``
    has that column.  Null text stays null, an empty text empty, and rows without a candidate
    keep their text as it is, whatever its length.  Repeated rows give equal results.  An
    empty table gives an empty result.
    """
    taken = list(docs.columns)
    if found_col and found_col.lower() in {c.lower() for c in taken}:
        raise ValueError(f"column {found_col} is there already")
    keys = key_table(docs.sparkSession, key)
    inner = fresh_name(taken, "hmac_inner")
    outer = fresh_name(taken, "hmac_outer")
    docs = docs.withColumns({inner: keys.select("inner").scalar(), outer: keys.select("outer").scalar()})
    key = Key(F.col(inner), F.col(outer))
    matches, found = fresh_name(taken, "matches"), fresh_name(taken, "found")
    text = F.col(text_col)
    some = F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    out = docs.withColumn(matches, some)
    items = F.transform(F.col(matches), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))
    items = F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), _pseudonym(x["kind"], x["value"], key).alias("pseudonym")))
    out = out.withColumn(found, F.when(F.size(matches) > 0, items))
    new = F.transform(F.col(found), lambda x: F.coalesce(x["pseudonym"], x["value"]))
    pieces = F.split(text, PATTERN, -1)
    changed = _text(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    out = out.withColumn(text_col, F.when(F.size(found) > 0, changed).otherwise(text))
    if found_col:
        kept = F.filter(F.col(found), lambda x: x["pseudonym"] != x["value"])
        none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
        return out.withColumn(found_col, F.coalesce(kept, none)).select(*taken, found_col)
    return out.select(*taken)
