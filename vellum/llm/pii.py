"""Format-preserving pseudonyms for personal data, by a keyed Feistel network in Spark expressions.

Matches of e-mail addresses, secrets after password=, token: " and the like (six characters or more,
of any length, without white space), IPv4 addresses, IBANs, dates, social security, card and phone
numbers are validated (octets, mod 97, calendar, Luhn) and each is
turned into symbols of given radices: digits, letters, octets, or a day's two coordinates in the
400 years from 1700. Two halves of the symbols are shifted in turn by keyed hashes of the other,
a permutation of all values of the same format, so equal values get equal pseudonyms in every
document and different ones stay different. Separators, length and letter case stay; in IBANs, card,
social security and phone numbers separators do not count, so that a number is linked in every way of
writing it, as a date is. Card and IBAN check digits are made anew, and country codes stay. What fails
validation stays. Phone numbers are those of three, three and four digits, and after a country code
those of 6 to 13 digits more in any grouping.

Null texts stay null and have no matches; texts without matches stay as they are; repeated rows are
treated alike; other columns are kept, whatever their names; empty tables give no rows. A text of any
length is read whole. Only built-in expressions are used, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import rows

#: What stands before a secret: its name, perhaps quoted, a sign among blanks, perhaps a quote.
SECRET = r"""(?i:password|passwd|secret|api[_-]?key|token)["']?[ \t]*[=:][ \t]*(?:\r?\n[ \t]*)?"""
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The country codes of telephone numbers.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: In the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": SECRET + r"""(?:"[^\s"]{6,}(?=")|'[^\s']{6,}(?=')|["']?[A-Za-z0-9+/_-]{6,})""",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[.-]\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d|-\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![ -]?\d)",
    "phone": rf"(?<![\w+])(?:(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}|{COUNTRY}(?=(?:[ .()-]*\d){{6,13}}(?!\d|[ .-]\d))(?:[ .-]?(?:\(\d{{1,4}}\)|\d{{1,12}})){{1,6}})(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 8
#: 189 * 773 days are the 400 years of the Gregorian cycle.
DAY_RADICES = (189, 773)
FIRST_DAY = "1700-01-01"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, key: Column) -> Column:
    """A permutation, keyed by `key`, of arrays of whole numbers, each below its radix."""
    half = F.floor(F.size(values) / 2).cast("int")

    def shifted(a: Column, radix: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws(":", key, turn.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        shift = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint")
        return F.transform(a, lambda x, i: F.pmod(x + shift(i), F.get(radix, i)).cast("int"))

    left, right = F.slice(values, 1, half), F.slice(values, half + 1, F.size(values))
    left_radix, right_radix = F.slice(radices, 1, half), F.slice(radices, half + 1, F.size(radices))
    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, t: F.when(t % 2 == 1, F.struct(shifted(s["l"], left_radix, s["r"], t).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), shifted(s["r"], right_radix, s["l"], t).alias("r"))
        ),
        lambda s: F.concat(s["l"], s["r"]),
    )


def _is(c: Column, low: str, high: str) -> Column:
    return (c >= low) & (c <= high)


def _alnum(c: Column) -> Column:
    return _is(c, "0", "9") | _is(c, "a", "z") | _is(c, "A", "Z")


def _letters(text: Column, key: Column, separators: bool = False) -> Column:
    """Permutes the ASCII digits and letters of a text within their kinds.

    What stands between them stays where it is; with `separators` it also tells values apart, else values that differ in
    it alone get the same digits and letters.
    """
    base = lambda c: F.when(_is(c, "0", "9"), 48).when(_is(c, "a", "z"), 97).when(_is(c, "A", "Z"), 65)

    def symbols(cs: Column) -> Column:
        values = F.transform(cs, lambda c: F.coalesce(F.ascii(c) - base(c), F.lit(0)).cast("int"))
        radices = F.transform(cs, lambda c: F.when(_is(c, "0", "9"), 10).when(_alnum(c), 26).otherwise(1))
        return F.zip_with(cs, feistel(values, radices, key), lambda c, v: F.coalesce(F.char(base(c) + v), c))

    def laid(cs: Column) -> Column:
        nothing = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

        def put(new: Column) -> Column:
            return F.aggregate(
                cs, nothing,
                lambda s, c: F.when(_alnum(c), F.struct(F.concat(s["text"], F.get(new, s["n"])).alias("text"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["n"].alias("n"))),
                lambda s: s["text"],
            )

        return _let(symbols(F.filter(cs, _alnum)), put)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return _let(chars, (lambda cs: F.array_join(symbols(cs), "")) if separators else laid)


def _ssn(m: Column, key: Column) -> Column:
    """Area, group and serial number, each within the values that are given out."""
    area, rest = F.substring(m, 1, 3).cast("int"), lambda at, n: F.substring(m, at, n).cast("int") - 1
    values = F.array(F.when(area < 666, area - 1).otherwise(area - 2), rest(5, 2), rest(8, 4))

    def again(v: Column) -> Column:
        at = lambda i: F.get(v, F.lit(i))
        return F.format_string("%03d-%02d-%04d", F.when(at(0) < 665, at(0) + 1).otherwise(at(0) + 2), at(1) + 1, at(2) + 1)

    return _let(feistel(values, F.array(*map(F.lit, (898, 99, 9999))), key), again)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(m: Column, key: Column) -> Column:
    body = _letters(F.substring(m, F.lit(1), F.length(m) - 1), key)
    return F.when(
        F.call_function("luhn_check", _digits(m)),
        _let(body, lambda b: F.concat(b, F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(_digits(b), d))), F.lit(0)))),
    ).otherwise(m)


def _mod97(moved: Column) -> Column:
    """Of an IBAN whose first four characters stand last; letters count as 10 to 35."""
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(_is(c, "0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _iban(m: Column, key: Column) -> Column:
    packed = F.replace(m, F.lit(" "), F.lit(""))
    valid = _mod97(F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))) == 1
    country = F.substring(m, 1, 2)

    def again(body: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(F.replace(body, F.lit(" "), F.lit("")), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    return F.when(valid, _let(_letters(F.substring(m, F.lit(5), F.length(m)), key), again)).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    p = F.split(m, "[-/.]")
    part = lambda i: F.get(p, F.lit(i))
    two = lambda c: F.lpad(c, 2, "0")
    iso, slash = m.contains("-"), m.contains("/")
    day_first = (~slash) | (part(0).cast("int") > 12)
    text = F.when(iso, m).when(day_first, F.concat_ws("-", part(2), two(part(1)), two(part(0)))).otherwise(F.concat_ws("-", part(2), two(part(0)), two(part(1))))
    day = F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_RADICES

    def again(v: Column) -> Column:
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(v, F.lit(0)) * b + F.get(v, F.lit(1))).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash & day_first, F.date_format(new, "dd/MM/yyyy")).when(slash, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))

    values = F.array(F.floor(day / b).cast("int"), (day % b).cast("int"))
    return F.when((day >= 0) & (day < a * b), _let(feistel(values, F.array(F.lit(a), F.lit(b)), key), again)).otherwise(m)


def _tail(m: Column, head: str, key: Column, separators: bool = False) -> Column:
    """Permutes what stands behind the part that `head` matches."""
    return _let(F.regexp_extract(m, f"^(?:{head})", 0), lambda h: F.concat(h, _letters(F.substring(m, F.length(h) + 1, F.length(m)), key, separators)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match."""
    k = {name: F.lit(f"{key}/{name}") for name in KINDS}
    is_a = lambda name: m.rlike(f"^(?:{KINDS[name]})$")
    email = _let(F.regexp_extract(m, r"\.[A-Za-z]+$", 0), lambda end: F.concat(_letters(F.substring(m, F.lit(1), F.length(m) - F.length(end)), k["email"], True), end))
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    ip = F.array_join(F.transform(feistel(octets, F.transform(octets, lambda _: F.lit(256)), k["ip"]), lambda o: o.cast("string")), ".")
    return (
        F.when(m.rlike(f"^(?:{SECRET})"), _tail(m, SECRET + "[\"']?", k["secret"], True))
        .when(m.contains("@"), email)
        .when(is_a("ip"), ip)
        .when(is_a("iban"), _iban(m, k["iban"]))
        .when(is_a("date"), _date(m, k["date"]))
        .when(is_a("ssn"), _ssn(m, k["ssn"]))
        .when(is_a("card"), _card(m, k["card"]))
        .otherwise(_tail(m, COUNTRY + "[ .-]?|", k["phone"]))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and the number of values replaced."""
    found = F.when(text.rlike("[0-9@=:]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))

    def put(matches: Column) -> Column:
        new = F.transform(matches, lambda m: pseudonym(m, key))
        between = F.split(text, PATTERN, -1)
        changed = _let(new, lambda n: F.struct(
            F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with(n, F.slice(between, 2, F.size(matches)), lambda a, b: F.concat(a, b)), "")).alias("text"),
            F.size(F.filter(F.zip_with(n, matches, lambda a, b: a != b), lambda x: x)).alias("n"),
        ))
        return F.when(F.size(matches) > 0, changed).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))

    return _let(found, put)


def replace(docs: DataFrame, key: str, counted: str | None = None) -> DataFrame:
    """docs with pseudonyms in `text`; the number of values replaced in a column, if that is named."""
    found = rows.fresh(docs, "pseudonymised")
    done = docs.withColumn(found, pseudonymised(F.col("text"), key))
    if counted:
        done = done.withColumn(counted, F.coalesce(F.col(f"{found}.n"), F.lit(0)))
    return done.withColumn("text", F.col(f"{found}.text")).drop(found)
