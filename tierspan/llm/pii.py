r"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated numbers and dates.

Found and checked: payment cards (13 to 19 digits, Luhn), phone numbers (7 to 15 digits after + or 0, in groups or not, and ten
digits in the layout 3-3-4 or in one piece), social security numbers (area, group and serial in
range), IPv4 addresses (four bytes), calendar dates of 1900 to 2099, year or day first (a time may follow after a T), the local part of e-mail addresses, and
hexadecimal secrets of 32 to 64 digits. A value is permuted within its own domain by an alternating Feistel network whose round
function is HMAC-SHA-256, a digest of its own for every 16 symbols, so the same value becomes the same pseudonym in every document,
different values stay different, and the format stays: separators, lengths and prefixes remain, cards still satisfy Luhn, dates are
dates. A date in another notation, or a number with other separators, is the same value. What fails its check is left alone.
The key is the caller's: there is no default.

Defined results: a null text stays null with nothing found; an empty text is empty; repeated rows are answered each; an empty
table gives no row. Only built-in expressions run, one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspan.llm.rules import let

ROUNDS = 8
#: Symbols that one digest moves: four of its 64 hexadecimal digits each.
DIGEST_SYMBOLS = 16
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
_L, _R = r"(?<![0-9A-Za-z_.+-])", r"(?![0-9A-Za-z_])"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
_END = r"(?![0-9A-Za-z_])"
#: 7 to 15 digits after + or 0, in groups set apart by a blank, dot, dash or slash; the area code, or a trunk 0, may be in brackets.
_PLUS = r"\+[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d[ ./-]?){3,13}\d" + _END
_ZERO = r"(?<![+.,/-])(?:\(0\d{1,4}\)[ ./-]?(?:\d[ ./-]?){4,9}\d|0\d(?:[ ./-]?\d){5,13})" + _END
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "ipv4": _L + r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?[0-9A-Za-z_])",
    "date": _L + _DATE + r"(?![0-9A-SU-Za-z_]|T(?!\d{2}))",
    "ssn": _L + r"\d{3}-\d{2}-\d{4}(?!-?[0-9A-Za-z_])",
    "card": r"(?<![0-9A-Za-z_])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![0-9A-Za-z_])",
    "phone": r"(?<![0-9A-Za-z_])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}" + _END + "|" + _PLUS + "|" + _ZERO + r"|[2-9]\d{9}" + _END + ")",
}
#: Country codes are prefix-free: those of one and two digits, all others have three.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
LAYOUT = r"^(?!\(?0)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}$"
_ANY = "|".join(PATTERNS.values())


def _pad(key: str, *parts: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal. All parts but the last are numbers or fixed names, so no two messages are joined alike."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ y for x in block)) for y in (0x36, 0x5C))
    message = F.concat_ws("\x1f", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def permute_symbols(symbols: Column, alphabet: str, key: str, tweak: str) -> Column:
    """A permutation of the strings over `alphabet` of one length. Halves swap each round, an even number of times."""
    base, half = len(alphabet), F.floor(F.length(symbols) / 2).cast("int")

    def value(hexes: Column, i: Column) -> Column:
        return F.conv(F.substr(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("int")

    def added(left: Column, pad: Column) -> Column:
        places = F.transform(F.split(left, ""), lambda c, i: F.substr(F.lit(alphabet), F.pmod(F.call_function("instr", F.lit(alphabet), c) - 1 + value(pad, i), F.lit(base)) + 1, F.lit(1)))
        return F.when(F.length(left) > 0, F.array_join(places, "")).otherwise("")

    start = F.struct(F.substr(symbols, F.lit(1), half).alias("l"), F.substr(symbols, half + 1).alias("r"))

    def step(a: Column, k: Column) -> Column:
        digests = F.sequence(F.lit(0), F.floor((F.greatest(F.length(a["l"]), F.lit(1)) - 1) / DIGEST_SYMBOLS).cast("int"))
        pad = F.array_join(F.transform(digests, lambda n: _pad(key, F.lit(tweak), k.cast("string"), F.length(symbols).cast("string"), n.cast("string"), a["r"])), "")
        return F.struct(a["r"].alias("l"), let(pad, lambda p: added(a["l"], p)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda a: F.concat(a["l"], a["r"]))


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A permutation of the pairs (left < a, right < b), as a struct (l, r)."""

    def step(s: Column, k: Column) -> Column:
        pad = F.conv(F.substring(_pad(key, F.lit(tweak), k.cast("string"), s["r"].cast("string")), 1, 12), 16, 10).cast("long")
        size = F.when(k % 2 == 1, F.lit(a)).otherwise(F.lit(b))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + pad, size).cast("long").alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _only(value: Column, alphabet: str) -> Column:
    return F.regexp_replace(value, f"[^{alphabet}]", "")


def _refill(value: Column, symbols: Column, alphabet: str) -> Column:
    """`value` with its symbols of the alphabet replaced in order."""
    inside = f"[{alphabet}]"
    chars = F.split(value, "")

    def put(c: Column, i: Column) -> Column:
        nth = F.length(_only(F.substr(value, F.lit(1), i + 1), alphabet))
        return F.when(c.rlike(inside), F.substr(symbols, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, put), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn digits when the last one isn't doubled."""
    back = F.split(F.reverse(digits), "")

    def term(acc: Column, x: Column) -> Column:
        d = x["c"].cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(x["i"] % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(back, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), F.lit(0), term)


def _card(v: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = permute_symbols(F.substr(d, F.lit(1), F.length(d) - 1), DIGITS, key, "card")
        full = let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn_sum(d), F.lit(10)) == 0, let(full, lambda f: _refill(v, f, DIGITS)))

    return let(_only(v, DIGITS), made)


def _phone(v: Column, key: str) -> Column:
    """The country code and the 0 or 00 before a number stay; the rest is permuted."""
    usual = r"(?:\+\d{1,3}[ .-]?(?=(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}$))"
    other = r"(?:\+" + COUNTRY + r"[ .-]?(?:\(0\)[ .-]?)?|\(?00?)"
    head = F.when(v.rlike(LAYOUT), F.regexp_extract(v, "^" + usual + "?", 0)).otherwise(F.regexp_extract(v, "^" + other + "?", 0))
    rest = F.substr(v, F.length(head) + 1)
    made = let(rest, lambda r: F.concat(head, _refill(r, permute_symbols(_only(r, DIGITS), DIGITS, key, "phone"), DIGITS)))
    return F.when(F.length(_only(v, DIGITS)).between(7, 15), made)


def _ipv4(v: Column, key: str) -> Column:
    part = lambda k: F.split_part(v, F.lit("."), F.lit(k)).cast("int")
    ok = (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    pair = permute_pair(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ipv4")
    text = lambda p: F.concat_ws(".", *[F.floor(x).cast("string") for x in (p["l"] / 256, p["l"] % 256, p["r"] / 256, p["r"] % 256)])
    return F.when(ok, let(pair, text))


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    part = lambda k: F.split_part(v, F.lit("-"), F.lit(k)).cast("int")
    ok = part(1).between(1, 899) & (part(1) != 666) & (part(2) > 0) & (part(3) > 0)
    area = part(1) - F.when(part(1) > 666, 2).otherwise(1)
    pair = permute_pair(area * 99 + part(2) - 1, part(3) - 1, 898 * 99, 9999, key, "ssn")

    def text(p: Column) -> Column:
        index = F.floor(p["l"] / 99)
        return F.concat_ws("-", F.lpad((index + F.when(index >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.when(ok, let(pair, text))


def _date(v: Column, key: str) -> Column:
    """A day of 1900 to 2099 becomes another: (year, day of a common year); leap days move among the 49 leap years."""
    iso = v.rlike(r"^\d{4}[-/]")
    sep = F.when(v.contains("/"), F.lit("/")).otherwise(F.lit("."))
    y = F.when(iso, F.substring(v, 1, 4)).otherwise(F.split_part(v, sep, F.lit(3)))
    m = F.when(iso, F.regexp_extract(v, r"^\d{4}.(\d+).(\d+)$", 1)).otherwise(F.split_part(v, sep, F.lit(2)))
    d = F.when(iso, F.regexp_extract(v, r"^\d{4}.(\d+).(\d+)$", 2)).otherwise(F.split_part(v, sep, F.lit(1)))
    # in slashed dates the month may stand first; a first part over 12 can only be a day
    swap = v.contains("/") & ~iso & (m.cast("int") > 12)
    month, day = F.when(swap, d).otherwise(m).cast("int"), F.when(swap, m).otherwise(d).cast("int")
    date = F.format_string("%04d-%02d-%02d", y.cast("int"), month, day).try_cast("date")

    def moved(x: Column) -> Column:
        leap = (F.month(x) == 2) & (F.dayofmonth(x) == 29)
        flat = F.datediff(F.make_date(F.lit(2001), F.month(x), F.when(leap, 28).otherwise(F.dayofmonth(x))), F.lit("2001-01-01").cast("date"))
        common = permute_pair(F.year(x) - 1900, flat, 200, 365, key, "date")
        nth = (F.year(x) - 1904) / 4
        leaps = permute_pair(F.floor(nth / 7), nth % 7, 7, 7, key, "leap day")
        plain = let(common, lambda p: let(F.date_add(F.lit("2001-01-01").cast("date"), p["r"].cast("int")), lambda q: F.make_date((p["l"] + 1900).cast("int"), F.month(q), F.dayofmonth(q))))
        return F.when(leap, let(leaps, lambda p: F.make_date((1904 + 4 * (7 * p["l"] + p["r"])).cast("int"), F.lit(2), F.lit(29)))).otherwise(plain)

    def written(x: Column) -> Column:
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        mm, dd = two(F.month(x)), two(F.dayofmonth(x))
        return F.when(iso, F.concat(F.year(x).cast("string"), F.substring(v, 5, 1), mm, F.substring(v, 5, 1), dd)).when(swap, F.concat_ws("/", mm, dd, F.year(x).cast("string"))).otherwise(F.concat(dd, sep, mm, sep, F.year(x).cast("string")))

    return let(date, lambda x: F.when(F.year(x).between(1900, 2099), let(moved(x), written)))


def _cased(made: Column, value: Column) -> Column:
    """`made` with a capital wherever `value`, as long, has one and the new character is a letter."""
    return F.array_join(F.zip_with(F.split(made, ""), F.split(value, ""), lambda m, v: F.when(v.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")


def _email(v: Column, key: str) -> Column:
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    local = F.lower(name)
    filled = let(_only(local, "0-9a-z"), lambda s: _refill(local, permute_symbols(s, ALNUM, key, "email"), "0-9a-z"))
    return F.concat(_cased(filled, name), F.lit("@"), domain)


def _secret(v: Column, key: str) -> Column:
    return _cased(permute_symbols(F.lower(v), HEX, key, "secret"), v)


_MAKERS = {"email": _email, "secret": _secret, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str) -> Column:
    """(kind, text) for a matched value; text is null where the check fails."""
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        is_kind = value.rlike(f"^(?:{PATTERNS[name]})$")
        kind, text = F.when(is_kind, F.lit(name)).otherwise(kind), F.when(is_kind, _MAKERS[name](value, key)).otherwise(text)
    return F.struct(kind.alias("kind"), text.alias("text"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found, n_replaced, kinds): the whole text with pseudonyms; other columns are left out."""
    text = F.col("text")
    found = F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    rows = docs.select("doc_id", "text", F.coalesce(found, F.array().cast("array<string>")).alias("_found"))
    rows = rows.withColumn("_made", F.transform("_found", lambda v: pseudonym(v, key)))
    put = F.zip_with(F.split("text", _ANY), F.zip_with("_found", "_made", lambda v, p: F.coalesce(p["text"], v)), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
    replaced = F.filter("_made", lambda p: p["text"].isNotNull())
    return rows.select(
        "doc_id",
        F.when(F.size(replaced) > 0, F.array_join(put, "")).otherwise(text).alias("text"),
        F.size("_found").cast("long").alias("n_found"),
        F.size(replaced).cast("long").alias("n_replaced"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(replaced, lambda p: p["kind"]))), ",").alias("kinds"),
    )
