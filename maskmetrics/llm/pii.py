"""Pseudonyms of personal numbers, dates and mail names by keyed permutations that keep their format.

Found and validated, a value's variable part is taken as an element of Z_a x Z_b and goes through a Feistel network with
modular addition, x = x + F(y) mod a and y = y + F(x) mod b by turns. That permutes the a * b values exactly, whatever a and
b are, so no value needs to be drawn again: equal values get equal pseudonyms in all documents, different ones different
pseudonyms, and the holder of the key can undo them. The round function is SHA-256 under the key.

| kind | validated by | permuted | kept |
| mail | form | letters and digits of the name, each among their kind | domain, case, other characters |
| ipv4 | octets up to 255 | all 2^32 addresses | dots; no padding |
| phone | 8 to 15 digits after a plus, or (ddd) ddd-dddd | the digits after the country code | all other characters |
| ssn | ddd-dd-dddd, area not 000, 666 or 9xx, no zero group or serial | the 898 * 99 * 9999 valid numbers | dashes |
| date | a day of 1800 to 2199, as y-m-d, d/m/y or d.m.y | the 146,097 days, as 189 * 773 | separators, order |
| card | 13 to 19 digits, bare or in groups, right Luhn digit | digits but the first and the last | first digit, groups, a right Luhn digit |

DataFrame functions only: matches are taken out with one pattern, the pieces between them with split(), and both are put
together again. No shuffle; a row's work grows with its text. Cases: a null text stays null; text without a value is
returned as it is; what has the form but isn't valid stays; repeated rows give equal results; other columns are kept, but a
column of the input named as the added count gives way to it.

The key is a secret: whoever has it can undo the pseudonyms. It is a required argument, and an empty one is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
_PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(_PATTERNS.values())
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)


def _long(x) -> Column:
    return F.lit(x).cast("bigint")


def feistel(x: Column, y: Column, a: Column, b: Column, kind: str, key: str, back: bool = False) -> Column:
    """A struct x, y: the permutation of Z_a x Z_b that key and kind select, or its inverse."""
    turns = range(ROUNDS)[::-1] if back else range(ROUNDS)

    def turned(value: Column, other: Column, size: Column, i: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, a, b, other).cast("binary"), 256)
        f = F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint"), size)
        return F.pmod(value - f if back else value + f, size)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, turned(s["x"], s["y"], a, i)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(turned(s["y"], s["x"], b, i)).alias("y"))

    return F.aggregate(F.array(*(F.lit(i) for i in turns)), F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), step)


def _with(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*(_long(base**i) for i in range(1, 13))), n)


def permuted_string(s: Column, base: int, kind: str, key: str, back: bool = False) -> Column:
    """A string of base-10 digits, or with base 26 of a-z, permuted among those of its length; pieces of 24 are permuted each by itself.

    One character alone is moved by an amount that the key selects.
    """
    width = 24
    symbols, letters = "0123456789abcdefghijklmnop"[:base], "0123456789" if base == 10 else "abcdefghijklmnopqrstuvwxyz"

    def number(part: Column) -> Column:
        return F.conv(F.translate(part, letters, symbols) if base != 10 else part, base, 10).cast("bigint")

    def written(n: Column, width: Column) -> Column:
        text = F.lower(F.conv(n.cast("string"), 10, base))
        text = F.lpad(text, width, "0")
        return F.translate(text, symbols, letters) if base != 10 else text

    def piece(p: Column, at: Column) -> Column:
        n = F.length(p)
        u, v = F.ceil(n / 2).cast("int"), F.floor(n / 2).cast("int")

        def two(u: Column, v: Column) -> Column:
            x, y = number(F.substr(p, F.lit(1), u)), number(F.substr(p, u + 1, v))
            named = feistel(x, y, _power(base, u), _power(base, v), f"{kind}{base}", key, back)
            return _with(named, lambda s: F.concat(written(s["x"], u), written(s["y"], v)))

        alone_by = F.pmod(F.conv(F.substring(F.sha2(F.lit(f"{key}|{kind}|{base}|1").cast("binary"), 256), 1, 15), 16, 10).cast("bigint"), _long(base))
        one = written(F.pmod(number(p) - alone_by if back else number(p) + alone_by, _long(base)), F.lit(1))
        return F.when(n >= 2, two(u, v)).when(n == 1, one).otherwise(F.lit(""))

    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: piece(F.substr(s, i + 1, F.lit(width)), i)), "")


def _refilled(value: Column, kept: str, new: Column) -> Column:
    """value with its characters of the class `kept` replaced, in order, by those of new."""
    def step(s: Column, c: Column) -> Column:
        take = c.rlike(f"^[{kept}]$")
        return F.struct(
            F.concat(s["out"], F.when(take, F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(take, 1).otherwise(0)).alias("at")
        )

    return F.aggregate(F.split(value, "(?!^)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits; 0 modulo 10 where the last one is right."""
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mail(m: Column, key: str, back: bool) -> Column:
    name, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    low = F.lower(name)
    new = _refilled(name, "0-9", permuted_string(_digits(name), 10, "mail", key, back))
    new = _refilled(new, "a-zA-Z", permuted_string(F.regexp_replace(low, "[^a-z]", ""), 26, "mail", key, back))
    # case by position
    cased = F.transform(F.arrays_zip(F.split(name, "(?!^)").alias("o"), F.split(new, "(?!^)").alias("n")), lambda p: F.when(p["o"].rlike("^[A-Z]$"), F.upper(p["n"])).otherwise(p["n"]))
    return F.concat(F.array_join(cased, ""), rest)


def _ipv4(m: Column, key: str, back: bool) -> Column:
    def new(o: Column) -> Column:
        s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), "ipv4", key, back)
        return _with(s, lambda s: F.concat_ws(".", F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256))

    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    plain = ~m.rlike(r"(^|\.)0[0-9]")
    return F.when(plain & F.forall(octets, lambda o: o <= 255), _with(octets, new)).otherwise(m)


def _phone(m: Column, key: str, back: bool) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    country = F.when((country == "") & m.startswith("+"), F.substring(m, 1, 3)).otherwise(country)
    rest = F.substr(m, F.length(country) + 1)
    n = F.length(_digits(m))
    return F.when((n >= 8) & (n <= 15), F.concat(country, _refilled(rest, "0-9", permuted_string(_digits(rest), 10, "phone", key, back)))).otherwise(m)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    s = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, _long(898), _long(99 * 9999), "ssn", key, back)

    def written(s: Column) -> Column:
        return F.concat_ws("-", F.lpad((s["x"] + F.when(s["x"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(s["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["y"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _with(s, written)).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    y = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    mo = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    d = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)).cast("int")
    day = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    index = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    a, b = _DAYS

    def written(s: Column) -> Column:
        day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["x"] * b + s["y"]).cast("int"))
        return F.when(iso, F.date_format(day, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == "/", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))

    s = feistel(F.floor(index / b), F.pmod(index, F.lit(b)), _long(a), _long(b), "date", key, back)
    return F.when(day.isNotNull() & (index >= 0) & (index < a * b), _with(s, written)).otherwise(m)


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    inner = F.substr(digits, F.lit(2), F.length(digits) - 2)
    body = F.concat(F.substring(digits, 1, 1), permuted_string(inner, 10, "card", key, back))

    def with_check(body: Column) -> Column:
        total = luhn_sum(F.concat(body, F.lit("0")))
        return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))

    return F.when(luhn_sum(digits) % 10 == 0, _refilled(m, "0-9", _with(body, with_check))).otherwise(m)


_KINDS = {"mail": _mail, "ipv4": _ipv4, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.lit("card")
    for name, form in (("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("phone", r"^[+(]"), ("ipv4", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), ("mail", "@")):
        out = F.when(m.rlike(form), name).otherwise(out)
    return out


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one matched value; the value itself where it isn't valid. back: from pseudonym to value."""
    out = None
    kind = kind_of(m)
    for name, function in _KINDS.items():
        out = F.when(kind == name, function(m, key, back)) if out is None else out.when(kind == name, function(m, key, back))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False, values: str = "n_values") -> DataFrame:
    """docs with the values of `text` replaced by pseudonyms (or, back, pseudonyms by values) and `values`, how many were."""
    if not key:
        raise ValueError("pseudonyms need a key")
    found, new, replaced, n = unused(docs, "_values", "_new", "_text", "_n")
    own = docs.withColumn(found, F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))))
    own = own.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key, back))))
    pieces = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.arrays_zip(F.col(found).alias("o"), F.col(new).alias("n")), lambda p: p["o"] != p["n"]))
    own = own.withColumn(replaced, F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text))).withColumn(n, F.when(F.col(new).isNotNull(), changed).otherwise(0))
    return own.select(*((F.col(replaced) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns if c != values), F.col(n).alias(values))
