"""The ES5 scalar library as Spark columns. Indexes count from 0, as there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s﻿\xA0]"


def _clip(i: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, size))


def _from_end(i: Column, size: Column) -> Column:
    return F.when(i < 0, F.greatest(F.lit(0), size + i)).otherwise(F.least(i, size))


NAN = float("nan")


def number_text(x: Column) -> Column:
    """A number as text: 1, not 1.0; 10000000, not 1.0E7; 1e+21 and 1e-7 beyond the plain range."""
    d = x.cast("double")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38, 17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    raw = d.cast("string")  # the shortest digits that give the number back
    mantissa = F.regexp_replace(F.regexp_extract(raw, r"^(-?[\d.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(raw, r"E(-?\d+)$", 1)
    far = F.concat(mantissa, F.lit("e"), F.when(power.startswith("-"), power).otherwise(F.concat(F.lit("+"), power)))
    digits = F.regexp_replace(F.regexp_replace(raw, r"E.*$", ""), r"[.-]", "")
    digits = F.regexp_replace(digits, "0+$", "")
    e = power.try_cast("int")
    sign = F.when(d < 0, "-").otherwise("")
    near = F.when(e >= 0, F.rpad(digits, F.greatest(e + 1, F.length(digits)), "0")).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    whole = F.when((e >= 0) & (F.length(digits) > e + 1), F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))).otherwise(near)
    text = F.when(power == "", F.regexp_replace(raw, r"\.0$", "")).when((e >= 21) | (e < -6), far).otherwise(F.concat(sign, whole))
    whole_number = (F.abs(d) < 9e15) & (d == F.floor(d))  # nearly all numbers of a table: no patterns for them
    return F.when(whole_number, d.cast("bigint").cast("string")).when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == -float("inf"), "-Infinity").when(d == 0, "0").otherwise(F.coalesce(text, plain))


def text_of(x: Column, kind: str) -> Column:
    """String(x) of a column of a Spark type; null is null's text."""
    if kind in ("double", "float"):
        out = number_text(x)
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("null"))


def number_of(s: Column) -> Column:
    """Number(s) of a text: empty is 0, hexadecimals count, anything else that is no number is NaN."""
    v = trim(s)
    hexa = F.conv(F.regexp_extract(v, r"^0[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("double")
    whole = F.when(v.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"), v.try_cast("double"))
    return F.when(v == "", 0.0).when(v.rlike("^0[xX]"), F.coalesce(hexa, F.lit(NAN))).otherwise(F.coalesce(whole, F.lit(NAN)))


def add(a: Column, b: Column, a_kind: str, b_kind: str) -> Column:
    """a + b: text if either is text, else a sum in doubles."""
    if "string" in (a_kind, b_kind):
        return F.concat(text_of(a, a_kind), text_of(b, b_kind))
    return a.cast("double") + b.cast("double")


def remainder(a: Column, b: Column) -> Column:
    """a % b with the sign of a; NaN for 0."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a.cast("double") % F.when(b != 0, b.cast("double")))


def divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(NAN)).when(x > 0, float("inf")).otherwise(-float("inf"))
    return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def strictly_equal(a: Column, b: Column, a_kind: str, b_kind: str) -> Column:
    """a === b: one type, and equal; NaN equals nothing, null equals null."""
    number = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    if (a_kind in number) != (b_kind in number) or (a_kind not in number and a_kind != b_kind):
        return a.isNull() & b.isNull()
    same = a.eqNullSafe(b)
    return same & ~F.coalesce(F.isnan(a.cast("double")), F.lit(False)) if a_kind in number else same


def loosely_equal(a: Column, b: Column, a_kind: str, b_kind: str) -> Column:
    """a == b: texts and truth values meet numbers as numbers."""
    as_number = lambda c, k: number_of(c) if k == "string" else c.cast("double")
    if a_kind == b_kind:
        return strictly_equal(a, b, a_kind, b_kind)
    x, y = as_number(a, a_kind), as_number(b, b_kind)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((x == y) & ~F.isnan(x))


def type_of(kind: str) -> str:
    """typeof of values of a Spark type."""
    return {"string": "string", "boolean": "boolean"}.get(kind, "number" if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else "object")


def has_key(m: Column, key: Column) -> Column:
    """key in object."""
    return F.map_contains_key(m, key)


def without_key(m: Column, key: str) -> Column:
    """An object after delete."""
    return F.map_filter(m, lambda k, _: k != key)


def is_nan(x: Column) -> Column:
    return F.isnan(x.cast("double"))


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return ~F.isnan(d) & (F.abs(d) < float("inf"))


def _utf16(s: Column) -> Column:
    """The text in 16-bit units, as hexadecimal digits."""
    return F.hex(F.encode(s, "UTF-16BE"))


def _units(h: Column) -> Column:
    return F.decode(F.unhex(h), "UTF-16BE")


def utf16_length(s: Column) -> Column:
    return (F.length(_utf16(s)) / 4).cast("int")


def char_at(s: Column, i: int) -> Column:
    return F.when((F.lit(i) >= 0) & (F.lit(i) < F.length(s)), F.substr(s, F.lit(i + 1), F.lit(1))).otherwise(F.lit(""))


def char_code_at(s: Column, i: int) -> Column:
    """The i-th 16-bit unit; NaN beyond the end."""
    unit = F.substr(_utf16(s), F.lit(4 * i + 1), F.lit(4)) if i >= 0 else F.lit("")
    return F.when(unit != "", F.conv(unit, 16, 10).cast("double")).otherwise(F.lit(NAN))


def from_char_code(codes: Column) -> Column:
    """String.fromCharCode of an array of 16-bit units."""
    return _units(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(F.pmod(c.cast("bigint"), F.lit(65536))), 4, "0")), ""))


def substr(s: Column, begin: int, size: int | None = None) -> Column:
    n = F.length(s)
    a = _from_end(F.lit(begin), n)
    return F.substr(s, a + 1, n - a if size is None else F.greatest(F.lit(0), F.lit(size)))


def to_lower(s: Column) -> Column:
    return F.lower(s)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def locale_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the Unicode collation."""
    x, y = F.collate(a, "UNICODE"), F.collate(b, "UNICODE")
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def java_pattern(pattern: str, flags: str = "") -> str:
    """A pattern of the language as a Java one: flags in front, / unescaped."""
    known = {"i": "i", "m": "m", "g": ""}
    bad = [f for f in flags if f not in known]
    if bad:
        raise ValueError(f"unknown flags {bad}")
    front = "".join(known[f] for f in flags)
    return (f"(?{front})" if front else "") + pattern.replace(r"\/", "/")


def test(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(java_pattern(pattern, flags))


def exec(s: Column, pattern: str, flags: str = "") -> Column:
    """The first match and its groups as an array, null without a match."""
    import re

    p = java_pattern(pattern, flags)
    groups = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*[F.regexp_extract(s, p, k) for k in range(groups + 1)]))


def replace(s: Column, pattern: str, by: str, flags: str = "") -> Column:
    """All matches with flag g, else the first; $1 stands for a group."""
    p = java_pattern(pattern, flags)
    if "g" in flags:
        return F.regexp_replace(s, p, by)
    at = F.regexp_instr(s, F.lit(p))
    rest = F.regexp_replace(F.substr(s, at), java_pattern(rf"\A(?:{pattern})", flags), by)
    return F.when(at == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), rest))


def index_of(s: Column, part: Column, start: int = 0) -> Column:
    return F.call_function("locate", part, s, F.lit(start + 1)) - 1


def last_index_of(s: Column, part: str) -> Column:
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(s) - back - len(part) + 1)


def slice_text(s: Column, begin: int, end: int | None = None) -> Column:
    size = F.length(s)
    a = _from_end(F.lit(begin), size)
    b = size if end is None else _from_end(F.lit(end), size)
    return F.substr(s, a + 1, F.greatest(F.lit(0), b - a))


def substring(s: Column, begin: int, end: int | None = None) -> Column:
    size = F.length(s)
    a, b = _clip(F.lit(begin), size), size if end is None else _clip(F.lit(end), size)
    return F.substr(s, F.least(a, b) + 1, F.abs(b - a))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def split(s: Column, separator: str, limit: int | None = None) -> Column:
    import re

    parts = F.split(s, re.escape(separator), -1)
    return parts if limit is None else F.slice(parts, 1, limit)


def replace_first(s: Column, part: str, by: str) -> Column:
    at = F.instr(s, part)
    return F.when(at == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), F.lit(by), F.substr(s, at + len(part))))


def search(s: Column, pattern: str) -> Column:
    return F.regexp_instr(s, F.lit(pattern)) - 1


def match_all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))


def parse_int(s: Column, radix: int = 0) -> Column:
    """The integer that the text begins with, as a double; NaN if there is none."""
    v = F.lower(trim(s))
    sign = F.when(v.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(v, "^[+-]", "")
    if radix == 1 or radix < 0 or radix > 36:
        return F.lit(NAN)

    def read(text: Column, base: int) -> Column:
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
        head = F.regexp_extract(text, f"^[{digits}]+", 0)
        value = F.aggregate(F.split(head, ""), F.lit(0.0), lambda t, c: t * base + F.instr(F.lit(digits), c) - 1)
        return F.when(head == "", F.lit(NAN)).otherwise(value)

    is_hex = body.startswith("0x")
    after = F.regexp_replace(body, "^0x", "")
    found = F.when(is_hex, read(after, 16)).otherwise(read(body, 10)) if radix == 0 else read(F.when(is_hex, after).otherwise(body) if radix == 16 else body, radix)
    return sign * found


def parse_float(s: Column) -> Column:
    return F.regexp_extract(trim(s), r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", 0).try_cast("double")


def truthy_number(x: Column) -> Column:
    return ~(x.isNull() | (x == 0) | F.isnan(x))


def truthy_text(s: Column) -> Column:
    return s.isNotNull() & (s != "")


def either(a: Column, b: Column, truthy: Column) -> Column:
    """a || b."""
    return F.when(truthy, a).otherwise(b)


def both(a: Column, b: Column, truthy: Column) -> Column:
    """a && b."""
    return F.when(truthy, b).otherwise(a)


def _modulo32(x: Column) -> Column:
    """A number modulo 2 ** 32, as a bigint; what is not finite is 0."""
    d = x.cast("double")
    whole = F.when(d < 0, -F.floor(-d).cast("double")).otherwise(F.floor(d).cast("double"))
    big = F.when(F.abs(d) < 9e18, F.pmod(whole.try_cast("bigint"), F.lit(1 << 32))).otherwise(F.pmod(d, F.lit(4294967296.0)).try_cast("bigint"))
    return F.when(is_finite(d), big).otherwise(F.lit(0).cast("bigint"))


def to_int32(x: Column) -> Column:
    low = _modulo32(x)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def shift_right_unsigned(x: Column, n: int) -> Column:
    return F.shiftright(_modulo32(x), n & 31)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def to_fixed(x: Column, digits: int) -> Column:
    """By the number's exact binary value: 1.005 to two digits is 1.00, as it is a little less. Ties go up."""
    d = F.abs(x.cast("double"))
    scale = 10.0**digits
    split = lambda v: (134217729.0 * v) - ((134217729.0 * v) - v)  # noqa: E731  the upper half of the digits
    high, low = split(d), d - split(d)
    scale_high = (134217729.0 * scale) - ((134217729.0 * scale) - scale)
    scale_low = scale - scale_high
    product = d * scale
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low  # what the product lost
    whole = F.floor(product).cast("double")
    up = (product - whole > 0.5) | ((product - whole == 0.5) & (error >= 0))
    figures = (whole + up.cast("double")).cast("decimal(38, 0)").cast("string")
    figures = F.lpad(figures, F.greatest(F.length(figures), F.lit(digits + 1)), "0")
    text = F.concat(F.substr(figures, F.lit(1), F.length(figures) - digits), F.lit("." if digits else ""), F.right(figures, F.lit(digits)))
    text = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(F.isnan(x.cast("double")), "NaN").when(d >= 1e21, number_text(x)).otherwise(text)


def to_precision(x: Column, digits: int) -> Column:
    d = x.cast("double")
    e = F.when(d == 0, 0).otherwise(F.floor(F.log10(F.abs(d)))).cast("int")
    parts = F.split(F.format_string(f"%.{digits - 1}e", d), "e")
    e = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), e)
    far = F.concat(F.get(parts, F.lit(0)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
    mantissa = F.get(parts, F.lit(0))
    figures = F.regexp_replace(mantissa, r"[.-]", "")
    near = F.when(e >= digits - 1, figures).when(e >= 0, F.concat(F.substr(figures, F.lit(1), e + 1), F.lit("."), F.substr(figures, e + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), figures))
    return F.when((e < -6) | (e >= digits), far).otherwise(F.concat(F.when(d < 0, "-").otherwise(""), near))


def to_exponential(x: Column, digits: int) -> Column:
    parts = F.split(F.format_string(f"%.{digits}e", x.cast("double")), "e")
    e = F.get(parts, F.lit(1)).try_cast("int")
    return F.concat(F.get(parts, F.lit(0)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))


def to_radix(x: Column, radix: int) -> Column:
    """A whole number in another base, with its sign."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x.cast("bigint")).cast("string"), 10, radix)))


#: Math functions of one argument, by name.
MATH = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": F.ceil, "cos": F.cos, "exp": F.exp, "floor": F.floor,
    "log": lambda x: F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-float("inf"))).otherwise(F.log(F.when(x > 0, x))),
    "round": round_half_up, "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan,
}
#: The constants of Math.
CONSTANTS = {"E": 2.718281828459045, "LN2": 0.6931471805599453, "LN10": 2.302585092994046, "LOG2E": 1.4426950408889634, "LOG10E": 0.4342944819032518, "PI": 3.141592653589793, "SQRT1_2": 0.7071067811865476, "SQRT2": 1.4142135623730951}


def power(x: Column, y: Column) -> Column:
    return F.pow(x.cast("double"), y.cast("double"))


def arc_tangent(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def maximum(*xs: Column) -> Column:
    """NaN if any is; nothing at all is -Infinity."""
    if not xs:
        return F.lit(-float("inf"))
    return F.greatest(*xs) if len(xs) > 1 else xs[0]  # Spark sorts NaN above all numbers


def minimum(*xs: Column) -> Column:
    if not xs:
        return F.lit(float("inf"))
    any_nan = reduce(lambda a, b: a | b, [F.isnan(x.cast("double")) for x in xs])
    return F.when(any_nan, F.lit(NAN)).otherwise(F.least(*xs) if len(xs) > 1 else xs[0])


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


#: What the URI functions leave as it is.
URI_COMPONENT = "A-Za-z0-9\\-_.!~*'()"
URI_WHOLE = URI_COMPONENT + ";/?:@&=+$,#"


def _escaped(s: Column, kept: str) -> Column:
    pieces = F.regexp_extract_all(s, F.lit(f"(?s)[{kept}]+|[^{kept}]+"), F.lit(0))
    coded = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{kept}]"), p).otherwise(coded(p))), "")


def encode_uri_component(s: Column) -> Column:
    return _escaped(s, URI_COMPONENT)


def encode_uri(s: Column) -> Column:
    return _escaped(s, URI_WHOLE)


def decode_uri_component(s: Column) -> Column:
    """Malformed sequences raise."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def decode_uri(s: Column) -> Column:
    """Escapes of reserved characters stay."""
    reserved = "|".join(f"{ord(c):02X}" for c in ";/?:@&=+$,#")
    return F.url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), f"(?i)%({reserved})", "%25$1"))


def escape(s: Column) -> Column:
    """%XX and %uXXXX by 16-bit units."""
    units = F.regexp_extract_all(_utf16(s), F.lit("...."), F.lit(0))
    plain = "A-Za-z0-9@*_+\\-./"

    def one(u: Column) -> Column:
        c = F.when(u.startswith("00"), F.decode(F.unhex(F.substr(u, F.lit(3), F.lit(2))), "ISO-8859-1"))
        return F.when(c.rlike(f"^[{plain}]$"), c).when(u.startswith("00"), F.concat(F.lit("%"), F.substr(u, F.lit(3), F.lit(2)))).otherwise(F.concat(F.lit("%u"), u))

    return F.array_join(F.transform(units, one), "")


def unescape(s: Column) -> Column:
    pieces = F.regexp_extract_all(s, F.lit(r"(?s)%u[0-9a-fA-F]{4}|%[0-9a-fA-F]{2}|."), F.lit(0))

    def one(p: Column) -> Column:
        long, short = p.rlike("^%u[0-9a-fA-F]{4}$"), p.rlike("^%[0-9a-fA-F]{2}$")
        return F.when(long, F.substr(p, F.lit(3), F.lit(4))).when(short, F.concat(F.lit("00"), F.substr(p, F.lit(2), F.lit(2)))).otherwise(_utf16(p))

    return _units(F.array_join(F.transform(pieces, one), ""))


def json_parse(s: Column, schema: str) -> Column:
    """Texts that are no JSON raise."""
    return F.from_json(s, schema, {"mode": "FAILFAST"})


def json_stringify(x: Column) -> Column:
    return F.to_json(x)


def json_get(s: Column, path: str) -> Column:
    return F.get_json_object(s, path)


def object_keys(m: Column) -> Column:
    return F.map_keys(m)


def object_values(m: Column) -> Column:
    return F.map_values(m)


def new_array(*items: Column) -> Column:
    """Array(n) of one whole number, else an array of the arguments."""
    return F.array(*items)


def holes(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n)


def array_length(a: Column) -> Column:
    return F.coalesce(F.array_size(a), F.lit(0))


def pop(a: Column) -> tuple[Column, Column]:
    """The last element (null if empty), and what is left."""
    return F.try_element_at(a, F.lit(-1)), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1))


def push(a: Column, *items: Column) -> tuple[Column, Column]:
    """The new length, and the array."""
    out = F.concat(a, F.array(*items))
    return F.size(out), out


def shift(a: Column) -> tuple[Column, Column]:
    return F.get(a, F.lit(0)), F.slice(a, 2, F.greatest(F.lit(0), F.size(a) - 1))


def unshift(a: Column, *items: Column) -> tuple[Column, Column]:
    out = F.concat(F.array(*items), a)
    return F.size(out), out


def reverse(a: Column) -> Column:
    return F.reverse(a)


def array_concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def every(a: Column, test) -> Column:
    return F.forall(a, test)


def some(a: Column, test) -> Column:
    return F.exists(a, test)


def array_filter(a: Column, test) -> Column:
    return F.filter(a, test)


def array_map(a: Column, f) -> Column:
    return F.transform(a, f)


def array_index_of(a: Column, x: Column, start: int = 0) -> Column:
    """-1 if it is not there at or after start."""
    at = F.array_position(array_slice(a, start), x)
    n = F.size(a)
    return F.when(at == 0, -1).otherwise(at - 1 + _from_end(F.lit(start), n)).cast("int")


def array_last_index_of(a: Column, x: Column) -> Column:
    at = F.array_position(F.reverse(a), x)
    return F.when(at == 0, -1).otherwise(F.size(a) - at).cast("int")


def array_join(a: Column, separator: str = ",", kind: str = "string") -> Column:
    """Nulls are empty; kind is the elements' Spark type."""
    each = lambda x: F.coalesce(number_text(x) if kind in ("double", "float") else x.cast("string"), F.lit(""))
    return F.array_join(F.transform(a, each), separator)


def array_slice(a: Column, begin: int, end: int | None = None) -> Column:
    size = F.size(a)
    i = _from_end(F.lit(begin), size)
    j = size if end is None else _from_end(F.lit(end), size)
    return F.slice(a, i + 1, F.greatest(F.lit(0), j - i))


def splice(a: Column, at: int, count: int, *items: Column) -> Column:
    return F.concat(array_slice(a, 0, at), F.array(*items), array_slice(a, at + count))


def sort_as_text(a: Column, kind: str = "string") -> Column:
    def order(x: Column, y: Column) -> Column:
        p, q = (number_text(v) if kind in ("double", "float") else v.cast("string") for v in (x, y))
        return F.when(p < q, -1).when(p > q, 1).otherwise(0)

    return F.array_sort(a, order)


def fold(a: Column, zero: Column, step) -> Column:
    """reduce with a first value."""
    return F.aggregate(a, zero, step)


def fold_right(a: Column, zero: Column, step) -> Column:
    return F.aggregate(F.reverse(a), zero, step)


def fold_first(a: Column, step) -> Column:
    """reduce without a first value: an empty array raises."""
    empty = F.raise_error(F.lit("an empty array has nothing to begin with"))
    start = F.get(a, F.lit(0))
    return F.when(F.size(a) == 0, empty).otherwise(F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), start, step))


def date_utc(*parts: Column) -> Column:
    """Date.UTC(year, month from 0, day, hours, minutes, seconds, milliseconds) in milliseconds; parts may run over."""
    names = ["year", "month", "day", "hours", "mins", "secs", "ms"]
    given = dict(zip(names, parts))
    year, month = given["year"].cast("int"), given.get("month", F.lit(0)).cast("int")
    first = F.make_date(year + F.floor(month / 12).cast("int"), F.pmod(month, F.lit(12)) + 1, F.lit(1))
    days = F.unix_date(first).cast("bigint") + given.get("day", F.lit(1)) - 1
    zero = F.lit(0)
    return (((days * 24 + given.get("hours", zero)) * 60 + given.get("mins", zero)) * 60 + given.get("secs", zero)) * 1000 + given.get("ms", zero)


def date_set(ts: Column, part: str, value: Column) -> Column:
    """ts with one of full_year, month, date, hours, minutes, seconds, milliseconds set in UTC; values may run over."""
    now = {"year": F.year(ts), "month": F.month(ts) - 1, "day": F.dayofmonth(ts), "hours": F.hour(ts), "mins": F.minute(ts), "secs": F.floor(F.second(ts)), "ms": F.pmod(F.unix_millis(ts), F.lit(1000))}
    name = {"full_year": "year", "month": "month", "date": "day", "hours": "hours", "minutes": "mins", "seconds": "secs", "milliseconds": "ms"}[part]
    now[name] = value
    return F.timestamp_millis(date_utc(*now.values()))


def date_parse(s: Column) -> Column:
    """Milliseconds of an ISO text, NaN if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(s)).cast("double"), F.lit(NAN))


def date_of(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_parts(ts: Column) -> dict[str, Column]:
    return {"full_year": F.year(ts), "month": F.month(ts) - 1, "date": F.dayofmonth(ts), "day": F.dayofweek(ts) - 1, "hours": F.hour(ts), "minutes": F.minute(ts), "seconds": F.second(ts), "time": F.unix_millis(ts.cast("timestamp"))}


def progress_curve(n: Column) -> Column:
    return F.round(F.least(F.lit(100.0) * (1 - F.exp(F.lit(-0.05) * n)), F.lit(100.0)))
