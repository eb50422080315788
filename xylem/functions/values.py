"""XPath's conversions, comparisons and string functions as Column expressions, and their scalar twins for whole-document evaluation.

Columns are never null: a null string counts as empty. NaN follows IEEE rules, which Spark's own comparisons don't.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[ \t\r\n]*-?(?:\d+(?:\.\d*)?|\.\d+)[ \t\r\n]*$"
_NUMBER = re.compile(NUMBER.replace("$", r"\Z"))
_NAN = float("nan")


def to_number(s: str) -> float:
    return float(s.strip(" \t\r\n")) if _NUMBER.match(s) else _NAN


def format_number(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.15g}"


def round_half_up(x: float) -> float:
    if math.isnan(x) or math.isinf(x) or abs(x) >= 2**52:
        return x
    return math.copysign(math.floor(x + 0.5), x) if -0.5 <= x <= 0 else float(math.floor(x + 0.5))


def divide(a: float, b: float) -> float:
    if b:
        return a / b
    return _NAN if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def modulo(a: float, b: float) -> float:
    return _NAN if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)


def substring(s: str, p: float, n: float | None = None) -> str:
    lo = round_half_up(p)
    hi = math.inf if n is None else lo + round_half_up(n)
    if math.isnan(lo) or math.isnan(hi):
        return ""
    lo, hi = min(max(lo, 1), len(s) + 1), min(max(hi, 1), len(s) + 1)
    return s[int(lo) - 1 : int(hi) - 1]


def translate(s: str, old: str, new: str) -> str:
    table: dict[int, str | None] = {}
    for k, c in enumerate(old):
        table.setdefault(ord(c), new[k] if k < len(new) else None)
    return s.translate(table)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def number(c: Column) -> Column:
    """number() of a string."""
    plain = F.regexp_replace(text(c), r"[ \t\r\n]+", "")
    return F.when(text(c).rlike(NUMBER), plain.try_cast("double")).otherwise(F.lit(_NAN))


def flag_number(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def number_text(x: Column) -> Column:
    """string() of a number: integers plain, others with up to 15 significant digits."""
    e = F.format_string("%.14e", x)
    digits = F.rtrim(F.regexp_replace(F.regexp_extract(e, r"^-?([\d.]+)", 1), r"\.", ""), F.lit("0"))
    exp = F.regexp_extract(e, r"e([+-]\d+)$", 1).try_cast("int")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    padded = F.when(F.length(digits) < exp + 1, F.rpad(digits, exp + 1, F.lit("0"))).otherwise(digits)
    fixed = F.when(exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)).otherwise(
        F.rtrim(F.concat(padded.substr(F.lit(1), exp + 1), F.lit("."), padded.substr(exp + 2, F.length(padded))), F.lit("."))
    )
    mantissa = F.when(F.length(digits) > 1, F.concat(digits.substr(1, 1), F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(e, r"e([+-]\d+)$", 1))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == F.lit(math.inf), "Infinity")
        .when(x == F.lit(-math.inf), "-Infinity")
        .when((F.abs(x) < 1e15) & (x == F.rint(x)), x.try_cast("bigint").cast("string"))
        .otherwise(F.concat(sign, F.when((exp >= -4) & (exp < 15), fixed).otherwise(scientific)))
    )


def flag_text(c: Column) -> Column:
    return F.when(c, F.lit("true")).otherwise(F.lit("false"))


def same(a: Column, b: Column) -> Column:
    """Equality of numbers; NaN equals nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def less(a: Column, op: str, b: Column) -> Column:
    """<, <=, > or >= of numbers; false for NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def divided(a: Column, b: Column) -> Column:
    sign = F.signum(a) * F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when(sign > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, by_zero).otherwise(F.when(b == 0, F.lit(_NAN)).otherwise(a / F.when(b == 0, 1.0).otherwise(b)))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(_NAN)).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def _whole(x: Column, f) -> Column:
    big = F.isnan(x) | (F.abs(x) >= 2.0**52)
    whole = f(F.when(big, 0.0).otherwise(x)).cast("double")
    return F.when(big, x).when(whole == 0, x * 0.0).otherwise(whole)  # zero keeps its sign


def floored(x: Column) -> Column:
    return _whole(x, F.floor)


def ceiled(x: Column) -> Column:
    return _whole(x, F.ceil)


def rounded(x: Column) -> Column:
    return _whole(x, lambda v: F.floor(v + 0.5))


def substring_of(s: Column, p: Column, n: Column | None = None) -> Column:
    s, size = text(s), F.length(text(s)).cast("double") + 1
    lo = rounded(p)
    hi = F.lit(math.inf) if n is None else lo + rounded(n)
    inside = lambda x: F.least(F.greatest(x, F.lit(1.0)), size)
    bad = F.isnan(lo) | F.isnan(hi)
    a, b = (inside(F.when(bad, 1.0).otherwise(x)) for x in (lo, hi))
    return F.when(bad | (b <= a), "").otherwise(s.substr(a.cast("int"), F.greatest(b - a, F.lit(0.0)).cast("int")))


def before(s: Column, mark: Column) -> Column:
    at = F.instr(text(s), text(mark))
    return F.when(at > 0, text(s).substr(F.lit(1), at - 1)).otherwise("")


def after(s: Column, mark: Column) -> Column:
    at = F.instr(text(s), text(mark))
    return F.when(at > 0, text(s).substr(at + F.length(text(mark)), F.length(text(s)))).otherwise("")


def normalized(s: Column) -> Column:
    return F.trim(F.regexp_replace(text(s), r"[ \t\r\n]+", " "))


def translated(s: Column, old: Column, new: Column) -> Column:
    """Spark's translate ends at a null character, which XML can't hold either."""
    return F.call_function("translate", text(s), text(old), text(new))


def local_name(name: Column) -> Column:
    return F.substring_index(text(name), ":", -1)



def decoded(c: Column) -> Column:
    """Entities replaced as the parser does, all in the JVM: the named ones one after the other, ``&`` last; where there are numbers, by a split at each entity.

    What is found is paired with the gaps once. Looked up by number inside a lambda it would be found again for every gap.
    """
    entity = r"&(?:#x[0-9a-fA-F]+|#[0-9]+|lt|gt|amp|quot|apos);"
    found = F.regexp_extract_all(c, F.lit(f"({entity})"), F.lit(1))
    gaps = F.split(c, entity, -1)
    code = lambda e: F.when(F.length(e) > 12, F.lit(0x110000)).when(e.startswith("&#x"), F.conv(F.substring(e, 4, 20), 16, 10).try_cast("int")).otherwise(
        F.regexp_replace(e, r"[&#;]", "").try_cast("int")
    )
    # a code point's UTF-16 units, read as bytes
    unit = lambda v: F.lpad(F.hex(v), 4, "0")
    wide = lambda v: F.concat(unit(F.lit(0xD800) + F.shiftright(v - 0x10000, 10)), unit(F.lit(0xDC00) + (v - 0x10000).bitwiseAND(F.lit(0x3FF))))
    char = lambda v: F.when(v.isNull() | (v >= 0x110000) | v.between(0xD800, 0xDFFF), "").otherwise(
        F.decode(F.unhex(F.when(v < 0x10000, unit(v)).otherwise(wide(v))), "UTF-16BE")
    )
    one = lambda e: F.when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&amp;", "&").when(e == "&quot;", '"').when(e == "&apos;", "'").otherwise(char(code(e)))
    joined = F.zip_with(gaps, found, lambda g, e: F.concat(g, F.when(e.isNull(), "").otherwise(one(e))))
    named = c
    for e, x in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        named = F.replace(named, F.lit(e), F.lit(x))
    return F.when(~c.contains("&"), c).when(c.contains("&#"), F.array_join(joined, "")).otherwise(named)
