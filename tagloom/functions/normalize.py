"""Duck-typed values as Column expressions: cells of native types keep them, strings are read as dates, numbers or text.

Every function takes the column and its type, so that a native column is never cast without need and a comparison on
it still reaches the Parquet scan.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what Python's float() reads, as a Java pattern.
PY_FLOAT = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*$"
SPACE = r"(?U)\s+"
#: Letters that Unicode does not take apart, and their usual spelling.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
STROKED = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one plain letter, and those letters."""
    pairs = dict(STROKED)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        plain = "".join(c for c in parts if not unicodedata.combining(c))
        if parts != chr(code) and len(plain) == 1 and plain.isascii():
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def is_number_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time_type(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.NullType))


def render_number(x: Column) -> Column:
    """A double as text: whole numbers without a point, others as Python writes them."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    small = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e-3)
    digits = F.regexp_replace(x.cast("decimal(38,22)").cast("string"), "0+$", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), "E(?!-)", "e+"), r"E-(\d)$", "e-0$1")
    return F.when(whole, x.cast("long").cast("string")).when(small, digits).otherwise(F.regexp_replace(power, "E-", "e-"))


def as_text(c: Column, t: T.DataType) -> Column:
    """The cell as text, never null."""
    if is_text(t):
        return F.coalesce(c.cast("string"), F.lit(""))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce(render_number(c.cast("double")), F.lit(""))
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    if isinstance(t, T.BooleanType):
        return F.when(c.isNull(), "").when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit(""))


def is_empty(c: Column, t: T.DataType) -> Column:
    return (F.coalesce(c.cast("string"), F.lit("")).rlike(r"(?U)^\s*$")) if is_text(t) else c.isNull()


def is_truthy(c: Column, t: T.DataType) -> Column:
    """Whether the cell says yes: y, yes, t, true or 1."""
    return F.lower(F.trim(as_text(c, t))).isin("y", "yes", "t", "true", "1")


def is_token(c: Column, t: T.DataType) -> Column:
    """Whether the cell is one word that could be a tag."""
    return as_text(c, t).rlike(r"^\s*[A-Za-z][_0-9A-Za-z]*\s*$")


def truthy(c: Column, t: T.DataType) -> Column:
    """The cell, or null where it is the empty string."""
    return F.nullif(c.cast("string"), F.lit("")) if is_text(t) else c


def norm_space(c: Column, t: T.DataType) -> Column:
    return F.trim(F.regexp_replace(as_text(c, t), SPACE, " "))


def plain_letters(text: Column) -> Column:
    out = F.translate(text, ACCENTED, PLAIN)
    for letter, spelling in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(out)


def norm_string(c: Column, t: T.DataType) -> Column:
    """Text in lower case, without accents, blanks collapsed."""
    return F.lower(plain_letters(norm_space(c, t)))


def python_norm_string(value: object) -> str:
    """norm_string() of a driver-side value."""
    out = str("" if value is None else value).translate({ord(a): p for a, p in zip(ACCENTED, PLAIN, strict=True)} | {ord(k): v for k, v in SPELLED.items()})
    return " ".join(out.split()).lower()


def number(c: Column, t: T.DataType) -> Column:
    """The cell as a finite number, or null. Native numbers stay as they are."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if is_number_type(t):
        return c
    if not is_text(t):
        return F.lit(None).cast("double")
    n = F.when(c.rlike(PY_FLOAT), F.replace(F.trim(F.regexp_replace(c, SPACE, "")), F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def is_number(c: Column, t: T.DataType) -> Column:
    return c.isNotNull() if is_number_type(t) else F.coalesce(c.rlike(PY_FLOAT), F.lit(False)) if is_text(t) else F.lit(False)


def python_number(value: object) -> float | int | None:
    try:
        n = float(value)
        return int(n) if n == int(n) else n
    except (TypeError, ValueError, OverflowError):
        return None


def typed_key(c: Column, t: T.DataType, date: bool = False, dayfirst: bool = True) -> Column:
    """struct(is_str, num, str): numbers before text, 1 and 1.0 alike; dates, where date is set, are text in ISO form."""
    from .dates import norm_date

    if is_number_type(t) and not date:
        return F.struct(F.lit(False).alias("is_str"), c.cast("double").alias("num"), F.lit("").alias("str"))
    if is_time_type(t):
        return F.struct(F.lit(True).alias("is_str"), F.lit(None).cast("double").alias("num"), F.date_format(c, "yyyy-MM-dd").alias("str"))
    day = norm_date(c, t, dayfirst) if date else F.lit(None).cast("string")
    n = F.when(day.isNotNull(), None).otherwise(number(c, t)).cast("double")
    text = F.when(day.isNotNull(), day).when(n.isNotNull(), "").otherwise(norm_string(c, t))
    return F.struct(n.isNull().alias("is_str"), n.alias("num"), text.alias("str"))


def sort_keys(c: Column, t: T.DataType, date: bool = False) -> list[Column]:
    """Columns that sort cells: numbers first, then text; dates by their ISO form."""
    from .dates import norm_date

    if is_number_type(t) and not date:
        return [c]
    if is_time_type(t):
        return [c]
    if date:
        return [F.coalesce(norm_date(c, t), norm_string(c, t))]
    return [F.coalesce(number(c, t).cast("double"), F.lit(float("inf"))), norm_string(c, t)]


def java_regex(pattern: str) -> str:
    """A Python regular expression in Java's syntax, with Unicode classes as Python has them."""
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", out)
    return "(?U)" + out.replace(r"\Z", r"\z")


def java_replacement(text: str) -> str:
    r"""A Python replacement (\1, \g<1>, \g<name>) in Java's syntax."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1].replace('_', '')}}}", out)
    return re.sub(r"\\(\d+)", r"$\1", out)


def check_regex(spark, pattern: str) -> None:
    """Raise on the driver, not in a task, if Java cannot read a pattern."""
    spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
