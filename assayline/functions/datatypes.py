"""Logical dataset types: conversion, refusal reasons and lossless tests as columns.

Spark's own casts are more forgiving than a data-quality import may be: they round
decimals, drop a time zone, read 'yes' as true and '2026-09' as a date. Each kind
therefore pairs a text pattern with a ``try_cast``; both must agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from assayline.errors import SchemaRefused

# The logical kinds and the width of the integer kinds.
INTEGER_TYPES = {
    "INTEGER": T.LongType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "TINYINT": T.ByteType(),
}
REAL_KINDS = ("REAL", "FLOAT", "DOUBLE")
TEXT_KINDS = ("TEXT", "STRING")
SIMPLE_TYPES = {
    **INTEGER_TYPES,
    **{kind: T.DoubleType() for kind in REAL_KINDS},
    **{kind: T.StringType() for kind in TEXT_KINDS},
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}

# Text patterns of the kinds.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
REAL_TEXT = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
LEADING_ZERO = r"^\s*[+-]?0[0-9]"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CLOCK_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?"
ZONE_TEXT = r"(Z|[+-][0-9]{2}:[0-9]{2})?$"


def decimal_spec(kind: str) -> tuple[int, int] | None:
    match = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", kind)
    if not match:
        return None
    precision, scale = int(match[1]), int(match[2])
    return (precision, scale) if 1 <= precision <= 38 and scale <= precision else None


def spark_type(kind: str) -> T.DataType:
    """The Spark type that stores a logical kind."""
    if kind in SIMPLE_TYPES:
        return SIMPLE_TYPES[kind]
    spec = decimal_spec(kind)
    if spec is None:
        raise SchemaRefused(f"Not a type of this library: {kind}")
    return T.DecimalType(*spec)


def decimal_text(precision: int, scale: int) -> str:
    """Digits that fit DECIMAL(precision, scale) exactly, whatever zeros surround them."""
    whole = r"0*[0-9]{0,%d}" % (precision - scale)
    part = r"[.][0-9]{0,%d}0*" % scale
    return rf"^[+-]?{whole}({part})?$"


def _fits(text: Column, kind: str) -> Column:
    """True where the text may be cast to the kind; the cast still has to succeed."""
    if kind in INTEGER_TYPES:
        return text.rlike(INTEGER_TEXT)
    if kind in REAL_KINDS:
        return text.rlike(REAL_TEXT)
    if kind == "BOOLEAN":
        return F.lower(text).isin("0", "1", "true", "false")
    if kind == "DATE":
        return text.rlike(DATE_TEXT)
    if kind == "TIMESTAMP":
        return text.rlike(CLOCK_TEXT + ZONE_TEXT)
    if kind == "TIMESTAMP_NTZ":
        return text.rlike(CLOCK_TEXT + "$")
    precision, scale = decimal_spec(kind)
    return text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$") & text.rlike(decimal_text(precision, scale))


def _finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def parse(text: Column, kind: str) -> Column:
    """The typed value of a text, NULL where it is NULL or does not fit the kind."""
    target = spark_type(kind)
    if kind in TEXT_KINDS:
        return text
    if kind == "DATE":
        typed = F.try_to_date(text, "yyyy-MM-dd")
    elif kind == "BOOLEAN":
        typed = F.lower(text).isin("1", "true")
    elif kind in REAL_KINDS:
        typed = _finite(F.trim(text).try_cast(target))
    else:
        typed = F.trim(text).try_cast(target)
    return F.when(_fits(text, kind), typed)


def _refusal(kind: str) -> str:
    if kind in INTEGER_TYPES:
        return "not a whole number of this width"
    if kind in REAL_KINDS:
        return "not a finite number"
    return f"does not fit {kind}"


def cell_value(text: Column, kind: str) -> Column:
    """Typed value of a file cell; an empty cell is NULL."""
    return parse(F.when(text != "", text), kind)


def cell_reason(text: Column, kind: str, required: bool = False, default: object = None) -> Column:
    """Why a file cell is refused, NULL where it is accepted."""
    empty = F.coalesce(text == "", F.lit(True))
    missing = F.lit("a value is required") if required and default is None else F.lit(None).cast("string")
    if kind in TEXT_KINDS:
        return F.when(empty, missing)
    return F.when(empty, missing).when(parse(text, kind).isNull(), F.lit(_refusal(kind)))


def _decimal_form(text: Column) -> Column:
    """(negative, significant digits, power of ten) of a decimal text, for exact comparison."""
    mantissa = F.regexp_replace(F.lower(text), r"e.*$", "")
    exponent = F.coalesce(F.regexp_extract(F.lower(text), r"e([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    fraction = F.regexp_extract(mantissa, r"[.]([0-9]*)$", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"[^0-9]", ""), r"^0+", "")
    bare = F.regexp_replace(digits, r"0+$", "")
    power = F.when(bare == "", F.lit(0)).otherwise(
        exponent - F.length(fraction) + F.length(digits) - F.length(bare)
    )
    return F.struct(
        (mantissa.startswith("-") & (bare != "")).alias("negative"),
        bare.alias("digits"),
        power.alias("power"),
    )


def _exact_whole_double(text: Column, number: Column) -> Column:
    """Whole numbers must be representable as a double, not merely print alike."""
    whole = F.abs(text.try_cast("decimal(38,0)"))
    # A double keeps 53 significant bits, so a larger whole number must be a multiple of 2^shift.
    shift = F.greatest(F.floor(F.log2(F.abs(number))).cast("int") - F.lit(52), F.lit(0))
    low = F.least(shift, F.lit(40))
    step = (
        F.expr("cast(1 as bigint)") * F.pow(F.lit(2.0), low).cast("bigint")
    ).cast("decimal(19,0)") * F.pow(F.lit(2.0), F.greatest(shift - low, F.lit(0))).cast("bigint").cast("decimal(19,0)")
    return F.when(whole == 0, F.lit(True)).otherwise(F.coalesce(F.try_mod(whole, step) == 0, F.lit(False)))


def lossless(value: Column, source: T.DataType, kind: str) -> Column:
    """True where converting the value to the kind keeps it exactly (NULL stays NULL)."""
    spark_type(kind)
    text = value.cast("string")
    is_text = isinstance(source, (T.StringType, T.CharType, T.VarcharType))
    if isinstance(source, T.BinaryType):
        kept = F.lit(False)
    elif kind in TEXT_KINDS:
        kept = F.lit(True)
    elif kind in INTEGER_TYPES or kind in REAL_KINDS:
        if isinstance(source, T.BooleanType) or not (is_text or isinstance(source, T.NumericType)):
            kept = F.lit(False)
        else:
            kept = _lossless_number(text, is_text, kind)
    elif kind == "BOOLEAN":
        if isinstance(source, T.BooleanType):
            kept = F.lit(True)
        elif is_text:
            kept = _fits(text, kind)
        else:
            kept = value.isin(0, 1) if isinstance(source, T.IntegralType) else F.lit(False)
    elif decimal_spec(kind):
        kept = (
            F.lit(False)
            if isinstance(source, (T.FloatType, T.DoubleType, T.BooleanType))
            else parse(text, kind).isNotNull()
        )
    elif isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        zoned = isinstance(source, T.TimestampType)
        kept = F.lit(kind == "TIMESTAMP" or (kind == "TIMESTAMP_NTZ" and not zoned))
    else:
        kept = parse(text, kind).isNotNull()
    return value.isNull() | F.coalesce(kept, F.lit(False))


def _lossless_number(text: Column, is_text: bool, kind: str) -> Column:
    """Exactness of a numeric text. Short plain numbers are decided without digit arithmetic."""
    plain = text.rlike(REAL_TEXT)
    if is_text:
        plain = plain & ~text.rlike(r"\s") & ~text.rlike(LEADING_ZERO)
    form = _decimal_form(text)
    whole = form["power"] >= 0
    if kind in INTEGER_TYPES:
        target = spark_type(kind)
        simple = text.rlike(r"^([+-]?[1-9][0-9]{0,18}|0)$")
        exact = text.try_cast("decimal(38,0)").try_cast(target).isNotNull()
        return F.when(simple, text.try_cast(target).isNotNull()).when(plain, whole & exact)
    number = _finite(text.try_cast("double"))
    same = _decimal_form(number.cast("string")) == form
    # Up to fifteen digits always survive the way to a double and back.
    simple = (F.length(text) <= 15) & text.rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?$")
    return F.when(simple, F.lit(True)).when(
        plain, number.isNotNull() & same & (~whole | _exact_whole_double(text, number))
    )


def convert(value: Column, source: T.DataType, kind: str) -> Column:
    """The converted value where it is lossless, NULL otherwise."""
    target = spark_type(kind)
    text = value.cast("string")
    if kind in TEXT_KINDS:
        return text
    if kind in INTEGER_TYPES:
        typed = text.try_cast("decimal(38,0)").try_cast(target)
    elif isinstance(source, (T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        typed = value.try_cast(target)
    else:
        typed = parse(text, kind)
    return F.when(lossless(value, source, kind), typed)


def suggest_kind(total: Column, leading_zero: Column, whole: Column, real: Column) -> Column:
    """Kind suggested from counts of non-blank, leading-zero, whole and finite texts."""
    return (
        F.when((total == 0) | (leading_zero > 0), F.lit("TEXT"))
        .when(whole == total, F.lit("INTEGER"))
        .when(real == total, F.lit("REAL"))
        .otherwise(F.lit("TEXT"))
    )
