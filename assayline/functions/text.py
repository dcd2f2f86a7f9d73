"""Text comparisons and protections used by checks and exports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayline.errors import DataQualityError

# Letters that carry no combining mark in canonical decomposition.
# An accent-insensitive collation would fold them; they must stay distinct.
UNDECOMPOSED = "łŁøØđĐħĦŧŦæÆœŒ"
# One private-use stand-in per upper/lower pair (pairs are adjacent above).
STAND_INS = "".join(chr(0xE000 + i // 2) for i in range(len(UNDECOMPOSED)))


def normalised(value: Column) -> Column:
    """Comparison form of the cross-table option: trimmed, upper case."""
    return F.upper(F.trim(value))


def folded(value: Column) -> Column:
    """Comparison form of the uniqueness check: trimmed, lower case."""
    return F.lower(F.trim(value))


def accent_key(value: Column) -> Column:
    """Key that compares text without regard to case and combining accents."""
    return F.collate(F.translate(value, UNDECOMPOSED, STAND_INS), "UNICODE_CI_AI")


def text_equal(left: Column, right: Column) -> Column:
    """Case- and accent-insensitive equality."""
    return accent_key(left) == accent_key(right)


def regex_matches(value: Column, pattern: str, options: str = "") -> Column:
    """Search for a pattern; ignores case unless option c; m = multi-line, n = dot matches newline."""
    flags = {"i"}
    for option in options or "":
        if option == "c":
            flags.discard("i")
        elif option == "i":
            flags.add("i")
        elif option == "m":
            flags.add("m")
        elif option == "n":
            flags.add("s")
        else:
            raise DataQualityError(f"Unsupported pattern option: {option}")
    prefix = f"(?{''.join(sorted(flags))})" if flags else ""
    if "i" in flags and not pattern.isascii():
        prefix = prefix.replace("i", "iu")
    return value.cast("string").rlike(prefix + pattern)


def spreadsheet_safe(value: Column) -> Column:
    """Prefix an apostrophe to text a spreadsheet would run as a formula."""
    return F.when(value.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def escaped_name(name: str) -> str:
    """A column name quoted for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col(escaped_name(name))


def percent_text(value: Column) -> Column:
    """One decimal and a percent sign, rounding the stored double exactly (ties to even).

    The value is split into a whole number and a power of two, so that rounding is decided
    on integers: a value that merely prints as a tie is not one.
    """
    shift = F.lit(62)
    for power in range(-9, 7):
        shift = F.when(value >= 2.0**power, F.lit(52 - power)).otherwise(shift)
    unit = F.expr("bigint(1)") * F.pow(F.lit(2.0), shift).cast("bigint")
    scaled = (value * unit.cast("double")).cast("bigint") * F.lit(10)
    tenths = F.call_function("div", scaled, unit)
    rest = F.pmod(scaled, unit) * F.lit(2)
    up = (rest > unit) | ((rest == unit) & (F.pmod(tenths, F.lit(2)) == 1))
    tenths = tenths + up.cast("bigint")
    return F.concat(
        F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%")
    )
