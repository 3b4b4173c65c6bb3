"""Column expressions with T-SQL semantics, all from built-in functions."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(col(end), col(start))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Hour boundaries crossed, not elapsed hours: 10:59 to 11:01 is 1."""
    start, end = (col(c).cast("timestamp_ntz") for c in (start, end))
    return days_between(start, end) * 24 + F.hour(end) - F.hour(start)


def int_avg(c: Column | str) -> Column:
    """Average of an integer column, cut towards zero to an integer."""
    return F.avg(col(c)).cast("bigint")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as double, NULL where ``whole`` is zero."""
    whole = col(whole).cast("double")
    return col(part).cast("double") / F.when(whole != 0, whole)


def rounded_ratio(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part / whole`` to ``digits`` places as decimal, halves away from zero; NULL where ``whole`` is zero.

    Whole-number division on decimals, so that no half is lost in a binary fraction.
    """
    part = col(part)
    whole = F.when(col(whole) != 0, col(whole))
    size = F.call_function("div", F.abs(part) * (2 * 10**digits) + F.abs(whole), F.abs(whole) * 2)
    signed = F.when((part < 0) == (whole < 0), size).otherwise(-size)
    return (signed.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})")


def money(c: Column | str) -> Column:
    return col(c).cast(MONEY)


def fmt_number(c: Column | str, digits: int = 0) -> Column:
    """``1,234,567`` with ``digits`` decimals, halves rounded away from zero."""
    return F.format_number(F.round(col(c), digits), digits)


def _swap_separators(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def fmt_brl(c: Column | str) -> Column:
    """``R$ 1.234,56``."""
    c = col(c)
    sign = F.when(c < 0, F.lit("-R$ ")).otherwise(F.lit("R$ "))
    return F.concat(sign, _swap_separators(fmt_number(F.abs(c), 2)))


def fmt_pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part / whole`` as ``12,34%``."""
    percent = rounded_ratio(col(part) * 100, whole, digits)
    return F.concat(_swap_separators(fmt_number(percent, digits)), F.lit("%"))


def weekday(c: Column | str) -> Column:
    return F.date_format(col(c), "EEEE")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.sum(flag(condition))


def per_year(year: Column | str, years: Iterable[int], value: Column, prefix: str) -> list[Column]:
    """One conditional sum per year, named ``<prefix>_<year>``; 0 outside the year."""
    year = col(year)
    return [F.sum(F.when(year == y, value).otherwise(0)).alias(f"{prefix}_{y}") for y in years]


def folded(c: Column | str) -> Column:
    """What texts are compared and grouped by: case and trailing blanks don't count."""
    return F.lower(F.rtrim(col(c)))


def group_folded(df: DataFrame, names: Iterable[str], *aggregates: Column) -> DataFrame:
    """``df`` grouped by the folded texts of ``names``; each group bears the least of its spellings.

    Spellings meet in the partial aggregates, so a text with very many rows reaches its group as few. The least
    of texts is found by sorting: without ``aggregates`` equal rows are merged first, by hash, so only spellings are sorted.
    """
    names = list(names)
    if not aggregates:
        # Counted, as Spark would leave out a plain distinct before a minimum.
        df = df.groupBy(*names).agg(F.count("*").alias("__rows")).where("__rows > 0")
    keys = [folded(n).alias(f"__folded_{n}") for n in names]
    spelt = [F.min(n).alias(n) for n in names]
    return df.groupBy(*keys).agg(*spelt, *aggregates).drop(*[f"__folded_{n}" for n in names])


def with_text(df: DataFrame, formats: dict[str, Column]) -> DataFrame:
    """Turn each number ``x`` into its text form ``x`` plus the number as ``x_num``.

    Formatting comes last, so texts are never summed or sorted.
    """
    out = []
    for name in df.columns:
        if name in formats:
            out += [formats[name].alias(name), F.col(name).alias(f"{name}_num")]
        else:
            out.append(F.col(name))
    return df.select(*out)
