"""Small scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_MAG_TYPE = "Mw"


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Limit to ``[low, high]``; the upper bound wins if the two cross; null stays null."""
    as_col = lambda b: b if isinstance(b, Column) else F.lit(b)
    bounded = F.least(F.greatest(value, as_col(low)), as_col(high))
    return F.when(value.isNotNull(), bounded)


def mag_class(mag: Column) -> Column:
    return (
        F.when(mag >= 8, "M8+")
        .when(mag >= 7, "M7-8")
        .when(mag >= 6.5, "M6.5-7")
        .otherwise("M6-6.5")
    )


def mag_type_or_default(mag_type: Column) -> Column:
    """Trimmed magnitude type; missing or blank becomes the default type."""
    trimmed = F.trim(mag_type)
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit(DEFAULT_MAG_TYPE))


def log10_count(n: Column) -> Column:
    """Regression target; null for zero."""
    return F.log10(n.cast("double"))


def count_from_log10(y: Column) -> Column:
    return F.pow(F.lit(10.0), y)


def digits14(text: Column, suffix: str) -> Column:
    """The 14-digit id in front of ``suffix`` in a file name."""
    return F.regexp_extract(text, r"(\d{14})" + suffix, 1)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def last_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def round_columns(df: DataFrame, digits: int = 6, other: dict[str, int] | None = None) -> DataFrame:
    """Round every double column, for reports and comparisons."""
    other = other or {}
    return df.select(
        *[
            F.round(F.col(c), other.get(c, digits)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def fill_numeric(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """Cast to double and replace null and NaN by ``value``."""
    as_double = {c: F.col(c).cast("double") for c in cols}
    return df.withColumns(
        {
            c: F.coalesce(F.nanvl(v, F.lit(value)), F.lit(value))
            for c, v in as_double.items()
        }
    )


def project_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in cols if c in df.columns])
