"""Text labels of facet values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(d: Column) -> Column:
    """A double as plain decimal text: 5, 9.5, 10000000, never an exponent (up to 38 digits, 20 of them decimals)."""
    whole, text = d.try_cast("bigint"), d.cast("string")
    return (
        F.when(F.isnan(d), "NaN")
        .when((d == whole) & (F.abs(d) < 9007199254740992), whole.cast("string"))
        .when(F.abs(d) >= 9007199254740992, text.try_cast("decimal(38,0)").cast("string"))
        .when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), text)
        .otherwise(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""))
    )
