"""Columns by field name; fields may hold dots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(field: str) -> Column:
    return F.col("`" + field.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
