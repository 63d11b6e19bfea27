"""Results as text: one line a row, for consoles and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, title: str = "", digits: int = 4) -> DataFrame:
    """line: name=value for each column in order, doubles to `digits` places, nulls as a dash."""
    def shown(name, kind):
        c = F.col(name)
        text = F.format_string(f"%.{digits}f", c) if kind in ("double", "float") else c.cast("string")
        return F.concat(F.lit(f"{name}="), F.when(c.isNull(), F.lit("-")).otherwise(text))

    parts = [F.lit(title)] * bool(title) + [shown(c, t) for c, t in df.dtypes]
    return df.select(F.concat_ws(" ", *parts).alias("line"))
