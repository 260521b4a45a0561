"""Column helpers: rows kept whole beside computed columns, and expressions evaluated once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_input_row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct, so that no computed column can clash with an input column."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(ROW), *more)


def unpacked(df: DataFrame, names: Sequence[str], results: Sequence[str]) -> DataFrame:
    """The input columns again, then the results; an input column named like a result gives way to it."""
    kept = [F.col(f"{ROW}.{quoted(c)}").alias(c) for c in names if c not in results]
    return df.select(*kept, *[F.col(quoted(c)) for c in results])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
