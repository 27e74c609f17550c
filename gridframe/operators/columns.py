"""Column addressing: by name or by position, also where names repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | int


def names_of(df: DataFrame, keys: Key | Sequence[Key] | None) -> list[str]:
    """Names of columns given by name or position; KeyError or IndexError for unknown ones."""
    if keys is None:
        return list(df.columns)
    out = []
    for k in [keys] if isinstance(keys, (str, int)) else list(keys):
        if isinstance(k, bool) or not isinstance(k, (str, int)):
            raise TypeError(f"column {k!r} is neither a name nor a position")
        if isinstance(k, int):
            if not -len(df.columns) <= k < len(df.columns):
                raise IndexError(f"column {k} of {len(df.columns)}")
            out.append(df.columns[k])
        elif k in df.columns:
            out.append(k)
        else:
            raise KeyError(k)
    return out


def col(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    name = base
    while name in df.columns:
        name += "_"
    return name


def numbered(df: DataFrame, start: str = "c") -> DataFrame:
    """``df`` with columns named by position, so that repeated names can be addressed."""
    return df.toDF(*[f"{start}{i}" for i in range(len(df.columns))])
