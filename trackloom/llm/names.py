"""Names of temporary columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F


def fresh(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that differs, in any case, from all of columns and from each other."""
    taken, found = {c.lower() for c in columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def own_columns(df: DataFrame) -> list:
    """All columns of df, whatever characters their names have."""
    return [F.col(f"`{c}`") for c in df.columns]


def aside(df: DataFrame, *results: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns that clash with results under other names, and a function that selects df's own columns back."""
    lower = {r.lower() for r in results}
    clashing = [c for c in df.columns if c.lower() in lower]
    other = dict(zip(clashing, fresh([*df.columns, *results], *clashing), strict=True))

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in df.columns))

    return df.withColumnsRenamed(other), back
