"""Names for helper columns that clash with none of a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that `df` has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
