"""Names of temporary columns that no column of the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it (upper and lower case are the same to Spark)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
