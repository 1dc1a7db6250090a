"""Columns that row-wise operators read, and those that they return as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.graph import bounded_batches


def carried(df: DataFrame, key: str, text: str, carry: Sequence[str]) -> tuple[DataFrame, str, Callable[[pa.RecordBatch], dict[str, pa.Array]]]:
    """The columns id, text and carry_<name>; the schema of id and the carried ones; and those of a batch by name.

    All others are left out, so that no name of theirs can clash. The text is sent once, carried or not.
    """
    bounded_batches(df.sparkSession)
    others = [c for c in carry if c != text]
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in others))
    kinds = dict(source.dtypes)
    names = ["id", *(f"carry_{c}" for c in carry)]
    place = {name: (1 if name == f"carry_{text}" else source.columns.index(name)) for name in names}
    schema = ", ".join(f"`{name}` {kinds['text' if place[name] == 1 else name]}" for name in names)
    return source, schema, lambda batch: {name: batch.column(k) for name, k in place.items()}
