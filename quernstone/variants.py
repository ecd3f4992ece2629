"""Texts derived from a table's keys: rows of the given tables dressed as answers, labels or prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(texts: list[str], key: Column | str) -> Column:
    """One of the texts by the key, with # as the key's last three digits."""
    k = F.col(key) if isinstance(key, str) else key
    chosen = F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    return F.replace(chosen, F.lit("#"), (k % 1000).cast("string"))


def variant_sql(texts: list[str], key: str) -> str:
    """The same as DuckDB SQL."""
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"replace(list_extract([{quoted}], (({key}) % {len(texts)} + 1)::int), '#', (({key}) % 1000)::varchar)"
