"""Look-ups whose key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64


def spread_lookup(
    rows: DataFrame, table: DataFrame, on: list[str], *, by: list[str], how: str = "left", parts: int = PARTS
) -> DataFrame:
    """``rows.join(table, on, how)`` for a table of one row a key, with no key's rows in one task.

    Rows are dealt by their key and the hash of ``by``. Every (key, part) that occurs fetches
    the key's row once, a table of at most ``parts`` rows a key, and the rows join that. ``rows`` is read twice.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    asked = dealt.select(*on, "_part").distinct().join(table, on, how)
    return dealt.join(asked, [*on, "_part"], how).drop("_part")
