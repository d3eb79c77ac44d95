"""Deterministic splits by the CRC-32 of an id's decimal text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(column: str | Column, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))) % n
