"""Latest version per key. An aggregate, not a window: a hot key is folded before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_version(log: DataFrame, keys: Sequence[str], version: Sequence[str],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key: the one with the greatest version tuple.

    `version` should end in a column that is unique per key, so that ties have one winner.
    """
    values = [c for c in (columns or log.columns) if c not in keys]
    return (log.groupBy(*keys)
            .agg(F.max_by(F.struct(*values), F.struct(*version)).alias("_row"))
            .select(*keys, "_row.*"))


def drop_known(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key is not stored yet."""
    return batch.join(stored.select(*keys).distinct(), list(keys), "left_anti")
