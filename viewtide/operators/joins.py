"""Join of a fact table to an aggregate of itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from viewtide.operators.skew import DEFAULT, HotKeys, join_cold, join_hot, row_limit


def join_back(
    df: DataFrame,
    stats: DataFrame,
    keys: str | Sequence[str],
    rows: str = "rows",
    row_id: str = "row_id",
    policy: HotKeys = DEFAULT,
    limit: Column | None = None,
) -> DataFrame:
    """Left join ``df`` to ``stats`` (one row per key of ``df``) without moving hot keys.

    ``rows`` names the column of ``stats`` with the number of ``df`` rows of each key; it is
    not part of the result. Hot keys get their values from a broadcast list of bounded
    length; the other keys are joined by exchange or, if few, by broadcast. Every row of
    ``df`` comes out once; rows with a null or unknown key get nulls. ``limit`` is the row
    limit of a hot key if the caller has it already (``df`` may be a long plan that is not
    worth counting).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    limit = row_limit(df, policy) if limit is None else limit
    marked = join_hot(df, stats, keys, rows, limit, "_shard", row_id, policy)
    return join_cold(marked, stats, keys, rows, limit, "_shard").drop("_shard")
