"""Splitting of hot keys.

One streamer or user may own a large share of a log. Work that needs all rows of a key
together is therefore keyed on ``(key, shard)``: ordinary keys have the single shard 0,
hot keys one shard per span of row ids, so that no task holds more than ``shard_rows`` rows
of a hot key. Rows without a key are spread the same way, since a hash exchange would
otherwise send all of them to one partition.

A key is hot when it has more than ``max(min_rows, total / max_keys)`` rows. At most
``max_keys`` keys can exceed that, whatever the data, which is what makes it safe to
broadcast the list of hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.functions.arithmetic import int_div


@dataclass(frozen=True)
class HotKeys:
    """When a key counts as hot and how finely it is split."""

    max_keys: int = 65_536
    min_rows: int = 1_000_000
    shard_rows: int = 1_000_000


DEFAULT = HotKeys()


def row_limit(df: DataFrame, policy: HotKeys) -> Column:
    """Scalar subquery: rows above which a key of ``df`` is hot."""
    per_key = int_div(F.count(F.lit(1)), F.lit(policy.max_keys))
    return df.agg(F.greatest(F.lit(policy.min_rows).cast("bigint"), per_key).alias("row_limit")).scalar()


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def shard_of(hot: Column, keys: Sequence[str], row_id: str, policy: HotKeys) -> Column:
    """Shard number: 0 for ordinary keys, 1 + row-id span for hot and missing keys."""
    span = int_div(F.col(row_id), F.lit(policy.shard_rows)) + 1
    return F.when(hot | any_null(keys), span).otherwise(F.lit(0)).cast("bigint")


def add_shards(
    df: DataFrame, keys: Sequence[str], shard: str, row_id: str = "row_id", policy: HotKeys = DEFAULT
) -> DataFrame:
    """Add the shard column and ``_hot`` mark, finding hot keys with one pre-aggregated count."""
    sizes = df.where(~any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return join_hot(df, sizes, keys, "rows", row_limit(df, policy), shard, row_id, policy)


def join_hot(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    rows: str,
    limit: Column,
    shard: str,
    row_id: str = "row_id",
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """Add the shard column, a ``_hot`` mark and, as ``_hot_<name>``, the statistics of hot keys.

    ``stats`` has one row per key and in ``rows`` the number of ``df`` rows of the key. Only
    its hot keys, at most ``policy.max_keys`` rows, are broadcast.
    """
    values = [c for c in stats.columns if c not in (*keys, rows)]
    hot = stats.where(F.col(rows) > limit).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    return df.join(F.broadcast(hot), list(keys), "left").select(
        *df.columns,
        *[f"_hot_{v}" for v in values],
        "_hot",
        shard_of(F.col("_hot").isNotNull(), keys, row_id, policy).alias(shard),
    )


def join_cold(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], rows: str, limit: Column, shard: str
) -> DataFrame:
    """Complete ``join_hot``: join the statistics of all other keys on ``(key, shard 0)``.

    Rows of hot and missing keys have another shard, so they spread over the exchange and
    match nothing. The adaptive planner picks broadcast or sort-merge from the measured size.
    """
    values = [c for c in stats.columns if c not in (*keys, rows)]
    # Always 0, as a key has rows, but no literal: the optimizer would turn an equality with a
    # literal into a filter and hash the exchange on the key alone.
    zero = F.least(F.col(rows), F.lit(0)).cast("bigint")
    cold = stats.where(F.col(rows) <= limit).select(
        *keys, zero.alias(shard), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    kept = [c for c in df.columns if c not in {"_hot", *[f"_hot_{v}" for v in values]}]
    return df.join(cold, [*keys, shard], "left").select(
        *kept, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values]
    )
