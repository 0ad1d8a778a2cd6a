"""Ordered operators: previous session of a key, and rolling means over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.functions.arithmetic import int_div
from viewtide.operators.skew import DEFAULT, HotKeys, add_shards, any_null
from viewtide.sources.order import sorted_order


def prev_session(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str = "duration",
    name: str = "prev_session_duration",
    order_col: str = "row_id",
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """Value of the key's preceding row in ``order_col`` order, 0 for its first row.

    ``order_col`` is a dense row order. Rows with a null key have no predecessor and get 0.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sharded = add_shards(df, keys, "_shard", order_col, policy)
    return prev_in_shards(sharded, keys, keys, "_shard", value, name, order_col).drop("_shard")


def prev_session_by(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column | str],
    value: str = "duration",
    name: str = "prev_session_duration",
    policy: HotKeys = DEFAULT,
) -> DataFrame:
    """``prev_session`` in any order of the rows, say ``["start_time", "row_id"]``.

    ``order`` must tell all rows apart; end it with a unique column. The rows get their dense position in it first, so
    a key with a large share of the rows is cut into spans of that order like any other.
    """
    placed = sorted_order(df, order, "_place")
    return prev_session(placed, keys, value, name, "_place", policy).drop("_place")


def prev_in_shards(
    df: DataFrame,
    keys: Sequence[str],
    shard_keys: Sequence[str],
    shard: str,
    value: str,
    name: str,
    order_col: str = "row_id",
) -> DataFrame:
    """``prev_session`` on a table with shards and ``_hot`` marks for ``shard_keys`` out of ``keys``.

    Each shard of a hot key first receives a copy of the last row of the key's previous
    shard, so that a plain ``lag`` inside the shard is right for its first row too. There is
    one copy per ``(hot key, shard)``; the copies are dropped afterwards. The rows are
    exchanged once, on the shard keys, and stay so for a join on them.
    """
    rows = df.drop("_hot").withColumn("_copy", F.lit(False))
    # A filter on the mark turns the join that made it into an inner one, so without hot keys
    # the adaptive planner drops this branch before it scans anything.
    tails = (
        df.where(F.col("_hot") & ~any_null(keys))
        .groupBy(*keys, shard)
        .agg(F.max_by(value, order_col).alias(value))
    )
    later = F.lead(shard).over(Window.partitionBy(*keys).orderBy(shard))
    copies = (
        tails.select(*keys, later.alias(shard), value, F.lit(True).alias("_copy"))
        .where(F.col(shard).isNotNull())
    )
    within = Window.partitionBy(*keys, shard).orderBy(F.col("_copy").desc(), order_col)
    previous = F.when(~any_null(keys), F.lag(value).over(within))
    return (
        rows.unionByName(copies, allowMissingColumns=True)
        .repartition(*shard_keys, shard)
        .withColumn(name, F.coalesce(previous, F.lit(0)))
        .where(~F.col("_copy"))
        .drop("_copy")
    )


def rolling_mean(
    df: DataFrame, idx: str, columns: Sequence[str], width: int = 50, block: int = 16_384
) -> DataFrame:
    """Trailing mean of the last ``width`` rows in ``idx`` order.

    Null for the first rows and wherever a null value is among the ``width``. ``idx`` is dense
    from 0. Rows are cut into blocks of ``block`` consecutive indexes; each block also receives
    the last ``width - 1`` rows of the block before it, so every block is computed on its own
    and no task sees more than ``block + width - 1`` rows. The copies are dropped afterwards.
    """
    if not 1 <= width <= block:
        raise ValueError("width must be between 1 and block")
    own = int_div(F.col(idx), F.lit(block))
    in_tail = F.pmod(F.col(idx), F.lit(block)) >= block - (width - 1)
    blocks = F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.select(idx, *columns).withColumn("_block", F.explode(blocks))

    ordered = Window.partitionBy("_block").orderBy(idx)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    trailing = ordered.rowsBetween(1 - width, 0)
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    # Whole numbers add up exactly, so their window is the difference of two running totals: a
    # constant amount of work per row. Other types are summed window by window.
    rows = rows.withColumns(
        {f"_sum_{c}": F.sum(c).over(so_far) for c in whole} | {f"_n_{c}": F.count(c).over(so_far) for c in whole}
    )

    def in_window(total: str) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, width).over(ordered), F.lit(0))

    means = [
        F.when(in_window(f"_n_{c}") == width, in_window(f"_sum_{c}") / width)
        if c in whole
        else F.when(F.count(c).over(trailing) == width, F.avg(c).over(trailing))
        for c in columns
    ]
    return (
        rows.select(idx, "_block", *[m.alias(c) for m, c in zip(means, columns, strict=True)])
        .where(F.col("_block") == own)
        .select(idx, *columns)
    )
