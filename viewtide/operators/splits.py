"""Row order, caps, train/test splits and folds.

Everything is a pure function of a dense whole-number index, so a split is the same for any
partitioning of the data, and selecting a part is a filter, not a shuffle. Sizes come from a
scalar count, which Spark answers from Parquet footers for a stored table. Where the index
hangs off a long plan, pass ``n``, the count of the table it was made from, instead of having
the plan run once more just to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewtide.functions.arithmetic import int_div

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# Fixed value: keys of the shuffled split are the first 32 bits of an MD5.
KEY_SPACE = 1 << 32

#: Rows per partition of a table that fits read, how many partitions it gets before they grow, and the rows they grow to.
SPAN_ROWS, MAX_SPANS, MAX_SPAN_ROWS = 1 << 13, 1 << 7, 1 << 20


def head_rows(df: DataFrame, n: int | None, order_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows in file order, or all of them for ``None``."""
    return df if n is None else df.where(F.col(order_col) < n)


def row_count(df: DataFrame) -> Column:
    """Scalar subquery with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def test_size(n: Column, num: int = 1, den: int = 5) -> Column:
    """Rows in the test part, rounded up."""
    return int_div(n * num + (den - 1), F.lit(den))


def positional_split(
    df: DataFrame,
    idx: str = "row_id",
    num: int = 1,
    den: int = 5,
    name: str = "part",
    n: Column | None = None,
) -> DataFrame:
    """Mark the last ``ceil(n * num / den)`` rows in ``idx`` order as test, the others as train."""
    n = row_count(df) if n is None else n
    return df.withColumn(
        name, F.when(F.col(idx) < n - test_size(n, num, den), F.lit(TRAIN)).otherwise(F.lit(TEST))
    )


def validation_tail(
    df: DataFrame, idx: str = "row_id", num: int = 1, den: int = 5, name: str = "part"
) -> DataFrame:
    """Positional split whose training part gives its own last ``num / den`` up as validation."""
    n = row_count(df)
    train = n - test_size(n, num, den)
    i = F.col(idx)
    part = F.when(i < train - test_size(train, num, den), F.lit(TRAIN))
    return df.withColumn(name, part.when(i < train, F.lit(VALIDATION)).otherwise(F.lit(TEST)))


def shuffle_key(idx: str, seed: int = 42) -> Column:
    """Repeatable uniform key in [0, 2^32) of a row, independent of partitioning."""
    text = F.concat_ws(":", F.col(idx).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_split(
    df: DataFrame, idx: str = "row_id", num: int = 1, den: int = 5, seed: int = 42, name: str = "part"
) -> DataFrame:
    """Mark about ``num / den`` of the rows, chosen by hash, as test. No shuffle."""
    threshold = -(-KEY_SPACE * num // den)
    return df.withColumn(
        name, F.when(shuffle_key(idx, seed) < threshold, F.lit(TEST)).otherwise(F.lit(TRAIN))
    )


def shuffled_index(
    df: DataFrame,
    idx: str = "row_id",
    seed: int = 42,
    name: str = "shuffled_idx",
    buckets: int = 1 << 16,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Dense position of every row in a seeded random order, for splits of an exact size.

    The hash key is uniform, so cutting its range into buckets gives even groups: a row's
    position is the number of rows in earlier buckets plus its rank inside its own. Only the
    bucket counts, at most ``buckets`` rows, are accumulated in one place. Where ``df`` is a long
    plan, pass ``ids``, a cheap table with the same ``idx`` values, to take the counts from.
    """

    def with_bucket(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_key", shuffle_key(idx, seed))
        return rows.withColumn("_bucket", int_div(F.col("_key") * buckets, F.lit(KEY_SPACE)))

    keyed = with_bucket(df)
    counted = keyed if ids is None else with_bucket(ids.select(idx))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", idx))
    return (
        keyed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .select(*df.columns, (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias(name))
    )


def by_spans(df: DataFrame, idx: str, n: int, span: int = SPAN_ROWS, spans: int = MAX_SPANS) -> DataFrame:
    """Rows partitioned and sorted by spans of a dense index below ``n``.

    A span holds ``span`` rows, doubled until there are at most ``spans`` or a span holds ``MAX_SPAN_ROWS``: a fit
    runs two stages a tree level over all partitions, and each of these tasks sends statistics of every node.
    The layout depends on the index alone, not on cores, files or earlier partitions, so seeded fits repeat anywhere.
    """
    while n > span * spans and span < MAX_SPAN_ROWS:
        span *= 2
    placed = df.withColumn("_span", int_div(F.col(idx), F.lit(span)).cast("int"))
    return placed.repartitionById(max(1, -(-n // span)), "_span").drop("_span").sortWithinPartitions(idx)


def kfold(df: DataFrame, idx: str, k: int, name: str = "fold") -> DataFrame:
    """Contiguous folds 0..k-1 over a dense index; the first ``n mod k`` folds get one row more."""
    n = row_count(df)
    size, extra = int_div(n, F.lit(k)), F.pmod(n, F.lit(k))
    i = F.col(idx)
    in_large = i < extra * (size + 1)
    fold = F.when(in_large, int_div(i, size + 1)).otherwise(
        extra + int_div(i - extra * (size + 1), F.greatest(size, F.lit(1)))
    )
    return df.withColumn(name, fold.cast("int"))


def fold_bounds(n: int, k: int, fold: int) -> tuple[int, int]:
    """First and one-past-last index of a contiguous fold."""
    size, extra = divmod(n, k)
    first = fold * size + min(fold, extra)
    return first, first + size + (1 if fold < extra else 0)


def prefix_size(n: int, k: int, step: int, steps: int = 10) -> int:
    """Rows of training prefix ``step`` of ``steps``; every fold uses the first fold's training size."""
    first, end = fold_bounds(n, k, 0)
    return (n - (end - first)) * step // steps


def fold_prefix(df: DataFrame, idx: str, n: int, k: int, fold: int, step: int, steps: int = 10) -> DataFrame:
    """Training prefix of a held-out fold as a plain range filter on the dense index.

    Folds are contiguous, so the training part is the rows before and after the fold, and a
    prefix of it is at most two index ranges, which reach the Parquet scan as filters.
    """
    first, end = fold_bounds(n, k, fold)
    rows = prefix_size(n, k, step, steps)
    i = F.col(idx)
    return df.where((i < min(first, rows)) | ((i >= end) & (i < rows + (end - first))))


def learning_curve_sizes(df: DataFrame, idx: str, k: int, steps: int = 10, n: int | None = None) -> DataFrame:
    """Rows of each growing training prefix of each fold, counted on the data.

    A prefix is one or two ranges of the index, so the ends of all prefixes cut it into at most ``3 * k * steps + 1`` stretches.
    Each row is counted once, in its stretch, found by bisection; a prefix is then the sum of the stretches it covers.
    """
    n = df.count() if n is None else n
    prefixes = []
    for fold in range(k):
        first, end = fold_bounds(n, k, fold)
        for step in range(1, steps + 1):
            rows = prefix_size(n, k, step, steps)
            prefixes.append((fold, step, min(first, rows), end, max(end, rows + (end - first))))
    ends = sorted({x for p in prefixes for x in p[2:]})

    def stretch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(idx) < ends[middle], stretch(low, middle)).otherwise(stretch(middle + 1, high))

    counted = df.groupBy(stretch(0, len(ends)).alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_first"))
    spark, i = df.sparkSession, F.col("_first")
    cuts = spark.createDataFrame(prefixes, "held_out int, step int, _before bigint, _from bigint, _to bigint")
    return (
        counted.join(F.broadcast(cuts), (i < F.col("_before")) | ((i >= F.col("_from")) & (i < F.col("_to"))))
        .groupBy("held_out", "step")
        .agg(F.sum("_n").alias("train_rows"))
    )
