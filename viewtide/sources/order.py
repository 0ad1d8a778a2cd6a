"""Dense row ids in file order.

A log's order is its file order, then the order inside each file. Files are ordered by path, digit
runs in it comparing as numbers (``part-9`` before ``part-10``), unless the caller gives a key. A row's id is the number
of rows in all earlier pieces plus its position in its own piece, so rows are never sorted or
moved to number them. What is accumulated in one place is one row per piece of input, the
list of files the driver holds for the scan anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewtide.session import stage_table

# Offsets of this many pieces take some 30 MB.
BROADCAST_PIECES = 1 << 19


def natural_key(path: Column) -> Column:
    """Sort key of a path: its text and digit runs in turn, numbers by length and then by digits."""
    runs = F.regexp_extract_all(path, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        number = F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
        return F.when(run.rlike("^[0-9]"), number).otherwise(run)

    return F.transform(runs, key)


def _piece_offsets(pieces: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows before each piece, pieces being taken in ``order``."""
    before = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def parquet_row_order(
    spark: SparkSession, path: str, name: str = "row_id", file_key: Callable[[Column], Column] = natural_key
) -> DataFrame:
    """A Parquet table with a dense row id in file order, from the reader's own row index."""
    table = spark.read.parquet(path)
    rows = table.select(
        *table.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_pos"),
    )
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _piece_offsets(counts, [file_key(F.col("_file")), "_file"]).select("_file", "_before")
    return rows.join(offsets, "_file").select(
        *table.columns, (F.col("_before") + F.col("_pos")).alias(name)
    )


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def text_row_order(
    rows: DataFrame, name: str = "row_id", file_key: Callable[[Column], Column] = natural_key
) -> DataFrame:
    """Number the rows of a text-based scan (CSV, JSON, text; compressed or not).

    A piece is a file or, for a splittable file, one split of it. Spark numbers the rows of a
    scan task consecutively, so a row's position in its piece is its number minus the
    piece's smallest one. The scan is read twice: once for the counts, once for the rows.
    """
    numbered = _numbered(rows)
    pieces = numbered.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first")
    )
    offsets = _piece_offsets(pieces, [file_key(F.col("_file")), "_file", "_start"]).select("_file", "_start", "_first", "_before")
    return numbered.join(offsets, ["_file", "_start"]).select(
        *rows.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias(name)
    )


def staged_text_order(
    rows: DataFrame, where: Column, name: str = "row_id", file_key: Callable[[Column], Column] = natural_key
) -> tuple[DataFrame, DataFrame]:
    """``text_row_order`` that decodes the text once: the numbered rows, and the staged table they are read from.

    Rows are written with their number, counts are taken from what is written, and each row finds its piece's offset by
    scan task and a hash of file and start, 16 bytes a piece instead of a path. ``where`` must hold for every
    row or fail (a check of the fields); it runs while the text is read. Up to ``BROADCAST_PIECES`` pieces their offsets
    are broadcast and no row moves. Pieces of one task whose hashes agree are an error, not a wrong number.
    """
    numbered = _numbered(rows).where(where).withColumns({"_task": F.shiftright("_seq", 33).cast("int"), "_piece": F.xxhash64("_file", "_start")})
    staged = stage_table(numbered, "text-rows")
    counts = staged.groupBy("_task", "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"), *[f(c).alias(f"_{at}{c}") for c in ("_file", "_start") for at, f in (("least", F.min), ("most", F.max))]
    )
    one = (F.col("_least_file") == F.col("_most_file")) & (F.col("_least_start") == F.col("_most_start"))
    pieces = counts.withColumn("_file", F.when(one, F.col("_least_file")).otherwise(F.raise_error("two pieces of the log share a hash")))
    offsets = stage_table(
        _piece_offsets(pieces, [file_key(F.col("_file")), "_file", "_least_start"]).select("_task", "_piece", (F.col("_before") - F.col("_first")).alias("_shift")),
        "piece-offsets",
    )
    few = offsets.count() <= BROADCAST_PIECES
    placed = staged.join(F.broadcast(offsets) if few else offsets, ["_task", "_piece"])
    return placed.select(*rows.columns, (F.col("_seq") + F.col("_shift")).alias(name)), staged


def sorted_order(df: DataFrame, order: Sequence[Column | str], name: str = "row_id") -> DataFrame:
    """The rows with their dense position in ``order``, as a staged table sorted by it.

    ``order`` must tell all rows apart (end it with a unique column), so that no value, however frequent, holds
    a whole partition. The rows are exchanged once, by ranges of the order. Range bounds come from a sample and may differ when the plan
    runs again, so the rows are written with piece and position in it, and the counts are taken from what is
    written. What meets in one place is one row per piece, that is per shuffle partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the piece in the upper bits, the position in it in the lower 33
    staged = stage_table(rows.withColumn("_seq", F.monotonically_increasing_id()), "sorted-rows")
    piece, position = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND((1 << 33) - 1)
    placed = staged.withColumns({"_piece": piece, "_pos": position})
    offsets = _piece_offsets(placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")), ["_piece"])
    return placed.join(F.broadcast(offsets.select("_piece", "_before")), "_piece").select(
        *df.columns, (F.col("_before") + F.col("_pos")).alias(name)
    )
