"""Rows as documents: every row gets a key of its own that sorts like doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.sources.order import sorted_order


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id (the key), text and row (a struct of all columns but text) of each row of ``docs``; and whether a doc_id repeats.

    The key is doc_id where no doc_id repeats, which a count of ids alone tells. Else it is the row's position by doc_id
    and, among equal ids, by text, nulls first: rows that repeat a doc_id are documents of their own in that order, equal
    rows included. Rows without doc_id keep a null key.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))
    named = rows.where("doc_id is not null")
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows, False
    # the last column spreads rows that are equal in id and text over the ranges
    placed = named.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = sorted_order(placed, ["doc_id", "text", "tie"], "place")
    return placed.select(F.col("place").alias("doc_id"), "text", "row").unionAll(rows.where("doc_id is null")), True


def columns_of(rows: DataFrame, names: list[str]) -> list:
    """The columns ``names`` of the table that ``rows`` (text, row) was made of."""
    return [(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in names]


#: Bounds of the bit table of ``split_by_ids``: 64-bit words; at most 16 MB with their numbers.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20


def split_by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id may be among ``ids`` (doc_id, a staged table), and those whose doc_id is not, for certain.

    A table of hash bits, about eight an id and of bounded size, is broadcast, so the second kind need not be shuffled for a
    join with ``ids``. Beyond the bound more rows are of the first kind; an exact join follows in any case.
    """
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (ids.count() // 8).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    table = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(table), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)
