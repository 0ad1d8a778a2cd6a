"""Viewing logs in delimited text, and the stored interaction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.schema import INTEGER_FIELDS, INTERACTIONS, RAW_FIELDS, TEXT_SCHEMA
from viewtide.session import remove_staged
from viewtide.sources.order import staged_text_order, text_row_order

CORRUPT = "_corrupt"


def _reader(spark: SparkSession, skip_header: bool):
    # Quoting is off: a quote sign is an ordinary character and every comma separates.
    return spark.read.option("header", skip_header).option("quote", "").option("encoding", "UTF-8")


def session_duration(df: DataFrame, name: str = "duration") -> DataFrame:
    """Add the length of each session, ``stop_time - start_time``."""
    return df.withColumn(name, F.col("stop_time") - F.col("start_time"))


def _whole_number(field: str) -> Column:
    complaint = F.concat(F.lit(f"{field} is not a whole number: "), F.coalesce(field, F.lit("(missing)")))
    return F.coalesce(F.col(field).try_cast("bigint"), F.raise_error(complaint).cast("bigint"))


def _typed(rows: DataFrame, cast) -> DataFrame:
    # an empty text field is a key of its own; the reader gives null for it
    fields = [cast(f).alias(f) if f in INTEGER_FIELDS else F.coalesce(f, F.lit("")).alias(f) for f in RAW_FIELDS]
    return session_duration(rows.select("row_id", *fields))


def scan_interactions(spark: SparkSession, path: str, skip_header: bool = True) -> DataFrame:
    """Read a comma-separated log; a row of the wrong length or a non-number fails the job.

    ``skip_header`` drops the first line of every file, whatever it holds. A gzip file is one
    task, so a large log should come as many files. A filter over all five fields keeps the
    checks in every plan, whatever columns a query uses.
    """
    rows = _strict_rows(spark, path, skip_header)
    return _typed(text_row_order(rows).where(_all_fields_valid()), lambda f: F.col(f).cast("bigint"))


def _strict_rows(spark: SparkSession, path: str, skip_header: bool) -> DataFrame:
    return _reader(spark, skip_header).schema(TEXT_SCHEMA).option("mode", "FAILFAST").csv(path)


def _all_fields_valid() -> Column:
    """True, or the job fails."""
    whole = reduce(lambda a, b: a & b, [_whole_number(f).isNotNull() for f in INTEGER_FIELDS])
    every_field = F.length(F.concat_ws(",", *RAW_FIELDS)) >= 0  # true, but the reader must split the whole line
    return whole & every_field


def scan_with_quarantine(
    spark: SparkSession, path: str, skip_header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Read a log and split it into typed rows and the raw text of the malformed ones.

    Row ids count all lines, good or bad, so they keep the file order and may have gaps.
    """
    schema = T.StructType([*TEXT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        _reader(spark, skip_header)
        .schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    rows = text_row_order(raw)
    not_numbers = reduce(
        lambda a, b: a | b, [F.col(f).try_cast("bigint").isNull() for f in INTEGER_FIELDS]
    )
    bad = F.col(CORRUPT).isNotNull() | not_numbers
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in RAW_FIELDS]))
    good = _typed(rows.where(~bad), lambda f: F.col(f).try_cast("bigint"))
    return good, rows.where(bad).select("row_id", line.alias("line"))


def ingest_interactions(spark: SparkSession, source: str, target: str, skip_header: bool = True) -> DataFrame:
    """Load a text log once into the stored interaction table and read it back.

    All five fields are parsed and checked here, and the text is decoded once. Rows are written
    task by task as they were read, so row ids are narrow ranges per row group and a cap on them later
    prunes the scan without any sorting shuffle here.
    """
    rows, staged = staged_text_order(_strict_rows(spark, source, skip_header), _all_fields_valid())
    _typed(rows, lambda f: F.col(f).cast("bigint")).sortWithinPartitions("row_id").write.parquet(target)
    remove_staged(staged)
    return read_interactions(spark, target)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The stored interaction table under its declared schema."""
    return spark.read.schema(INTERACTIONS).parquet(path)


def write_log(df: DataFrame, path: str, header: bool = True) -> None:
    """Write the five raw fields as gzip text, files and lines in row-id order."""
    rows = df.repartitionByRange("row_id").sortWithinPartitions("row_id").select(*RAW_FIELDS)
    rows.write.option("header", header).option("compression", "gzip").option("quote", "").csv(path)
