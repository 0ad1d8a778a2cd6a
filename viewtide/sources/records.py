"""Line records: one JSON object or Python literal per line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _literal_parser():
    # Nested, so that it travels with the job and executors need no copy of this package.
    def to_json(lines: pd.Series) -> pd.Series:
        import ast
        import json

        def convert(line):
            if line is None:
                return None
            try:
                record = ast.literal_eval(line.strip())
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None
            if not isinstance(record, dict):
                return None
            try:
                return json.dumps(record)
            except (TypeError, ValueError):
                return None

        return lines.map(convert, na_action="ignore")

    # Declared non-deterministic so that the optimizer never copies it into a filter, where
    # each line would be parsed a second time.
    return F.pandas_udf(to_json, T.StringType()).asNondeterministic()


def _parse(text: Column, schema: T.StructType) -> Column:
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "true"}
    return F.from_json(text, with_corrupt, options)


def _one_value(line: Column) -> Column:
    """Whether nothing but one JSON value is on the line; the parser itself stops after the first.

    The line becomes the first of two values of an object whose keys hold the line's hash, so no line can
    close that object early, or add to it, without the number or the names of its entries showing it.
    """
    key = F.xxhash64(line).cast("string")
    wrapped = F.concat(F.lit('{"'), key, F.lit('a":'), line, F.lit(',"'), key, F.lit('b":0}'))
    entries = F.from_json(wrapped, T.MapType(T.StringType(), T.StringType()), {"allowSingleQuotes": "true"})
    names = F.map_keys(entries)
    expected = F.array(F.concat(key, F.lit("a")), F.concat(key, F.lit("b")))
    return F.coalesce(names == expected, F.lit(False))


def load_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Read record lines into ``schema``; returns the records and the lines nobody could read.

    Lines are parsed as JSON (single quotes allowed) inside the JVM. Only the lines that are
    not one JSON value, say with ``None``, ``True``, a tuple or trailing text, reach Python, where they
    are read as literals, never evaluated as code; one that is not exactly one record fails. The text
    is scanned once per returned table.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.withColumn("_json", _parse(F.col("value"), schema))
    not_json = F.col("_json._corrupt").isNotNull() | F.col("_json").isNull() | ~_one_value(F.col("value"))
    literal = first.withColumn("_literal", _literal_parser()(F.when(not_json, F.col("value"))))
    second = literal.withColumn("_read", F.when(not_json, _parse(F.col("_literal"), schema)).otherwise(F.col("_json")))
    failed = F.col("_read").isNull() | F.col("_read._corrupt").isNotNull()
    records = second.where(~failed).select(*[F.col("_read").getField(f.name).alias(f.name) for f in schema.fields])
    return records, second.where(failed).select(F.col("value").alias("line"))
