"""Delimited lines with a given schema: the rows that fit it, and the lines that do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LINE = "_line"


def read(spark: SparkSession, path: str, schema: str | StructType, required: list[str] | None = None, header: bool = True, **options: str) -> DataFrame:
    """A row for each line that is not blank: the schema's columns, those of the folders, file (its name), reason (null for a row that fits) and line (the text).

    A line is rejected as `malformed` if it has too few or too many fields or a value that its column's type cannot hold, and as
    `missing x` if it fits but x, one of `required`, is empty. header: lines that are just the columns' names are passed over.
    Folders named column=value are columns, and a condition on them leaves the others' files unopened. options: those of
    from_csv, such as sep. Lines are parsed whole whichever columns are asked for; a record has one line.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{LINE} string"])
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    lines = lines.where(F.trim("value") != "").select(*folders, "value", F.col("_metadata.file_name").alias("file"))
    if header:
        lines = lines.where(F.trim("value") != options.get("sep", ",").join(fields.names))
    parsed = lines.withColumn("_row", F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE} | options))
    reason = F.when(F.col("_row").isNull() | F.col(f"_row.{LINE}").isNotNull(), F.lit("malformed"))
    for name in required or []:
        reason = reason.when(F.col(f"_row.{name}").isNull(), F.lit(f"missing {name}"))
    return parsed.select(*(F.col(f"_row.`{c}`").alias(c) for c in fields.names), *folders, "file", reason.alias("reason"), F.col("value").alias("line"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("file", "reason", "line")


def rejected(rows: DataFrame) -> DataFrame:
    """(file, reason, line) of the lines that were not taken."""
    return rows.where("reason is not null").select("file", "reason", "line")
