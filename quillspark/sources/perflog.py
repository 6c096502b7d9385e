"""Performance logs: header lines, each followed by indented ``key = value`` lines, in files that roll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import key_value


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, line_no, line of the files below ``path``; the present log is ordinal 0, ``name.3.log`` is 3."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    ordinal = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(file, '\\.([0-9]+)\\.log$', 1), '') AS int)"), F.lit(0))
    split = F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n"))
    return rows.select("file", ordinal.alias("ordinal"), split.alias("line_no", "line"))


def blocks(lines: DataFrame, header: str, log: str = "log") -> DataFrame:
    """log, block, key, value: the fields under each header line, oldest file first; of a key that repeats, the first value.

    A line that is not indented ends the block.
    """
    over = Window.partitionBy(log).orderBy(F.desc("ordinal"), "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("head", F.col("line").contains(header).cast("int")).withColumn("field", F.when(F.col("head") == 0, key_value(F.col("line"))))
    rows = rows.withColumn("block", F.sum("head").over(over)).withColumn("ends", (F.col("head") == 0) & F.col("field").isNull())
    within = Window.partitionBy(log, "block").orderBy(F.desc("ordinal"), "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ended", F.max(F.col("ends").cast("int")).over(within)).where((F.col("block") > 0) & (F.col("ended") == 0) & F.col("field").isNotNull())
    first = F.min_by("field.value", F.struct(-F.col("ordinal"), F.col("line_no")))
    return rows.groupBy(log, "block", F.col("field.key").alias("key")).agg(first.alias("value"))
