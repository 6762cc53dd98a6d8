"""CSV records with line breaks inside quotes, cut by many tasks at once.

A quote opens or closes a quoted field, and a doubled quote does both, so that a line begins inside quotes exactly if an
odd number of quotes stands before it in its file. Each split of a file counts its quotes; sums over the splits before
tell whether a split begins inside quotes, and running sums within a split tell it of each line. A record is a line that
begins outside quotes, with the lines after it that do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLIT = ("file", "block")


def _lines(spark: SparkSession, path: str | list[str], quote: str) -> DataFrame:
    """``(file, block, at, line, quotes)``: lines of a split are in order of ``at``."""
    text = F.col("value")
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.regexp_replace(text, "\r$", "").alias("line"),  # files may end their lines with both
            (F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))).alias("quotes"),
        )
    )


def _splits(lines: DataFrame) -> DataFrame:
    """One row for each split: whether it begins inside quotes, and the last record that begins in the splits before.

    A file whose quotes do not pair is an error here, before any line is put to another.
    """
    even, odd = F.col("before") % 2 == 0, F.col("before") % 2 == 1
    filled = ~F.col("blank")
    sums = lines.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.count_if(even & filled).alias("even"), F.count_if(odd & filled).alias("odd"))
    # Windows over the splits of one file: a row for some megabytes of text.
    file = Window.partitionBy("file")
    earlier = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before, whole = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.sum("quotes").over(file)
    sums = sums.select(*SPLIT, "even", "odd", before.alias("before"), whole.alias("whole"))
    sums = sums.withColumn("records", F.when(F.col("before") % 2 == 0, F.col("even")).otherwise(F.col("odd")))
    unpaired = F.raise_error(F.concat(F.lit("Quotes do not pair in "), F.col("file"))).cast("boolean")
    inside = F.when(F.col("whole") % 2 == 0, F.col("before") % 2 == 1).otherwise(unpaired)
    last = F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True).over(earlier)
    return sums.select(*SPLIT, inside.alias("inside"), last.alias("open"))


def csv_records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """``(file, block, number, record)``: each record of the CSV files at ``path`` as one text, without its line end.

    ``block`` and ``number`` give the split in which a record begins and its place there, from 1. Quotes must be those around
    fields, or doubled within them. Blank lines between records are left out.
    """
    order = Window.partitionBy(*SPLIT).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(spark, path, quote)
    lines = lines.withColumns({"before": F.coalesce(F.sum("quotes").over(upto), F.lit(0)), "blank": F.trim("line") == ""})
    outside = (F.col("before") + F.col("inside").cast("int")) % 2 == 0
    known = lines.join(_splits(lines), list(SPLIT)).withColumn("outside", outside).where(~(F.col("outside") & F.col("blank")))
    numbered = known.withColumn("number", F.sum(F.col("outside").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Lines before the first record of a split go on with the last record of the splits before.
    goes_on = F.col("number") == 0
    owner = F.when(goes_on, F.col("open.block")).otherwise(F.col("block"))
    number = F.when(goes_on, F.col("open.records")).otherwise(F.col("number"))
    joined = numbered.select("file", owner.alias("owner"), number.alias("number"), "block", "at", "line").groupBy("file", "owner", "number")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n")
    return joined.agg(text.alias("record")).select("file", F.col("owner").alias("block"), "number", "record")


def read_records(spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ",", quote: str = '"') -> DataFrame:
    """The columns of ``schema``, all texts, from files with a header. Another header, or a record with more or fewer fields, is an error."""
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "FAILFAST", "multiLine": "true"}
    fields = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    records = csv_records(spark, path, quote).select("*", fields.alias("fields"))
    return records.where(_is_row(schema)).select("fields.*")


def _is_row(schema: StructType) -> Column:
    """False for the first record of a file, which must name the columns."""
    same = F.lit(True)
    for name in schema.fieldNames():
        same = same & (F.trim(F.coalesce(F.col(f"fields.{name}"), F.lit(""))) == name)
    wrong = F.raise_error(F.concat(F.lit("The header does not name the columns in "), F.col("file"))).cast("boolean")
    return F.when((F.col("block") != 0) | (F.col("number") != 1), F.lit(True)).when(same, F.lit(False)).otherwise(wrong)
