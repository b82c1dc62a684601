"""Other sources of grids: CSV files, captured sheet values, workbooks by path, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.text import like_escape
from rollcall.sources.grid import MAX_BYTES
from rollcall.sources.xlsx import first_sheet

DRIVE_BYTES, LISTED = 60 << 20, 500
CELLS = "path string, row_number int, cells array<string>"


def refused_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """(path, length, reason) of the files a read of the path leaves out for their size; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") > limit)
    return files.withColumn("reason", F.concat(F.lit(f"larger than {limit} bytes: "), F.col("length")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, cells) of CSV files; quoted cells may hold line breaks. Each file is split by a real CSV reader in one task, as line numbers need. Larger files are in refused_files()."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_BYTES).select("path", "content")

    def run(batches):  # noqa: ANN001, ANN202
        import csv
        import io

        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                text = bytes(content).decode("utf-8-sig", "replace")
                rows += [(p, i + 1, r) for i, r in enumerate(csv.reader(io.StringIO(text)))]
            yield pd.DataFrame(rows, columns=["path", "row_number", "cells"])

    return files.mapInPandas(run, CELLS)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, cells) of captured {"values": [[...]]} payloads; cells become text as stored numbers and truth values are."""
    raw = spark.read.schema("values array<array<string>>").option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("path"), F.posexplode("values").alias("at", "cells")).select("path", (F.col("at") + 1).alias("row_number"), F.transform("cells", lambda c: F.when(c.rlike("^-?\\d+\\.0$"), F.regexp_replace(c, "\\.0$", "")).otherwise(F.coalesce(c, F.lit("")))).alias("cells"))


def read_workbooks(spark: SparkSession, path: str, limit: int = DRIVE_BYTES) -> DataFrame:
    """(path, row_number, cells) of workbooks on any file system Spark reads; larger files are in refused_files()."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= limit).select("path", "content")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = [(p, line, cells) for p, content in zip(pdf["path"], pdf["content"]) for line, cells in first_sheet(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "row_number", "cells"])

    return files.mapInPandas(run, CELLS)


def list_workbooks(spark: SparkSession, folder: str, search: str = "", limit: int = LISTED) -> DataFrame:
    """(path, name, modified, length) of workbooks whose name contains the text, latest first."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")
    return found.filter(F.col("name").ilike(f"%{like_escape(search)}%")).orderBy(F.desc("modified"), "path").limit(limit)
