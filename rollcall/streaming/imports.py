"""An addition: workbooks dropped into a folder are imported one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.state import State, Snapshots, import_batch
from rollcall.session import cut
from rollcall.sources import grid
from rollcall.sources.xlsx import first_sheet


def watch(spark: SparkSession, folder: str, checkpoint: str, take: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Feeds (path, modificationTime, length, content) of new files to take(batch, id), each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.xlsx").option("maxFilesPerTrigger", 100).load(folder)
    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


REFUSED = "path string, modified timestamp, reason string"


def parsed_sheets(batch: DataFrame) -> DataFrame:
    """(path, modified, row_number, cells, reason) of new files: workbooks are opened by the tasks that hold them; a file that is too large or no workbook is one row with a reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, modified, length, content in zip(pdf["path"], pdf["modificationTime"], pdf["length"], pdf["content"]):
                if length > grid.MAX_BYTES:
                    rows.append((path, modified, None, None, f"larger than {grid.MAX_BYTES} bytes: {length}"))
                    continue
                try:
                    rows += [(path, modified, line, cells, None) for line, cells in first_sheet(bytes(content))]
                except Exception as e:  # noqa: BLE001 - a file that can't be read must not stop the others
                    rows.append((path, modified, None, None, f"no workbook: {e}"))
            out = pd.DataFrame(rows, columns=["path", "modified", "row_number", "cells", "reason"])
            yield out.astype({"row_number": "Int32"})

    return batch.select("path", "modificationTime", "length", "content").mapInPandas(run, "path string, modified timestamp, row_number int, cells array<string>, reason string")


def importer(snapshots: Snapshots, tenant: str, mapping_of: Callable[[list[str]], dict[str, str]], as_of: str) -> Callable[[DataFrame, int], None]:
    """A taker that imports the workbooks of a micro-batch into the current snapshot and publishes one new version.

    A source is known by its path and time of change, so two files of one name are two sources and a repeated batch makes
    the same ids. Files that can't be taken are appended to `refused` beside the snapshots, with the reason.
    """

    def take(batch: DataFrame, _: int) -> None:
        spark = snapshots.spark
        lines = cut(parsed_sheets(batch))
        # One row per file, at most as many as a trigger takes.
        files = lines.groupBy("path", "modified").agg(F.max("reason").alias("reason"), F.countDistinct("row_number").alias("n")).orderBy("modified", "path").collect()
        refused, state, taken = [], snapshots.load(), 0
        for f in files:
            mine = lines.filter((F.col("path") == f["path"]) & (F.col("modified") == F.lit(f["modified"])) & F.col("reason").isNull()).select("row_number", "cells")
            reason = f["reason"]
            headers, rows = ([], mine) if reason else grid.from_rows(mine)
            if not reason and not headers:
                reason = "no header row"
            if not reason and not grid.within_limits(rows):
                reason = f"more than {grid.MAX_ROWS} rows"
            if reason:
                refused.append((f["path"], f["modified"], reason))
                continue
            mapping = grid.checked_mapping(headers, mapping_of(headers))
            name = f["path"].rsplit("/", 1)[-1]
            source_id = spark.range(1).select(grid.stable_id(F.lit(tenant), F.lit(f["path"]), F.lit(str(f["modified"])))).first()[0]
            source = spark.range(1).select(F.lit(source_id).alias("id"), F.lit(tenant).alias("organization_id"), F.lit(name).alias("name"), F.lit("local_upload").alias("source_type"), F.lit(None).cast("string").alias("external_file_id"),
                F.lit(None).cast("string").alias("imported_by"), F.lit(as_of).cast("timestamp").alias("imported_at"), F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)).alias("field_mapping"))
            records = grid.as_records(grid.parse_rows(headers, rows, mapping, name), source_id, tenant, as_of)
            fresh, _counters = import_batch(state, source, records, as_of)
            state, taken = State(**fresh.tables, version=state.version), taken + 1
        if refused:
            spark.createDataFrame(refused, REFUSED).write.mode("append").parquet(f"{snapshots.folder}/refused")
        if taken:
            snapshots.save(state)

    return take
