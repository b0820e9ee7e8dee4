"""Quoted CSV whose records may span lines, read in splits.

Spark's multi-line reader takes a file in one task, since a line break may lie in
quotes.  Here the text source splits the file by byte ranges, and the parity of quotes tells
records apart: a line starts a record if an even number of quotes comes before it in its file.

1. Quotes are counted per byte range; a running sum over the ranges, a row each, gives the parity at its start.
2. Within a range the parity runs from line to line as the lines are read.  Lines that are records as they stand are parsed where they are.
3. Only lines of longer records are shuffled: numbered over the ranges, gathered and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ticketloom.operators.running import running_count
from ticketloom.session import materialize


def _parity(batches):
    """Add ``inside``: whether the quotes before a line in its range are odd, and ``head`` on a file's first line."""
    last, odd = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block, quotes = b.column("file"), b.column("block").to_numpy(), b.column("quotes").to_numpy()
        code = pc.dictionary_encode(file).indices.to_numpy()
        new = np.concatenate(([(file[0].as_py(), int(block[0])) != last], (block[1:] != block[:-1]) | (code[1:] != code[:-1])))
        before = np.cumsum(quotes) - quotes
        starts = np.flatnonzero(new)
        carried = np.zeros(len(block), np.int64)
        if len(starts):
            which = np.searchsorted(starts, np.arange(len(block)), side="right") - 1
            carried = np.where(which >= 0, -before[starts[np.maximum(which, 0)]], odd)
        else:
            carried += odd
        inside = ((before + carried) % 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("file", "block", "id", "line", "quotes")), pa.array(inside), pa.array(new & (block == 0))],
            ["file", "block", "id", "line", "quotes", "inside", "head"],
        )
        last, odd = (file[-1].as_py(), int(block[-1])), int(inside[-1] + quotes[-1]) % 2


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of UTF-8 CSV files with a header line each, quotes doubled inside quotes; a malformed record is an error.

    Quotes may stand only where they quote a value, as every writer leaves them that doubles them.
    Line breaks in quotes stay as they are.  Empty lines between records are skipped; an empty file, or one of a header only, has no rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"),
    )
    ranges = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("at_start", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).drop("odd"), "ranges")
    marked = lines.mapInArrow(_parity, "file string, block long, id long, line string, quotes long, inside int, head boolean")
    marked = marked.join(ranges, ["file", "block"]).withColumn("starts", (F.col("inside") + F.col("at_start")) % 2 == 0)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    single = marked.filter(alone & ~F.col("head")).select(F.col("line").alias("record"))
    opens = F.when(F.col("starts"), 1).otherwise(0)
    longer = materialize(marked.filter(~alone).select("file", "block", "id", "line", "head", opens.alias("opens")), "long-records")
    numbered = running_count(longer, ["file"], ["id"], F.col("block"), "number", F.col("opens"))
    gathered = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "id", "line"))).alias("lines"), F.max("head").alias("head")
    )
    joined = gathered.filter(~F.col("head")).select(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    records = single.union(joined).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record != ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true", "mode": "FAILFAST"})
    # as a generator: a parser that is asked for some columns only would take whole records for malformed
    return records.select(F.inline(F.array(parsed)))
