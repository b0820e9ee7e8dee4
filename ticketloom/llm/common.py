"""What the operators of this folder share: reading, keys, Arrow batches, files in the shared folder.

Rows are addressed by ``(doc_id, text)``, so that repeated rows, null ids and ids
that stand before two different texts stay apart; in joins a 64-bit hash stands for the text.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ticketloom.session import materialize, scratch_path, shared_dir  # noqa: F401

#: Bytes of text in one Arrow batch: what a Python worker holds at a time, but for a longer single text.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_bytes(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def left_by_key(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Left join on null-safe keys; the keys of ``b`` are dropped."""
    b = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, on, "left").drop(*[f"_r_{k}" for k in keys])


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def low_hash(rows: Column, wanted: int) -> Column:
    """Whether the hash of ``doc_id`` is among the lowest, of about as many rows of ``rows`` as a draw of ``wanted`` needs.

    A draw by hash order then sees few rows of a group, not all: ``wanted`` and twelve deviations more.
    """
    share = F.least(F.lit(1.0), F.lit(wanted + 12 * wanted**0.5 + 20) / rows)
    return F.xxhash64("doc_id").cast("double") <= (share * 2 - 1) * float(1 << 63)


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 3; null ids are in fold 0, which is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def texts_of(column: pa.Array) -> list[bytes]:
    """The values of a binary column; null as empty."""
    return [b"" if v is None else v for v in column.to_pylist()]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class replaced_file:
    """Write a file under a passing name and move it into place at the end.

    A task that runs twice, at once or after a lost executor, leaves one whole file.
    """

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.passing = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.passing, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        if not self.out.closed:
            self.out.close()
        if kind is None:
            self.fs.move(self.passing, self.path)
        else:
            self.fs.delete_file(self.passing)


def running_offsets(sizes: DataFrame, keys: list[str], bucket: str, n: str, out: str) -> DataFrame:
    """Sum of ``n`` over the earlier buckets of a key; one row a bucket, so a small table."""
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))
