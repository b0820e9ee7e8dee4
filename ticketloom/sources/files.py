"""Readers and writers for the pipeline's files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom import schemas
from ticketloom.operators.cells import VectorIndex
from ticketloom.operators.lexical import TextIndex
from ticketloom.operators.threads import parse_inbound
from ticketloom.sources.quoted import read_quoted_csv


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input of few, unsplittable files; large inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_tweets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Messages from a CSV of strings; texts may span lines, and large files are read in splits."""
    raw = read_quoted_csv(spark, path, schemas.TWEETS_CSV)
    return raw.withColumn("inbound", parse_inbound("inbound"))


def convert_tweets(spark: SparkSession, csv_path: str, parquet_path: str, mode: str = "error") -> None:
    scan_tweets_csv(spark, csv_path).write.mode(mode).parquet(parquet_path)


def scan_corpus_jsonl(spark: SparkSession, path: str, max_passages: int | None = None) -> DataFrame:
    """Passages, one JSON object per line; blank lines are skipped, a malformed line is an error."""
    df = spark.read.schema(schemas.CORPUS).option("mode", "FAILFAST").json(path).filter(F.col("passage_id").isNotNull())
    return df.orderBy("passage_id").limit(max_passages) if max_passages else df


def sink_threads(threads: DataFrame, path: str, mode: str = "error") -> None:
    threads.write.mode(mode).partitionBy("brand").json(path)


def sink_corpus(corpus: DataFrame, path: str, mode: str = "error") -> None:
    corpus.write.mode(mode).partitionBy("brand").json(path)


def sink_openings_csv(openings: DataFrame, path: str, mode: str = "error") -> None:
    openings.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sink_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    params.coalesce(1).write.mode(mode).json(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Calibration values; a missing temperature is 1, missing thresholds stay null."""
    return spark.read.schema(schemas.PARAMS).json(path).withColumn(
        "temperature", F.coalesce("temperature", F.lit(1.0))
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def reuse_or_build(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Read the table if it is there, else build and write it."""
    if force or not table_exists(spark, path):
        build().write.mode("overwrite" if force else "error").parquet(path)
    return spark.read.parquet(path)


def sink_index(
    path: str, corpus: DataFrame, vectors: DataFrame, text: TextIndex | None = None, mode: str = "error",
    cells: VectorIndex | None = None,
) -> None:
    """Persist passages, vectors, the text index and the approximate vector index as Parquet tables."""
    corpus.write.mode(mode).parquet(f"{path}/corpus")
    vectors.write.mode(mode).parquet(f"{path}/vectors")
    if text is not None:
        text.store(f"{path}/text", mode)
    if cells is not None:
        cells.store(f"{path}/cells", mode)


def load_index(spark: SparkSession, path: str) -> dict:
    """``corpus`` and ``vectors`` (required) and ``text`` and ``cells``, indexes to search, if they were stored."""
    for name in ("vectors", "corpus"):
        if not table_exists(spark, f"{path}/{name}"):
            raise FileNotFoundError(f"{path}/{name}")
    has_text = table_exists(spark, f"{path}/text/bounds")
    has_cells = table_exists(spark, f"{path}/cells/meta")
    return {
        "corpus": spark.read.parquet(f"{path}/corpus"),
        "vectors": spark.read.parquet(f"{path}/vectors"),
        "text": TextIndex.load(spark, f"{path}/text") if has_text else None,
        "cells": VectorIndex.load(spark, f"{path}/cells") if has_cells else None,
    }


def dataset_profile(df: DataFrame, order: str, head: int = 3) -> DataFrame:
    """One row: row count, column list, the first few rows as JSON."""
    first = (
        df.orderBy(order)
        .limit(head)
        .select(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j")).alias("x"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), "\n").alias("head"))
    )
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(",".join(df.columns)).alias("columns"),
        first.scalar().alias("sample_head"),
    )
