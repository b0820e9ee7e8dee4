"""From documents to token files, in five stages.

Each stage takes what the one before kept, as written Parquet.  All but the last return the columns of
``documents``: rows without a language go, one row of each near-duplicate group stays, documents that hold a
window of the benchmark go, sources are brought to their target shares (documents come once for each
round of the mix that takes words of them, cut to these words), and the rest is encoded
into wavelet files, of which the last stage returns one row per document.

No SQL twin: language, the mix's draws and the tokenizer are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.llm import decontaminate, language_id, mixing, simhash, wavelet
from ticketloom.llm.common import materialize, table
from ticketloom.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.Decontamination(docs, table(spark, sf_dir, "benchmark")).clean()


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wavelet.token_output(docs, TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
