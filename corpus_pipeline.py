"""A training corpus from ``documents``: toxic ones out, one of each group of near duplicates, secrets masked, sources mixed, windows packed.

Each stage gets what the one before it kept, written as Parquet and read again. The five stages and their order are given, so there is none for
personal data; ``op7_pii`` finds it in the same table.

Every stage takes rows with nulls in any column, empty and very long texts, ties, repeated rows, an empty table, and further columns of
any name, which it passes on; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import minhash, mixing, packing, secrets, toxicity
from sparkweave.session import unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window score is below the threshold.

    A null or empty text, or one without a word, has no window and stays, as does a row with a null id or source. Long texts are scored whole.
    Rows that repeat each other are all kept or all dropped, since a row's fate follows from its text alone. An empty table, or labels
    without both classes, leave the table as it is.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Null and empty texts and texts without a word are near duplicates of nothing and stay, as do rows with a null id. Long texts are compared
    whole. Rows that repeat an id are one document, with the greatest of their texts, and stay or go together. An empty table stays empty.
    """
    return minhash.without_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and ``n_chars`` counted anew where there was one.

    A null text stays null and an empty one empty. Long texts are scanned whole. Repeated rows are masked alike. An empty table stays empty.
    """
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in mixed order.

    A null source is a source of its own; null and long texts do not matter. Rows that repeat an id, or have none, stand together at the first of
    their places; ties are ordered by the id's hash, then the id. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per window; windows are numbered along the mixed stream, section after section.

    Null, empty and blank texts have no words and are in no window; a null id is kept as null in a window's list. Texts longer than a window are cut into
    full windows first. Repeated rows are pieces of their own; pieces of one length are taken in the order of the stream. An
    empty table gives no window.
    """
    place = unused(docs.columns, "_place")
    return packing.pack(mixing.with_places(docs, place), order=place)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_windows)]

#: A network's scores can't be said in SQL; tests run each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
