"""The corpus pipeline: quality, near-duplicates, private data, mixing, encoding. Counted as part of tracewell.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, mixing, neardup, pii, quality
from tracewell.llm.shared import WRITTEN, cut, drop_tables, short_batches, table


def written(rows: DataFrame) -> DataFrame:
    """Rows that Python makes, in the shared folder: written here, as Arrow batches are short only while `short_batches` holds."""
    with short_batches(rows.sparkSession):
        return cut(rows)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents and their labels, does not reject."""
    return written(quality.keep_good(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of 0.8 or more."""
    return neardup.drop_near_duplicates(docs, percent=80)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of private data, by the session's key."""
    return pii.with_pseudonyms(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate says."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, one row for each copy of a document."""
    return written(bpe.encoded(docs, keep_ids=True))


STAGES = [("quality", keep_good), ("near_duplicates", drop_copies), ("pii", hide_private), ("mixing", mix_sources), ("bpe", encode)]
#: Stages whose rows are in the shared folder already.
WRITERS = {keep_good, encode}

#: No stage but the mix can be put in SQL (a trained network, Feistel networks, byte pairs). tests/llm hold the near-duplicates,
#: the pseudonyms, the mix and the encoding against brute-force versions, and the classifier against labels held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole table documents: doc_id, ids and their digests of what is left.

    Each stage's rows are written to the shared folder before the next reads them, and then what the stages had written
    there before is deleted. Null and empty texts have no words: they are kept by the classifier and the deduplication,
    and the mix gives them their source's copies. Rows without a doc_id stay apart from all others, of rows that share an
    id each stands for itself, long texts are worked on whole, other columns are carried to the last stage whatever
    their names, and an empty table gives an empty result.
    """
    docs, first = table(spark, sf_dir, "documents"), len(WRITTEN)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage in WRITERS else cut(docs)
        drop_tables(spark, keep=first, last=1)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
