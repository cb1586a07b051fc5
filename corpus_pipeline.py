"""A corpus from documents to training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm import lines, minhash, packing, suffixes, toxicity
from pricelode.llm.corpus import table
from pricelode.llm.steps import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OTHER = ("lang", "source")
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity is 0.5 or more; the model learns from the labelled ones among them.

    Null and empty texts are scored as empty; rows without an id, and rows that repeat, are judged like any other."""
    model = toxicity.fitted(
        docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.accepted(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines similar to an earlier line. Every document stays, also one that loses all its lines; null texts stay null."""
    found = lines.without_similar_lines(docs, carried=_OTHER)
    return found.select("doc_id", "text", "carried.*", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates; rows without an id all stay, and so do those without
    words. Of rows that are the same in every column and have an id, one stays."""
    found = written(minhash.near_duplicates(docs).where("doc_id IS NOT NULL").select("doc_id", "kept"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    docs, repeated = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti"), written(repeated)
    return docs.join(repeated, "doc_id", "left_anti").union(docs.join(repeated, "doc_id", "left_semi").distinct())


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that start earlier; characters that this cuts go whole. Every document stays; a null text
    becomes empty."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [suffixes.valid(kept) for kept in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), batch.column(2), batch.column(3),
                 pa.array([len(t) for t in text], pa.int64())], list(COLUMNS))

    return suffixes.without_repeats(docs, carried=_OTHER).select("doc_id", "kept", "carried.*").mapInArrow(decode, _SCHEMA)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a sequence of 4,096 tokens; a null text is its end mark alone."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: Boosted trees, suffix order and packing have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
