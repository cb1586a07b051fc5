"""Documents to answers: chunk, embed, search."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.plans.durable import checkpointed
from pricelode.text.chunk import chunk_documents
from pricelode.text.embed import fit_tfidf, tfidf_embed
from pricelode.text.index import save_index
from pricelode.text.search import passages, top_k

DOCUMENT = "doc_id string, title string, topic string, content string"


def text_document(spark: SparkSession, text: str, title: str, topic: str = "") -> DataFrame:
    """A one-row document table from a string."""
    return spark.createDataFrame([(text, title, topic)], "content string, title string, topic string").select(
        F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "title", "topic", "content")


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """One document per text file; an absent folder has none."""
    try:
        files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    except AnalysisException:
        return spark.createDataFrame([], DOCUMENT)
    path = F.col("_metadata.file_path")
    return files.select(
        F.substring(F.sha2(path, 256), 1, 12).alias("doc_id"), F.col("_metadata.file_name").alias("title"),
        F.lit("").alias("topic"), F.col("value").alias("content"))


def build(docs: DataFrame, path: str) -> tuple[DataFrame, PipelineModel]:
    """Chunk and embed the documents once; searches then read the stored vectors only."""
    chunks = checkpointed(chunk_documents(docs))  # cut once: read for the fit, and again with the model
    if chunks.isEmpty():
        raise ValueError("there are no chunks to index")
    model = fit_tfidf(chunks)
    return save_index(tfidf_embed(chunks, model), path), model


def retrieve(
    index: DataFrame, model: PipelineModel, queries: DataFrame, k: int = 4, **search_options,
) -> DataFrame:
    """The ``k`` best passages of the index for each row (query_id, text) of ``queries``."""
    named = index.withColumns({"doc": F.col("doc_id").cast("string"), "chunk": F.col("chunk_index")})
    hits = top_k(named, tfidf_embed(queries, model), k, keys=("doc", "chunk"), **search_options)
    return passages(hits, index)
