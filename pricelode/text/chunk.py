"""Overlapping character chunks of documents, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CHUNKS_PER_SECTION = 100


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def chunk_documents(
    docs: DataFrame, doc_id: str = "doc_id", content: str = "content", size: int = 400, overlap: int = 80,
) -> DataFrame:
    """``doc_id, chunk_index, chunk_id, text, metadata``: one row per non-blank chunk.

    Every other column of ``docs`` is carried as metadata. A text is cut into sections first:
    finding a position costs time in proportion to the length of the string it is sought in,
    which would make a long text quadratic.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    stride = size - overlap
    section = stride * CHUNKS_PER_SECTION
    carried = [c for c in docs.columns if c not in (doc_id, content)]
    pairs = [x for c in carried for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    text = docs.select(F.col(doc_id).alias("doc_id"), metadata.alias("metadata"), strip(F.col(content)).alias("_t")) \
        .where(F.length("_t") > 0)
    starts = F.sequence(F.lit(0), F.length("_t") - 1, F.lit(section))
    sections = F.transform(starts, lambda s: F.substr(F.col("_t"), s + 1, F.lit(section - stride + size)))

    def pieces(part: Column) -> Column:
        offsets = F.sequence(F.lit(0), F.least(F.length(part), F.lit(section)) - 1, F.lit(stride))
        return F.transform(offsets, lambda o: strip(F.substr(part, o + 1, F.lit(size))))

    parts = text.select("doc_id", "metadata", sections.alias("_s"))
    chunks = F.filter(F.flatten(F.transform("_s", pieces)), lambda c: F.length(c) > 0)
    rows = parts.select("doc_id", "metadata", F.posexplode(chunks).alias("chunk_index", "text"))
    digest = F.sha2(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    return rows.select("doc_id", "chunk_index", F.substring(digest, 1, 12).alias("chunk_id"), "text", "metadata")
