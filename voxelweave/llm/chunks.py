"""Documents in chunks of bounded size, and messages between chunks and keys.

A chunk is a set of documents that one task holds. Chunks send what they know of keys
(hashes of windows, words, word pairs), each key once, to the key's bucket; buckets
answer each chunk. A key that a third of all documents have thus costs its bucket one entry
a chunk, not one a document. All passes over the texts read the same exchange, which Spark reuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import text_bytes

CHUNK_BYTES, MOST_BYTES = 8 << 20, 32 << 20


def chunked(docs: DataFrame, columns: list, size: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """columns and chunk, dealt by chunk; a row's chunk follows from its doc_id and text, so rows that are equal in both share one."""
    size = text_bytes(docs) if size is None else size
    # small tables still use all cores; with the table chunks grow, as each sends messages to more and more buckets
    n = max(-(-size // grown(size, chunk_bytes, MOST_BYTES)), min(2 * docs.sparkSession.sparkContext.defaultParallelism, size >> 16), 1)
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n)).cast("int")
    return docs.select(*columns, chunk.alias("chunk")).repartition(n, "chunk")


def grown(size: int, least: int, most: int) -> int:
    """A thousandth of the size, within limits."""
    return min(most, max(least, size >> 10))


def log2_up(n: int) -> int:
    return max(0, int(n - 1).bit_length())
