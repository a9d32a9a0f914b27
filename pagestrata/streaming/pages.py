"""The document plan over streams.

Every rule's context is one page, so a stream of whole pages needs no state: each
micro-batch is analyzed as a batch is, and written with the batch's number, so that a
batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import match_text
from ..operators import furniture
from ..plans.document import analyzed
from ..schema import RAW_BLOCKS


def nested_pages(raw: DataFrame) -> DataFrame:
    """Raw blocks as a row per page (document_path, page_number, raw: array), in order."""
    row = F.struct("raw_ordinal", F.struct(*RAW_BLOCKS.names).alias("block"))
    return raw.groupBy("document_path", "page_number").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["block"]).alias("raw"))


def flat(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("raw").alias("block")).select("block.*")


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of nested pages from a folder of Parquet files."""
    schema = nested_pages(spark.createDataFrame([], RAW_BLOCKS)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def furniture_stream(pages: DataFrame) -> DataFrame:
    """Stateless and append-only: the furniture flags of each block of the stream."""
    rows = flat(pages).withColumn("ws", match_text(F.col("text"))).where("ws <> ''")
    flags = furniture.flags(F.col("ws"), F.col("bbox"), F.col("page_height"))
    return rows.select("document_path", "page_number", "raw_ordinal", "ws", *(v.alias(k) for k, v in flags.items()))


def analyzed_stream(pages: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes the blocks of each micro-batch of pages under folder/batch=N until it is
    stopped; runs over what is there when called with `availableNow` sources."""

    def batch(found: DataFrame, number: int) -> None:
        blocks = analyzed(flat(found))
        blocks.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if then:
            then(blocks, number)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
