"""Token counts by an exact length histogram.

Documents are counted by encoded length; suffix sums over the histogram then answer the
totals, quantiles and truncated totals of every context limit, without the documents.
The histogram has a row per distinct length; its running sums are taken in blocks of
lengths, then over block totals, so no task needs all of it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTHS_A_BLOCK = 1024


def encoder(data: bytes):
    """A tokenizer from the bytes of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) per row: length of the whole text's encoding; 0 for null and empty.

    Strings that look like special tokens are ordinary text. The driver reads the
    vocabulary file (a few MB) and sends it to the executors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            counts = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct n_tokens (`length`): counts and what every limit there asks for.

    n_docs and n_tokens of that length; docs_at_most, docs_at_least, tokens_at_least;
    truncated_tokens, the total when every document is cut to `length` tokens.
    """
    counts = written(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("part", F.floor(F.col("length") / LENGTHS_A_BLOCK))
    sums = counts.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    every = Window.partitionBy(F.lit(0))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "part",
        *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"),
        *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"),
    )
    here = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(sums, "part").select(
        "length", "n_docs", "n_tokens", "d_all", "t_all",
        (F.col("d_later") + F.sum("n_docs").over(here)).alias("docs_at_least"),
        (F.col("t_later") + F.sum("n_tokens").over(here)).alias("tokens_at_least"),
    )
    return found.select(
        "length", "n_docs", "n_tokens",
        (F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that holds at least that share of the documents;
    null where there are none."""
    asked = found.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    total = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    rows = found.select("length", "docs_at_most", total.alias("total"), F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    least = rows.where(F.col("docs_at_most") >= F.col("share") * F.col("total")).groupBy("share").agg(F.min("length").alias("length"))
    return asked.join(least, "share", "left")


def truncated_total(found: DataFrame, limit: int) -> int:
    """Tokens left of all documents cut to any limit: from the suffix sums of the first
    length at or beyond it."""
    every = F.col("truncated_tokens") + F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")
    at = F.struct("length", (every - F.col("tokens_at_least") + limit * F.col("docs_at_least")).alias("cut"))
    total, cut = found.agg(F.max(every), F.min(F.when(F.col("length") >= limit, at))["cut"]).first()
    return int((total if cut is None else cut) or 0)


def token_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`histogram` of the encoded lengths of `docs` (doc_id, text), with `percent`: the whole
    percents of all documents that are at most so long. The quantile of a percent is the
    first length that reaches it.

    Nulls and empty texts count as length 0; an empty table gives no rows; other columns
    are ignored; repeated rows count each time.
    """
    found = histogram(encoded_lengths(docs, vocabulary))
    return found.withColumn("percent", F.expr("docs_at_most * 100 div (docs_at_most + docs_at_least - n_docs)").cast("long"))
