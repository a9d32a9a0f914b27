"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a quota of words: its target, rounded so that the quotas add up to the
words of all documents (largest remainders). Its documents are shuffled by digest and laid
end to end on a ring; the quota is the ring's words from 0 on, as often round as it takes,
cut into slots of equally many words (one word apart at most). So a source gives its quota
exactly, however small, and no document more often than the ring goes round.

The slots of all sources, one after another, are places 0 to N - 1 of the cumulative
weights. Slot t of the mix takes place t * g mod N, where g is prime to N and next to
N / 1.618...: a golden-ratio point on the lattice of places, so that each place is met once
and any run of slots holds each source in nearly its share. The slot with rank r of its
source takes block r of the source's ring.

Ranks and offsets are prefix sums in two levels (bounded chunks, then chunk totals), so
that no task holds a whole source, however large. Only the sources' own sums (a row each)
are ranked in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5, 2, 1)
MOST = 3
GOLDEN = 0.6180339887498949
#: Words of a slot at most, and slots of a source at least (if it has as many words).
BLOCK = 8192
PARTS = 1024
CHUNK = 65536
BUCKET_ROWS = 512
STRIPS = 1024


def n_words(text: Column) -> Column:
    """Number of runs of code points other than U+0020 and U+0009-U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Mix:
    """sizes: a row per document (uid, doc_id, source, sid, size); sources: a row per source
    (sid, source, source_size, target, quota, n_slots, lo); slots: (slot, sid, rank);
    pieces: (uid, sid, rank, words), the parts of documents in each block of the ring."""

    sizes: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: its size, target, quota and slots (rows as many as sources).

    Sources in code point order, null last, have the weights in turn. Targets sum to the
    total size; none is above `most` times its source's size: the level L that fills
    min(most * size, L * weight) up to the total is the largest of the levels that the
    sources in order of most * size / weight would need. Quotas are targets rounded down,
    and up for the largest remainders (ties: the first source) until the total is met.
    lo is the source's first place among the slots of all.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    found = found.withColumn("sid", F.row_number().over(named) - 1)
    turn = F.array(*map(F.lit, weights))
    found = found.withColumn("weight", F.element_at(turn, (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    found = found.withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy(F.lit(0))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = found.withColumn("level", level).withColumn("total", total)
    found = found.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
    # a remainder of rounding is no remainder: targets that are whole numbers stay
    down = F.floor(F.col("target") + 1e-6)
    found = found.withColumn("down", down).withColumn("open", F.col("total") - F.sum("down").over(every))
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("target") - F.col("down"), 6)), "sid"))
    found = found.withColumn("quota", F.least(F.col("down") + (nth <= F.col("open")).cast("long"), F.col("source_size") * most))
    n_slots = F.greatest(F.ceil(F.col("quota") / BLOCK), F.least("quota", F.lit(PARTS))).cast("long")
    found = found.withColumn("n_slots", n_slots)
    lo = F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))
    return found.select("sid", "source", "source_size", "rows", "target", "quota", "n_slots", F.coalesce(lo, F.lit(0)).alias("lo"))


def golden_step(n: int) -> int:
    """The step g of the lattice of n places: prime to n and the nearest such to n / 1.618..."""
    near = round(n * GOLDEN)
    return next((g for d in range(n + 1) for g in (near + d, near - d) if 0 < g < n and gcd(g, n) == 1), 1)


def _rank_of(word: Column) -> Column:
    """The block of a source's ring that holds a word of its quota: the first quota % n_slots
    blocks have a word more than the others."""
    short, longer = F.floor(F.col("quota") / F.col("n_slots")), F.col("quota") % F.col("n_slots")
    ahead = longer * (short + 1)
    return F.when(word < ahead, F.floor(word / (short + 1))).otherwise(longer + F.floor((word - ahead) / F.greatest(short, F.lit(1))))


def _first_of(rank: Column) -> Column:
    short, longer = F.floor(F.col("quota") / F.col("n_slots")), F.col("quota") % F.col("n_slots")
    return rank * short + F.least(rank, longer)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Mix:
    """The schedule that mixes `docs` (doc_id, text, source); see `Mix`."""
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid"))
    sizes = written(sizes, "sizes")
    sources = written(targets(sizes, weights, most), "sources")
    n_slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

    # places to sources: strips of the places make the range join an equi-join
    step, wide = golden_step(n_slots), max(1, -(-n_slots // STRIPS))
    # t * step mod n without a product beyond 64 bits: t in two halves
    high, low = F.floor(F.col("slot") / CHUNK), F.col("slot") % CHUNK
    place = (high % max(1, n_slots) * (step * CHUNK % max(1, n_slots)) + low * step) % max(1, n_slots)
    if n_slots >= 1 << 31:
        place = (high.cast("decimal(19,0)") * (step * CHUNK % n_slots) + low * step).cast("decimal(38,0)") % n_slots
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("place", place.cast("long"))
    ends = sources.where("n_slots > 0").withColumn("hi", F.col("lo") + F.col("n_slots"))
    strip = F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))
    ranges = ends.select("sid", "lo", "hi", F.explode(strip).alias("strip"))
    slots = slots.withColumn("strip", F.floor(F.col("place") / wide)).join(ranges, "strip").where("place >= lo and place < hi")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    totals = slots.groupBy("sid", "chunk").count()
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    slots = slots.join(totals, ["sid", "chunk"]).select("slot", "sid", rank.alias("rank"))

    # documents to places of the ring: shuffled by digest, offsets within bounded buckets
    known = sources.select("sid", "source_size", "rows", "quota", "n_slots", F.col("source").alias("s"))
    laid = sizes.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    laid = laid.withColumn("digest", digest).withColumn(
        "bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / float(1 << 32))
    )
    sums = laid.groupBy("sid", "bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("digest", "doc_id", "size", "uid")
    first = F.col("before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = laid.join(sums, ["sid", "bucket"]).withColumn("first", first)
    # once for every time that the ring goes round before the quota ends
    rounds = F.floor((F.col("quota") - 1 - F.col("first")) / F.col("source_size"))
    laid = laid.where("first < quota").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds)))
    laid = laid.withColumn("from", F.col("round") * F.col("source_size") + F.col("first")).withColumn("to", F.least("quota", F.col("from") + F.col("size")))
    spread = F.sequence(_rank_of(F.col("from")), _rank_of(F.col("to") - 1))
    pieces = laid.select("uid", "sid", "from", "to", "quota", "n_slots", F.explode(spread).alias("rank"))
    words = F.least("to", _first_of(F.col("rank") + 1)) - F.greatest("from", _first_of(F.col("rank")))
    return Mix(sizes, sources, slots, pieces.select("uid", "sid", "rank", words.alias("words")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target (of its source) and taken.

    taken: words of the document that the mix takes, repeats counted; never above `most`
    times its size, and of a source in all its target rounded to a whole number. Null and
    empty texts have size 0 and are not taken. Null sources are a source of their own, last
    in order. Repeated doc_ids keep a row each; reruns agree, but for which of two rows
    equal in doc_id and size is the one that a ring ends in. An empty table, or one without
    words, takes nothing.
    """
    mix = mixture(docs, weights, most)
    taken = mix.pieces.join(mix.slots.select("sid", "rank"), ["sid", "rank"]).groupBy("uid").agg(F.sum("words").alias("taken"))
    by_source = mix.sources.select(F.col("source").alias("s"), "source_size", F.col("target").cast("double"))
    found = mix.sizes.join(by_source, F.col("source").eqNullSafe(F.col("s"))).join(taken, "uid", "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def with_shares(docs: DataFrame) -> DataFrame:
    """`docs` with size, source_size, target and taken as in `mixed` (names that clash are
    replaced).

    Rows are met again by doc_id; where doc_ids repeat, by doc_id, source, size and number,
    so that each row keeps a share of its own.
    """
    added = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*added)
    shares = written(mixed(docs).select("doc_id", "source", *added), "shares")
    if shares.groupBy("doc_id").count().where("count > 1").isEmpty():
        same = ["doc_id"]
    else:
        same = ["doc_id", "source", "size", "__n"]
        window = Window.partitionBy(*same[:3])
        shares = shares.withColumn("__n", F.row_number().over(window.orderBy("taken")))
        docs = docs.withColumn("size", n_words(F.col("text"))).withColumn("__n", F.row_number().over(window.orderBy("text")))
    named = shares.select(*(F.col(c).alias(f"__{c}") for c in same), *(c for c in added if c not in same))
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    found = docs.join(named, met)
    return found.drop("__n", *(f"__{c}" for c in same))
