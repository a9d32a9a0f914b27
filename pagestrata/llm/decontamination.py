"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words at the marked positions of a mask, so that words at other
positions may differ. The two masks are lossless: of any `WINDOW` aligned word pairs of
which at most `WINDOW - LEAST` differ, some placement of one of them meets equal words
only (`lossless` checks it). Test and training seeds are joined, and around each hit the
words are compared on its diagonal.

Items shorter than a window may lose as large a share of their words; they are looked up by
the runs of `pieces`, of which one at least is met unchanged.

DataFrame functions only: each word is hashed once, positions are exploded with the hashes
of the words after them and combined to seeds inside generated code, and the words around a
position travel only with positions that hit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keyed, written

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW, LEAST = 20, 17
MASKS = ("111101011", "11011111")
SPAN = max(map(len, MASKS))
#: Seeds up to this many (about 50 MB) are broadcast; more are joined by shuffling, after a
#: bitmap has thinned the positions: so many bits a seed, as long as it has at most 8 MB.
BROADCAST_SEEDS = 1_000_000
BITS_A_SEED, MOST_BITS = 16, 26


def lossless(masks: tuple[str, ...] = MASKS, window: int = WINDOW, least: int = LEAST) -> bool:
    """Whether every window with at most window - least unequal pairs has a seed hit."""
    placed = [{o + k for k, c in enumerate(m) if c == "1"} for m in masks for o in range(window - len(m) + 1)]
    return all(any(not seed & set(bad) for seed in placed) for bad in combinations(range(window), window - least))


def least_equal(n: int) -> int:
    """How many of the n aligned words of a short item must be equal by the tolerant rule."""
    return -(-n * LEAST // WINDOW)


def pieces(n: int) -> tuple[int, list[int]]:
    """Length and places of runs of a short item: one more than the words that may differ.

    No run shares a word with another, so that some run has no differing word.
    """
    runs = n - least_equal(n) + 1
    return n // runs, [k * (n // runs) for k in range(runs)]


def words_of(text: Column) -> Column:
    """Words of a text in lower case (sharp s, in capitals SS, as ss; one form of sigma)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.replace(F.replace(low, F.lit("\u00df"), F.lit("ss")), F.lit("\u03c2"), F.lit("\u03c3"))
    return F.array_remove(F.split(low, SPACE), "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _positions(rows: DataFrame, runs: list[int], seeds_of: tuple[str, ...] = MASKS) -> DataFrame:
    """Rows (every column of `rows`, pos, seed): per position of `words` a seed of each mask
    and of each run of the given lengths. Beyond the end of a text seeds have fewer words."""
    span = max([*map(len, seeds_of), *runs])
    rows = rows.withColumn("h", _hashed(F.col("words")))
    tails = [F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"h{k}") for k in range(1, span)]
    rows = rows.select(*(c for c in rows.columns if c != "h"), F.posexplode(F.arrays_zip(F.col("h").alias("h0"), *tails)).alias("pos", "at"))
    word = [F.col("at")[f"h{k}"] for k in range(span)]
    seeds = [F.xxhash64(F.lit(m), *(word[k] for k, c in enumerate(mask) if c == "1")) for m, mask in enumerate(seeds_of)]
    seeds += [F.xxhash64(F.lit(100 + n), *word[:n]) for n in runs]
    return rows.withColumn("seed", F.explode(F.array(*seeds))).drop("at")


def _item_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """(seed, item_id, j, n): seeds of items, those of short ones from their pieces."""
    parts = [_positions(items.where(F.col("n") >= WINDOW), []).select("seed", "item_id", F.col("pos").alias("j"), "n")]
    for n in short:
        size, places = pieces(n)
        for j in places:
            run = F.xxhash64(F.lit(100 + size), *(F.xxhash64(F.get("words", F.lit(j + k))) for k in range(size)))
            parts.append(items.where(F.col("n") == n).select(run.alias("seed"), "item_id", F.lit(j).alias("j"), "n"))
    return reduce(DataFrame.unionByName, parts)


def _around(words: Column, at: Column) -> Column:
    """The words within WINDOW - 1 of a position; null beyond either end."""
    return F.transform(F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW - 1)), lambda k: F.get(words, at + k))


def _best(one: Column, other: Column, n: Column) -> Column:
    """The most equal pairs of a window over two `_around`, or for a short item of n words
    all its equal pairs; 0 if they are too few."""
    same = F.zip_with(one, other, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("long"))
    # bit 2 * WINDOW - 2 is the first pair, bit WINDOW - 1 the pair at the position itself
    flags = F.aggregate(same, F.lit(0).cast("long"), lambda bits, e: bits * 2 + e)

    def judged(bits: Column) -> Column:
        full = F.lit((1 << WINDOW) - 1).cast("long")
        most = F.greatest(*(F.bit_count(F.shiftright(bits, k).bitwiseAND(full)) for k in range(WINDOW)))
        # all of a short item lies around the position, and nothing else of the item does
        equal = F.bit_count(bits)
        enough = F.when(n >= WINDOW, most >= LEAST).otherwise(equal * WINDOW >= n * LEAST)
        return F.when(enough, F.when(n >= WINDOW, most).otherwise(equal)).otherwise(0)

    # evaluates the flags once
    return F.get(F.transform(F.array(flags), judged), F.lit(0))


def _flags(seeds: DataFrame, n_seeds: int) -> tuple[DataFrame, int]:
    """A row with an array of longs, 2**bits flags: each seed sets two."""
    bits = 10
    while bits < MOST_BITS and (1 << bits) < BITS_A_SEED * n_seeds:
        bits += 1
    slots = seeds.select(F.explode(F.array(*_slots(bits))).alias("slot"))
    flag = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.bit_or(flag).alias("x")).collect()
    words = [0] * (1 << (bits - 6))
    for r in rows:
        words[r["at"]] = r["x"]
    return seeds.sparkSession.createDataFrame([(words,)], "words array<long>"), bits


def _slots(bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 64 - bits)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_match): a row per pair of a document and an item that overlap.

    Words are runs of code points other than U+0020 and U+0009-U+000D, in lower case. An item
    of `WINDOW` words or more overlaps a text when on some alignment at least `LEAST` of
    `WINDOW` consecutive positions hold equal words; n_match is the most in any window. An
    item of 1 to WINDOW - 1 words overlaps when on some alignment `LEAST` / `WINDOW` of its
    words at least are equal (`least_equal`), and n_match is the most that are; items of up
    to 6 words so overlap whole only. Empty and null items overlap nothing, as do null and
    empty texts. Pairs are distinct, so repeated rows count once, and texts that share a
    doc_id (null too) count together. Very long texts are read in full; other columns of both
    tables are ignored; an empty table gives no rows.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= 1)
    items = written(items.withColumn("n", F.size("words")), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    seeds = written(_item_seeds(items, short).distinct(), "seeds")
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    found = _positions(texts, sorted({pieces(n)[0] for n in short}))
    around = _around(F.col("words"), F.col("pos"))
    if (n_seeds := seeds.count()) <= BROADCAST_SEEDS:
        hits = found.join(F.broadcast(seeds), "seed").select("doc_id", "item_id", "j", "n", around.alias("around"))
    else:
        # positions are thinned before they are shuffled; words are fetched for hits alone
        flags, bits = _flags(seeds, n_seeds)
        held = [F.expr(f"shiftleft(1L, cast({s} & 63 as int))") for s in ("slot0", "slot1")]
        words = [F.get(flags.scalar(), F.shiftright(s, 6).cast("int")) for s in ("slot0", "slot1")]
        thin = found.select("doc_id", "pos", "seed", *(s.alias(f"slot{k}") for k, s in enumerate(_slots(bits))))
        thin = thin.where((words[0].bitwiseAND(held[0]) != 0) & (words[1].bitwiseAND(held[1]) != 0)).select("doc_id", "pos", "seed")
        met = written(thin.join(seeds, "seed").select(F.col("doc_id").alias("at_doc"), "pos", "item_id", "j", "n").distinct(), "hits")
        hits = texts.join(met, F.col("doc_id").eqNullSafe(F.col("at_doc"))).select("doc_id", "item_id", "j", "n", around.alias("around"))
    hits = hits.join(items.select("item_id", F.col("words").alias("item")), "item_id")
    match = _best(F.col("around"), _around(F.col("item"), F.col("j")), F.col("n"))
    found = hits.select("doc_id", "item_id", match.cast("long").alias("n_match")).where("n_match > 0")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_match").alias("n_match"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap no item; columns stay.

    Each row is judged by its own text, also where doc_ids repeat or are null. Null and empty
    texts stay. An empty table stays empty.
    """
    columns = docs.columns
    docs, key = keyed(docs)
    # written first: Spark then knows its size, and shuffles the texts only if it is large
    bad = contaminated(docs.select(F.col(key).alias("doc_id"), "text"), benchmark)
    bad = written(bad.select(F.col("doc_id").alias(key)).distinct(), "bad")
    return docs.join(bad, key, "left_anti").select(*(f"`{c}`" for c in columns))
