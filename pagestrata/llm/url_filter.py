"""URL filters: rules by host and path, and a cascade of Bloom filters for listed domains.

The cascade answers membership exactly for every key of a known universe, and without a
join: its first filter holds the listed keys; the second the unlisted keys that the first
lets through; the third the listed keys that the second lets through; and so on until no
key is let through wrongly. A key's answer is the first filter that does not hold it.
The universe is every domain and parent domain of every URL of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

HASHES = 5
BITS_A_KEY = 8
#: Bits of one filter at most (512 MB), which the driver holds and sends to executors.
MOST_BITS = 1 << 32
#: A level must hold back this share of the keys that it shall hold back, or the search ends.
LEAST_STOPPED = 0.25

#: The query's rules (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The query's listed domains; subdomains follow them.
LISTED = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host, "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(host != "", tails).otherwise(F.array().cast("array<string>"))


def best_rule(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column, pick: int) -> Column:
    """The longest rule that fits: its name (pick 0) or action (pick 1); null if none does."""
    found = None
    for action, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.lit((name + start, action)[pick])
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    """The key's places in the filter of a level: double hashing."""
    one, two = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    mask = F.lit(bits - 1).cast("long")
    return [(one.bitwiseAND(mask) + two.bitwiseAND(mask) * k).bitwiseAND(mask) for k in range(HASHES)]


@dataclass
class Cascade:
    levels: list[np.ndarray]

    @staticmethod
    def bits(words: np.ndarray) -> int:
        return len(words) * 64

    def slots(self, key: Column) -> Column:
        """An array of the key's places in all filters, level after level."""
        return F.array(*(c for k, w in enumerate(self.levels) for c in _slots(key, k, self.bits(w))))

    def holds(self, slots: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe, from their places (keys x levels * HASHES)."""
        found = np.zeros(len(slots), dtype=bool)
        open_ = np.ones(len(slots), dtype=bool)
        for k, words in enumerate(self.levels):
            at = slots[:, k * HASHES : (k + 1) * HASHES]
            inside = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0).all(axis=1)
            found = np.where(open_ & inside, k % 2 == 0, found)
            open_ &= inside
        return found


def _filter(keys: DataFrame, level: int) -> np.ndarray:
    """The words of a filter of the keys: it grows with their number, up to MOST_BITS."""
    bits, n = 64, keys.count()
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("flags")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["flags"].to_numpy(np.int64).view(np.uint64)
    return words


def _let_through(keys: DataFrame, level: int, words: np.ndarray) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(Cascade([words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slots").flatten().to_numpy().reshape(-1, HASHES)
            yield batch.filter(pa.array(shared.value.holds(at), pa.bool_())).select(["key"])

    return keys.withColumn("slots", F.array(*_slots(F.col("key"), level, Cascade.bits(words)))).mapInArrow(run, "key string")


def cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade for the keys of `universe` (key: string, distinct, no nulls) that are `listed`.

    Each level is a fiftieth or so of the one before the last, as long as filters have
    BITS_A_KEY bits a key. A level too full to hold back LEAST_STOPPED of the keys fails.
    """
    inside = written(universe.join(listed.select("key").distinct(), "key", "left_semi"), "listed")
    outside = written(universe.join(listed.select("key").distinct(), "key", "left_anti"), "unlisted")
    levels: list[np.ndarray] = []
    while True:
        asked = outside.count()
        words = _filter(inside, len(levels))
        levels.append(words)
        passed = written(_let_through(outside, len(levels) - 1, words), "passed")
        through = passed.count()
        if not through:
            return Cascade(levels)
        if asked > 1000 and through > (1 - LEAST_STOPPED) * asked:
            raise RuntimeError(f"level {len(levels)} lets through {through} of {asked} keys: too many keys for filters of {MOST_BITS} bits")
        inside, outside = passed, inside


def listing(spark: SparkSession, keys: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages` (page_id, url).

    verdict: the action of the longest rule that fits (host and subdomains, path by its
    start; ties by name), else block if the host or a parent domain is listed, else allow.
    A null url, or one without ://, has an empty host and path, fits no rule and is
    allowed. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    listed = listing(pages.sparkSession, LISTED) if listed is None else listed
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    universe = written(rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct(), "keys")
    model = cascade(universe, listed)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    width = HASHES * len(model.levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("slots")
            counts = np.asarray(keys.value_lengths()) // width
            each = shared.value.holds(keys.flatten().to_numpy().reshape(-1, width))
            total = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(counts)
            hit = total[ends] > total[ends - counts]
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hit, pa.bool_())], names=["page_id", "host", "path", "listed"])

    # the filters' places of all domains of a host, in one array
    places = F.flatten(F.transform(domains(F.col("host")), model.slots))
    found = rows.withColumn("slots", places).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, listed boolean")
    rule = best_rule(rules, F.col("host"), F.col("path"), 0)
    verdict = F.coalesce(best_rule(rules, F.col("host"), F.col("path"), 1), F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
