"""N-gram Jaccard join by a count-vector R-tree.

A text's distinct 5-word shingles are hashed into groups; the group counts are a
point. Two sets share at most the sum of the coordinate minima of their points,
and a node of the tree bounds all points below it by the maxima of their
coordinates, so a search drops whole nodes, then points, and only what is left
is verified on the shingles themselves.

Distribution. The root level of the tree deals points to cells: a set enters
the cells of its first |S| - ceil(0.8 |S|) + 1 shingles in a fixed order, and two
sets with Jaccard similarity 0.8 or more always share a cell. In the order,
shingles found in many sets come last (a bitmap of fixed size says which; it is
counted over all documents, and only the cost depends on it, never the result),
so a passage that a third of all documents share makes no cell of its size.
Within a cell, members are first compared with the cell's smallest member, which
joins the members of large groups with one comparison each; only cells that
then still hold several components are searched through an R-tree. Sets travel
once, to the component that their bounds allow, and are verified there through
an R-tree again. Groups beyond `block` members are dealt as pairs of blocks.

Equal sets are one point: copies cost one row each, and no pairs. A set is known by 128
bits: 64 of them name it, and names that two sets share (some 3 of 10**10 sets) are found
in a count over all documents and replaced by the other 64. Two sets are compared on
64-bit hashes of their shingles, which takes two different shingles of the pair for equal
with a probability below 10**-12 for a million of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bitmap, in_bitmap, keyed, released, small_batches, written
from .words import mix, shingle_sets

#: Cells of more members than this are moved to the end of the order.
COMMON = 24
HOT_BITS = 26
MOST_COMMON = 1 << (HOT_BITS - 4)
LIVE_BITS = 26
BLOCK = 8192
#: Bytes of shingles of a block; a task holds two blocks.
BLOCK_BYTES = 16_000_000
#: Keys up to this many (12 bytes each) are broadcast; beyond, the rows of one cell or
#: component are dealt to so many tasks in a join.
SMALL, SALTS = 100_000, 16
MOST_CLASHES = 100_000
#: Members of a cell that a task holds at once.
CELL_ROWS = 8192
LEAF, FANOUT = 32, 16


def needed(n: int | np.ndarray, m: int | np.ndarray) -> int | np.ndarray:
    """The least intersection with 100 * intersection >= 80 * union."""
    return (4 * (n + m) + 8) // 9


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def fingerprints(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, signed; together they identify it. (0, 0) for no set."""
    if not len(found):
        return 0, 0
    turned = mix(found + np.uint64(len(found)))
    sums = np.array([found.sum(dtype=np.uint64), turned.sum(dtype=np.uint64)])
    both = np.array([np.bitwise_xor.reduce(found), np.bitwise_xor.reduce(turned)])
    one, two = mix(mix(sums) + both).view(np.int64)
    return int(one), int(two)


class Names:
    """The 64 bits that name a set: the first hash, or where two sets share it the second."""

    def __init__(self, clashes: frozenset[int] = frozenset()):
        self.clashes = clashes

    def of(self, found: np.ndarray) -> int:
        one, two = fingerprints(found)
        return two if one in self.clashes else one


class Seen:
    """A fixed table of names met of late: it may forget one, and never takes another for it."""

    def __init__(self, bits: int = 16):
        self.slots, self.mask = np.zeros(1 << bits, dtype=np.int64), (1 << bits) - 1

    def has(self, name: int) -> bool:
        """Whether the name is known; from now on it is."""
        at = name & self.mask
        known = bool(self.slots[at] == name)
        self.slots[at] = name
        return known


def prefix(found: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """The first shingles of an ascending set in the order (common, hash)."""
    length = prefix_length(len(found))
    if common is None:
        return found[:length]
    late = in_bitmap(common, found >> np.uint64(64 - HOT_BITS))
    if not late[:length].any():
        return found[:length]
    return np.concatenate([found[~late], found[late]])[:length]


def group_bits(n: int) -> int:
    """Groups of a set of n shingles: about n / 4, as a power of two."""
    return min(max(4, int(n // 4).bit_length()), 13)


def group_counts(found: np.ndarray) -> np.ndarray:
    bits = group_bits(len(found))
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint16 if len(found) < 65536 else np.uint32)


def fold(counts: np.ndarray, bits: int) -> np.ndarray:
    """The counts over 2**bits groups of a vector over as many or more."""
    return counts.astype(np.int32).reshape(1 << bits, -1).sum(axis=1, dtype=np.int32)


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint16 if n < 65536 else np.uint32)


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Whether the summed coordinate minima allow a link."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    bits = (min(len(a), len(b))).bit_length() - 1
    return int(np.minimum(fold(a, bits), fold(b, bits)).sum()) >= needed(n, m)


class CountTree:
    """A packed R-tree over count vectors; upper corners are all that bounds need."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                order.append(part)
                continue
            wide = int(points[part].var(axis=0).argmax())
            part = part[np.argsort(points[part, wide], kind="stable")]
            half = -(-len(part) // (2 * LEAF)) * LEAF
            todo += [part[half:], part[:half]]
        self.order = np.concatenate(order)
        self.points, self.sizes = points[self.order], sizes[self.order]
        cuts = np.cumsum([0, *map(len, order)])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.points, self.sizes, self.sizes
        while True:
            top, low, high = (f.reduceat(x, cuts[:-1]) for f, x in ((np.maximum, top), (np.minimum, low), (np.maximum, high)))
            self.levels.append((cuts, top, low, high))
            if len(top) == 1:
                break
            cuts = np.unique([*range(0, len(top), FANOUT), len(top)])

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places (in the input's order) of the points that may link with this one."""
        nodes = np.array([0])
        for cuts, top, low, high in reversed(self.levels):
            fits = (5 * high[nodes] >= 4 * size) & (5 * size >= 4 * low[nodes])
            nodes = nodes[fits]
            nodes = nodes[np.minimum(top[nodes], point).sum(axis=1) >= needed(size, low[nodes])]
            if not len(nodes):
                return nodes
            nodes = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in nodes])
        size_of = self.sizes[nodes]
        fits = 5 * np.minimum(size_of, size) >= 4 * np.maximum(size_of, size)
        fits &= np.minimum(self.points[nodes], point).sum(axis=1) >= needed(size, size_of)
        return self.order[nodes[fits]]


class Sets:
    """Disjoint sets of 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def joined(sizes: np.ndarray, counts: list[np.ndarray], sets: Sets, linked: Callable[[int, int], bool]) -> None:
    """Joins in `sets` all members connected by pairs that may link and are `linked`."""
    if len(sizes) <= LEAF // 2:
        for i, j in combinations(range(len(sizes)), 2):
            if sets.root(i) != sets.root(j) and may_link(int(sizes[i]), counts[i], int(sizes[j]), counts[j]) and linked(i, j):
                sets.join(i, j)
        return
    step = np.log(1.25)
    level = np.floor(np.log(sizes) / step + 1e-9).astype(int)
    for at in np.unique(level):
        own = np.flatnonzero(level == at)
        asks = np.flatnonzero((level == at) | (level == at - 1))
        # the coarsest vector that takes part
        bits = min(len(counts[i]).bit_length() - 1 for i in asks)
        points = {int(i): fold(counts[i], bits) for i in asks}
        tree = CountTree(np.stack([points[int(i)] for i in own]), sizes[own])
        for i in map(int, asks):
            for j in map(int, own[tree.search(points[i], int(sizes[i]))]):
                if i != j and sets.root(i) != sets.root(j) and linked(i, j):
                    sets.join(i, j)


def _numbers(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), *fingerprints(s)) for s in shingle_sets(batch.column("text"))]
        columns = [pa.array([x[k] for x in sets], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "fp", "fp2"])


def _keys(common: np.ndarray | None, named: Names) -> Callable:
    """Rows (key, n, fp) of the cells of each set; sets met of late in the task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Seen()
        keys: list[np.ndarray] = []
        names: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            times = [len(k) for k in keys]
            n, fp = (np.repeat(np.array(x, dtype=np.int64), times) for x in zip(*names, strict=True))
            return _numbers(key=np.concatenate(keys).view(np.int64), n=n, fp=fp)

        rows = 0
        for batch in batches:
            for found in shingle_sets(batch.column("text")):
                if not len(found) or met.has(fp := named.of(found)):
                    continue
                keys.append(prefix(found, common))
                names.append((len(found), fp))
                rows += len(keys[-1])
                if rows > 200_000:
                    yield flush()
                    keys, names, rows = [], [], 0
        if keys:
            yield flush()

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of two sets or more, a row each, from rows sorted by (key, n, fp).

    s1 and s2 identify the members, so that cells with the same members (the shingles of a
    shared passage) become one. A cell beyond CELL_ROWS is cut into parts that all begin
    with its first member and keep the cell's own key; no more than that is held.
    """
    held = [np.zeros(0, dtype=np.int64) for _ in range(3)]
    part = 0

    def rows(starts: np.ndarray, key: np.ndarray, n: np.ndarray, fp: np.ndarray, parts: list[int] | None = None) -> pa.RecordBatch:
        lengths = np.diff(starts)
        members = mix(fp.view(np.uint64) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        s1, s2 = np.add.reduceat(members, starts[:-1]), np.bitwise_xor.reduceat(mix(members + np.uint64(1)), starts[:-1])
        if parts is not None:
            s1, s2 = mix(key[:1].view(np.uint64)), key[:1].view(np.uint64)
        ends = pa.array(starts.astype(np.int32))
        columns = [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(parts or np.zeros(len(lengths), dtype=np.int32), pa.int32())]
        columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (n, fp)]
        return pa.RecordBatch.from_arrays(columns, names=["s1", "s2", "part", "ns", "fps"])

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        """Emits all runs held, but for the last one unless no rows follow."""
        nonlocal held, part
        key, n, fp = held
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stop = len(key) if last else starts[-1]
        starts = np.append(starts, len(key)) if last else starts
        first = 0
        if part and len(starts) > 1:  # the rest of a cell that was cut
            first = int(starts[1])
            if first > 1:
                yield rows(np.array([0, first]), key[:first], n[:first], fp[:first], [part])
            part, starts = 0, starts[1:]
        lengths = np.diff(starts)
        keep = np.repeat(lengths > 1, lengths)
        if keep.any():
            bounds = np.concatenate([[0], np.cumsum(lengths[lengths > 1])])
            yield rows(bounds, *(x[first:stop][keep] for x in (key, n, fp)))
        held = [x[stop:] for x in held]
        if len(held[0]) > CELL_ROWS:
            yield rows(np.array([0, len(held[0])]), *held, [part])
            part += 1
            held = [x[:1] for x in held]

    for batch in batches:
        new = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "n", "fp"), strict=True)]
        fresh = np.ones(len(new[0]), dtype=bool)
        fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in new])
        held = [x[fresh] for x in new]
        yield from whole(False)
    yield from whole(True)


def _picked(wanted: np.ndarray, whole: bool, named: Names) -> Callable:
    """(fp, n, data) of the sets whose fingerprint's slot is wanted: counts, or all hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Seen()
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            fp, n, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["fp", "n", "data"]
            )

        for batch in batches:
            for found in shingle_sets(batch.column("text")):
                if not len(found):
                    continue
                fp = named.of(found)
                slot = np.array([fp], dtype=np.int64).view(np.uint64) >> np.uint64(64 - LIVE_BITS)
                if not in_bitmap(wanted, slot)[0] or met.has(fp):
                    continue
                rows.append((fp, len(found), (found if whole else group_counts(found)).tobytes()))
                held += len(rows[-1][2])
                if held > 2_000_000:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both vectors: those that may link."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("n", "data", "pn", "pdata")]
        keep = [may_link(n, unpack(a, n), m, unpack(b, m)) for n, a, m, b in zip(*cols, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["fp", "pfp"])


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], cols: list[str]) -> Iterator[list[tuple]]:
    """Rows of each group, from rows that arrive sorted by group."""
    now, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in cols), strict=True), strict=True):
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return _numbers(a=np.array([a for a, _ in found], dtype=np.int64), b=np.array([b for _, b in found], dtype=np.int64))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the components of a cell whose points may link."""
    out: list[tuple[int, int]] = []
    for rows in _groups(batches, ["key", "i", "j"], ["n", "fp", "comp", "data"]):
        comps = sorted({r[2] for r in rows})
        place = {c: k for k, c in enumerate(comps)}
        if len(comps) < 2:
            continue
        rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (r[0], r[1]))
        sets = Sets(len(rows))
        lead: dict[int, int] = {}
        for k, r in enumerate(rows):
            sets.join(lead.setdefault(place[r[2]], k), k)

        def linked(i: int, j: int, rows: list = rows) -> bool:
            out.append((rows[i][1], rows[j][1]))
            return True

        joined(np.array([r[0] for r in rows]), [unpack(r[3], r[0]) for r in rows], sets, linked)
        if len(out) > 50_000:
            yield _edges(out)
            out.clear()
    if out:
        yield _edges(out)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the sets of a group that true links connect."""
    out: list[tuple[int, int]] = []
    for rows in _groups(batches, ["comp", "i", "j"], ["n", "fp", "data"]):
        rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (r[0], r[1]))
        found = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]

        def linked(i: int, j: int, found: list = found) -> bool:
            a, b = sorted((found[i], found[j]), key=len)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            return int((b[at] == a).sum()) >= needed(len(a), len(b))

        sets = Sets(len(rows))
        joined(np.array([r[0] for r in rows]), [group_counts(f) for f in found], sets, linked)
        out += [(r[1], rows[sets.root(k)][1]) for k, r in enumerate(rows) if sets.root(k) != k]
        if len(out) > 50_000:
            yield _edges(out)
            out.clear()
    if out:
        yield _edges(out)


def _joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined with right, a row per key. Up to SMALL keys are broadcast; beyond, the
    rows of a hot key are dealt to SALTS tasks."""
    right = written(right, "keys")
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), on)
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.hint("merge").withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS))).join(right, [on, "salt"]).drop("salt")


def _blocked(df: DataFrame, by: str, block: int) -> DataFrame:
    """Rows with (i, j): one group for a `by` of up to `block` rows and BLOCK_BYTES of
    shingles (n each), else all pairs of blocks."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n") * F.lit(8.0 / BLOCK_BYTES))).cast("int")
    df = _joined(df, df.groupBy(by).agg(blocks.alias("nb")), by)
    own = F.pmod(F.hash("fp"), F.col("nb"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")),
    )
    return df.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p", "nb")


def _slot(name: str) -> F.Column:
    return F.shiftrightunsigned(name, 64 - LIVE_BITS)


def _by_group(df: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), schema)


def _clashes(members: DataFrame) -> frozenset[int]:
    """First hashes that differing sets share."""
    shared = members.where("n > 0").groupBy("fp").agg(F.min("fp2").alias("lo"), F.max("fp2").alias("hi")).where("lo <> hi")
    found = shared.select("fp").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise RuntimeError("too many sets share a 64-bit hash")
    return frozenset(r["fp"] for r in found)


def ngram_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Classes of the texts of `docs` (doc_id: long, text: string) under links of similarity 0.8.

    Words are runs of code points other than U+0020 and U+0009-U+000D, A-Z lower-cased.
    A text's set: its distinct 5-word shingles; with 1 to 4 words the whole sequence as
    one. Two texts link when 100 * |A & B| >= 80 * |A | B|.

    Returns a row per row of `docs`: doc_id, n_shingles (the set's size) and component_id,
    the smallest doc_id that links reach, the row's own included. Null, empty and wordless
    texts have an empty set and link with nothing. Equal texts link; a doc_id that repeats
    keeps a row each time. A null doc_id is allowed and never the smallest unless alone.
    Other columns are ignored. An empty table gives no rows. Whole texts are read; a text
    beyond the slice size of `words` is processed alone.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    texts = docs.select("text")
    members = written(docs.mapInArrow(released(_members), "doc_id long, n long, fp long, fp2 long"), "members")
    names = Names(_clashes(members))
    if names.clashes:
        members = members.withColumn("fp", F.when(F.col("fp").isin(*names.clashes), F.col("fp2")).otherwise(F.col("fp")))

    cells = texts.mapInArrow(released(_keys(None, names)), "key long, n long, fp long")
    crowded = cells.groupBy(F.shiftrightunsigned("key", 24).alias("g")).count().where(F.col("count") > COMMON)
    crowded = written(crowded, "crowded")
    if (n := crowded.count()) > MOST_COMMON:  # the most crowded ones only: the bitmap stays sparse
        crowded = crowded.where(F.col("count") > crowded.approxQuantile("count", [1 - MOST_COMMON / n], 1e-3)[0])
    common = bitmap(crowded, F.shiftrightunsigned("g", 40 - HOT_BITS), HOT_BITS)
    cells = texts.mapInArrow(released(_keys(common, names)), "key long, n long, fp long")
    cells = cells.repartition("key").sortWithinPartitions("key", "n", "fp")
    cells = cells.mapInArrow(released(_cells), "s1 long, s2 long, part int, ns array<long>, fps array<long>")
    cells = written(cells.groupBy("s1", "s2", "part").agg(F.first("ns").alias("ns"), F.first("fps").alias("fps")), "cells")
    first = [F.get(c, F.lit(0)).alias(f"p{c[:-1]}") for c in ("ns", "fps")]
    shared = cells.select(F.col("s1").alias("key"), *first, F.explode(F.arrays_zip("ns", "fps")).alias("m"))
    shared = shared.select("key", F.col("m.ns").alias("n"), F.col("m.fps").alias("fp"), "pn", "pfp")

    wanted = bitmap(shared, _slot("fp"), LIVE_BITS)
    counts = texts.mapInArrow(released(_picked(wanted, False, names)), "fp long, n long, data binary")
    counts = written(counts.dropDuplicates(["fp"]), "counts")
    vectors = counts.select("fp", "data")
    pairs = shared.where("fp <> pfp and 5 * pn >= 4 * n").select("fp", "n", "pfp", "pn").distinct()
    pairs = pairs.join(vectors, "fp").join(counts.select(F.col("fp").alias("pfp"), F.col("data").alias("pdata")), "pfp")
    stars = written(pairs.mapInArrow(released(_bounded), "fp long, pfp long"), "stars").toDF("a", "b")
    near = components(stars)

    placed = shared.select("key", "n", "fp").join(near.toDF("fp", "comp"), "fp", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "fp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = written(_joined(placed, mixed, "key"), "mixed")
    mixed = _blocked(mixed, "key", block).join(vectors, "fp")
    more = written(_by_group(mixed, ["key", "i", "j"], _searched, "a long, b long").distinct(), "more")
    if not more.isEmpty():
        near = components(stars.union(more))

    near = written(near.toDF("fp", "comp").join(counts.select("fp", "n"), "fp"), "near")
    wanted = bitmap(near, _slot("fp"), LIVE_BITS)
    sets = texts.mapInArrow(released(_picked(wanted, True, names)), "fp long, n long, data binary")
    sets = _blocked(near, "comp", block).drop("n").join(sets, "fp")
    links = written(_by_group(sets, ["comp", "i", "j"], _verified, "a long, b long"), "links")
    roots = components(links).toDF("fp", "root")

    # copies are counted as one set before components meet; an empty set has no class but its own row
    own = members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("own"))
    own = written(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = own.groupBy("root").agg(F.min("own").alias("least"))
    least = own.join(least, "root").select("fp", "least")
    full = members.where("n > 0").join(least, "fp").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return full.union(members.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each class of `docs`, that with the smallest doc_id; all columns stay.

    Rows are told apart where doc_ids repeat or are null: of a class, a row with an id goes
    before one without, and of rows with the same doc_id the one that stays is chosen by a hash
    of its text, then by its place in the table. Null, empty and wordless texts are in no class
    and all stay. An empty table stays empty.
    """
    columns = docs.columns
    docs, key = keyed(docs)
    found = ngram_components(docs.select(F.col(key).alias("doc_id"), "text"), block)
    if key == "doc_id":
        dropped = found.where("doc_id <> component_id").select(key)
    else:
        # min of a struct combines before it shuffles, so a class of many copies is no hot task
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(key).alias("row"))
        ranked = docs.select(F.col(key), order.alias("rank"))
        classes = written(found.select(F.col("doc_id").alias(key), F.col("component_id").alias("class")).join(ranked, key), "classes")
        kept = classes.groupBy("class").agg(F.min("rank").alias("first")).select(F.col("first.row").alias(key))
        dropped = classes.select(key).join(kept, key, "left_anti")
    # written first: Spark then knows its size, and shuffles the texts only if it is large
    dropped = written(dropped.distinct(), "dropped")
    return docs.join(dropped, key, "left_anti").select(*(f"`{c}`" for c in columns))
