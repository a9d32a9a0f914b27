"""Language identification by prediction by partial matching.

For each language a context tree of bytes is learned: in every context of up to
`order` bytes, how often each byte followed. A byte that did not follow in the
longest known context is coded by an escape (method C: the number of distinct
followers against all their counts plus that number), then in the next shorter
context, and at last uniformly over 256 bytes. Statistics are frozen after
training, so the code length of a byte depends on the bytes before it alone: a
text's code length in each language is an exact integer sum (in 2**-16 bits) over
its bytes, whatever the batches or the order.

A tree keeps only what its language's texts hold: per order a hash table of
(context, byte) pairs and one of contexts, so memory follows the sample, and not
contexts x bytes x languages. Every label is learned. Training reads a bounded
sample (`learned`) and runs on the executors, a language a task; the driver gets
the finished tables. Scoring reads every whole text, streaming.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import released, small_batches, written
from .words import slices, text_buffer

ORDER = 3
#: The bound of the sample: rows of a language, and bytes of their texts.
PER_LANGUAGE = 500
SAMPLE_BYTES = 4_000_000
#: A text of SHORTEST bytes or more whose bytes cost more than MOST_EXCESS times what those
#: of its language's sample do is in no learned language.
MOST_EXCESS, SHORTEST = 4.0, 100
UNKNOWN = "und"
UNIT = 1 << 16
SLICE_BYTES = 1 << 17
_LETTER = np.zeros(256, dtype=bool)
_HALF, _NONE = np.uint64(1 << 32), np.uint64((1 << 64) - 1)
_LETTER[65:91] = _LETTER[97:123] = True


class Table:
    """An immutable hash table of distinct 32-bit keys and costs; -1 for a key it has not.

    A slot holds key and cost in one 64-bit word, so that a lookup touches memory once; the
    low half is the cost and one more, so that 0 is an empty slot.
    """

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.zeros(1 << self.bits, dtype=np.uint64)
        self.reach = 0  # steps that the farthest key is from its home
        words = (keys.astype(np.uint64) << np.uint64(32)) | (costs.astype(np.uint64) + np.uint64(1))
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] == 0
            slots, one = np.unique(at[free], return_index=True)
            self.slots[slots] = words[left[free][one]]
            stay = np.ones(len(left), dtype=bool)
            stay[np.flatnonzero(free)[one]] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
            self.reach += len(left) > 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Costs as int64."""
        high = keys.astype(np.uint64) << np.uint64(32)
        at = self._home(keys)
        words = self.slots[at]
        # where the keys agree the high half goes, and what is left is the cost and one more
        costs = (words ^ high) - np.uint64(1)
        other = costs >= _HALF
        left = np.flatnonzero(other & (words != 0)) if self.reach else np.zeros(0, np.int64)
        costs = np.where(other, _NONE, costs)
        at, high = at[left], high[left]
        for _ in range(self.reach):
            if not len(left):
                break
            at = (at + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
            words = self.slots[at]
            there = (words ^ high) - np.uint64(1)
            same = there < _HALF
            costs[left[same]] = there[same]
            on = ~same & (words != 0)
            left, at, high = left[on], at[on], high[on]
        return costs.view(np.int64)


@dataclass
class Model:
    """languages by name; per language the bits that a byte of its sample costs, and per order
    the tables of `trained`."""

    languages: list[str]
    rates: list[float]
    direct: list[list[Table]]
    escape: list[list[Table]]
    order: int


def _codes(data: np.ndarray, starts: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Each byte with the three before it, the nearest highest below it; 0 beyond a text's start.

    starts: places where texts begin. before: bytes of the same text ahead of `data`.
    """
    back = 0 if before is None else len(before)
    wide = (data if before is None else np.concatenate([before, data])).astype(np.uint32)
    out = wide.copy()
    for k in (1, 2, 3):
        out[k:] |= wide[:-k] << np.uint32(8 * k)
    for start in starts:
        for k in range(3):
            if start + back + k < len(out):
                out[start + back + k] &= np.uint32((1 << (8 * (k + 1))) - 1)
    return out[back:]


def _low(codes: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bytes of codes."""
    return codes & np.uint32((1 << (8 * n)) - 1)


Trained = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]


def trained(texts: list[str], order: int = ORDER) -> Trained:
    """Per order: (context, byte) codes and their costs, contexts and the costs of leaving
    them, and the bits that a byte of the texts costs in its context of that order."""
    data = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts if t]
    starts = np.cumsum([0, *map(len, data)])[:-1]
    codes = _codes(np.concatenate([np.zeros(0, np.uint8), *data]), starts)
    out = []
    for k in range(order + 1):
        grams, n = np.unique(_low(codes, k + 1), return_counts=True)
        contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
        kinds = np.diff([*first, len(grams)])
        total = np.add.reduceat(n, first) if len(first) else n
        direct = np.rint(np.log2(np.repeat(total + kinds, kinds) / n) * UNIT)
        leave = np.rint(np.log2((total + kinds) / kinds) * UNIT)
        rate = float((direct * n).sum() / max(n.sum(), 1) / UNIT)
        out.append((grams, direct.astype(np.int32), contexts, leave.astype(np.int32), rate))
    return out


def model_of(tables: dict[str, Trained], order: int = ORDER) -> Model:
    names = sorted(tables)
    direct = [[Table(own[0], own[1]) for own in tables[name]] for name in names]
    escape = [[Table(own[2], own[3]) for own in tables[name]] for name in names]
    return Model(names, [tables[name][-1][4] for name in names], direct, escape, order)


def train(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model of the given texts by language; `order` is 1 to 3."""
    return model_of({lang: trained(own, order) for lang, own in texts.items()}, order)


def _costs(model: Model, at: int, codes: np.ndarray) -> np.ndarray:
    """Code lengths of bytes in one language."""
    out = model.direct[at][model.order].get(_low(codes, model.order + 1))
    places = np.flatnonzero(out < 0)
    out[places], codes = 0, codes[places]
    for k in range(model.order - 1, -1, -1):
        if not len(places):
            return out
        # a context that the language has never met costs nothing to leave
        out[places] += np.maximum(model.escape[at][k + 1].get(_low(codes >> np.uint32(8), k + 1)), 0)
        cost = model.direct[at][k].get(_low(codes, k + 1))
        met = cost >= 0
        out[places[met]] += cost[met]
        places, codes = places[~met], codes[~met]
    out[places] += np.maximum(model.escape[at][0].get(_low(codes, 0)), 0) + 8 * UNIT
    return out


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """(rows, languages) exact code lengths in UNIT bits; each text starts anew."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(column), len(model.languages)), dtype=np.int64)
    for a, b in slices(offsets, SLICE_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        for lo in range(0, int(at[-1]), SLICE_BYTES):  # a very long text in pieces
            hi = min(lo + SLICE_BYTES, int(at[-1]))
            part = data[offsets[a] + lo : offsets[a] + hi]
            before = data[offsets[a] + max(lo - 3, 0) : offsets[a] + lo]
            edges = np.clip(at - lo, 0, hi - lo)
            starts = at[:-1][(at[:-1] >= lo) & (at[:-1] < hi)] - lo
            codes = _codes(part, starts, before)
            rows = np.flatnonzero(edges[1:] > edges[:-1])
            for k in range(len(model.languages)):
                out[a + rows, k] += np.add.reduceat(_costs(model, k, codes), edges[rows])
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    out = np.zeros(len(column), dtype=bool)
    for a, b in slices(offsets, SLICE_BYTES):
        places = np.flatnonzero(_LETTER[data[offsets[a] : offsets[b]]])
        edges = np.searchsorted(places, offsets[a : b + 1] - offsets[a])
        out[a:b] = edges[1:] > edges[:-1]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
    return out


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language of the shortest code (ties: the first by name), its posterior, and how
    many times what its sample's bytes cost those of the text do."""
    if not model.languages:
        return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column))
    bits = code_lengths(model, column) / UNIT
    best = bits.argmin(axis=1)
    score = 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
    fine = has_letter(column)
    n_bytes = np.diff(text_buffer(column)[1])
    usual = np.maximum(n_bytes, 1) * np.maximum(np.array(model.rates)[best], 1e-3)
    return [model.languages[k] if f else UNKNOWN for k, f in zip(best, fine, strict=True)], np.where(fine, score, 0.0), bits.min(axis=1) / usual


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of the rows that are learned from.

    Of each language's distinct rows (doc_id, text, lang; no nulls in the latter two, no
    text above `most_bytes`) the first `per_language` by digest of doc_id and text, as long
    as the texts before them have fewer than `most_bytes` bytes together. Ties can only be
    equal rows, so reruns agree. A row's digest must be below its language's threshold,
    which leaves about four times the rows wanted; so no task gets all rows of a language.
    """
    rows = rows.where("text is not null and lang is not null").where(F.octet_length("text") <= most_bytes)
    counts = written(rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows")), "labels")
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))
    drawn = rows.select("lang", digest.alias("h"), "doc_id", "text").join(counts, F.col("lang") == F.col("of"))
    share = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = drawn.where(share * F.col("rows") < 4.0 * per_language).select("lang", "h", "doc_id", "text").distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    before = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("nth", F.row_number().over(first)).withColumn("before", F.coalesce(before, F.lit(0)))
    return drawn.where(F.col("nth") <= per_language).where(F.col("before") < most_bytes).select("lang", "text")


def learned(rows: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of every language of `rows`, from its `sample`; trained on the executors.

    The driver gets the tables: for each language some 12 bytes per distinct run of up to
    order + 1 bytes in its sample, and none of the texts.
    """

    def run(group: pa.Table) -> pa.Table:
        made = trained(group.column("text").to_pylist(), order)
        columns = [pa.array([group.column("lang")[0].as_py()] * len(made), pa.string()), pa.array(range(len(made)), pa.int32())]
        columns += [pa.array([x[k].tobytes() for x in made], pa.binary()) for k in range(4)]
        columns.append(pa.array([x[4] for x in made], pa.float64()))
        return pa.table(columns, names=["lang", "k", "grams", "costs", "contexts", "leave", "rate"])

    chosen = sample(rows, per_language, most_bytes).withColumn("lang", F.col("lang").cast("string"))
    fields = "lang string, k int, grams binary, costs binary, contexts binary, leave binary, rate double"
    found: dict[str, dict[int, tuple]] = {}
    for r in chosen.groupBy("lang").applyInArrow(run, fields).toLocalIterator():
        kinds = (np.uint32, np.int32, np.uint32, np.int32)
        arrays = (np.frombuffer(r[c], t) for c, t in zip(("grams", "costs", "contexts", "leave"), kinds, strict=True))
        found.setdefault(r["lang"], {})[r["k"]] = (*arrays, r["rate"])
    return model_of({lang: [own[k] for k in sorted(own)] for lang, own in found.items()}, order)


_ADDED = ("lang_pred", "score", "excess")


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and excess (names that clash are replaced; see `predict`).

    `und` with score 0 for a null or empty text and for one without a letter, and where
    nothing was learned.
    """
    docs = docs.drop(*_ADDED)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, excess = predict(shared.value, batch.column(text))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(excess, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *_ADDED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(released(run), f"{fields}, lang_pred string, score double, excess double")


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (6 decimals) of every row of `docs` (doc_id, text,
    lang).

    Null, empty and letterless texts are `und` with score 0, and so is all where no row has
    a label. Equal texts get equal results: ties of code lengths go to the first language by
    name, and the score then is an equal share. Repeated rows keep a row each and are learned
    once. A null doc_id is not held out. Very long texts are read in pieces, in full. Other
    columns are ignored; an empty table gives no rows.
    """
    model = learned(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is recognised with that posterior, and at a cost that
    is usual in it (see MOST_EXCESS); columns stay.

    Rows with a null, empty or letterless text go, and texts in no learned language. Repeated rows stay or go together, and of
    languages that tie none has the posterior unless `least` allows it. Null and repeated
    doc_ids change nothing; an empty table stays empty.
    """
    model = learned(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identified(docs.withColumnsRenamed({c: f"__{c}" for c in _ADDED}), model)
    usual = (F.col("excess") <= MOST_EXCESS) | (F.octet_length("text") < SHORTEST)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & usual).drop(*_ADDED)
    return kept.withColumnsRenamed({f"__{c}": c for c in _ADDED})
