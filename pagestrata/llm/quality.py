"""Quality rules: base counts, and robust multivariate outliers by language and source.

Each text's statistics become a vector of whole numbers, transformed coordinates on a grid.
Equal vectors of a group are one weighted cell. Per group the minimum-covariance-determinant
estimate is sought by concentration steps from several deterministic starts: coordinate
medians and deviations, the mean and covariance of all, and the covariance of spatial signs.
A step takes the nearest vectors that hold `SHARE` of the weight, whole shells of the width
1 / SHELLS at a time, and makes a mean and a covariance of them; steps end when no group's
subset changes. Of each group's results the one with the smallest determinant stays. A
vector whose squared Mahalanobis distance from it is above `CUTOFF` is an outlier. Groups of
fewer than `LEAST` documents use their language's estimate, and that failing, the estimate
over all documents.

A step is one aggregation of weights, sums and products by group, start and shell, added up
before the shuffle; no task sees the vectors of a group together, however hot it is, and what
is ranked are at most MOST_SHELLS rows a group and start. All sums are of whole numbers, so
reruns agree to the last bit.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from math import erf, exp, gamma, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
SHARE = 0.75
#: Steps at most; a start that has not come to rest by then is judged as it is.
STEPS = 12
LEAST = 100
#: About the 1 - 1e-6 quantile of chi-square with as many degrees as coordinates.
CUTOFF = 36.0
GRID = 10
#: No coordinate is above this many steps of the grid.
HIGHEST = 10_000
#: Added to each variance, in steps of the grid squared: a coordinate that hardly varies
#: still allows this spread (a regularized covariance).
RIDGE = (2.5, 0.8, 5.0, 5.0, 5.0)
SHELLS, MOST_SHELLS = 64, 4096
#: Tables of up to this many groups (some 250 bytes a group and start) are broadcast.
FEW = 20_000
COORDINATES = ("x1", "x2", "x3", "x4", "x5")
_P = range(len(COORDINATES))
_PAIRS = [(i, j) for i in _P for j in _P if j <= i]
_MOMENTS = ["n", *(f"s_{i}" for i in _P), *(f"q_{i}_{j}" for i, j in _PAIRS)]
_FIT = [*(f"m_{i}" for i in _P), *(f"l_{i}_{j}" for i, j in _PAIRS)]


def chi_square(x: float, degrees: int) -> float:
    """Distribution function of chi-square with an odd number of degrees."""
    found = erf(sqrt(x / 2))
    for k in range(1, degrees, 2):
        found -= exp(-x / 2) * (x / 2) ** (k / 2) / gamma(k / 2 + 1)
    return found


def consistency(share: float, degrees: int) -> float:
    """What the covariance of the inner `share` of a normal sample is short of the whole's."""
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return share / chi_square(low, degrees + 2)


FACTOR = consistency(SHARE, len(COORDINATES))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""
    windows = F.when(
        F.size(words) >= 3,
        F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.size(words) - 2),
    )

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def twice(order: Column) -> Column:
        def beside(x: Column, k: Column) -> Column:
            before, after = F.get(order, k - 1)["h"], F.get(order, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(order, beside), lambda x: x["i"]))

    def bound(value: Column, use) -> Column:
        # evaluates value once, however often use() names it
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def counted(found: Column) -> Column:
        order = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), bound(order, lambda o: bound(twice(o), covered))).otherwise(0)

    return F.coalesce(bound(windows, counted), F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    bare = reduce(lambda left, mark: F.replace(left, F.lit(mark), F.lit("")), SYMBOLS, F.col("text"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        lines.alias("lines"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def coordinates() -> list[Column]:
    """The transformed statistics, in steps of 1 / GRID."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = (
        F.log1p(F.col("n_words")) / 2,
        F.col("word_chars") / words,
        F.log1p(200.0 * F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines")),
        F.log1p(20.0 * F.col("n_repeat_words") / words),
    )
    return [F.least(F.round(x * GRID), F.lit(float(HIGHEST))).cast("long").alias(c) for x, c in zip(raw, COORDINATES, strict=True)]


def _levels() -> Column:
    """A document's groups: language and source, language, all."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.to_json(F.array(c))), F.lit("-")) for c in ("lang", "source"))
    return F.array(F.concat_ws("|", F.lit("0"), lang, source), F.concat_ws("|", F.lit("1"), lang), F.lit("2"))


def _distance(at: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared length of the solution z of L z = at."""
    z: list[Column] = []
    for i, x in enumerate(at):
        z.append((x - reduce(lambda a, b: a + b, [low[i, j] * z[j] for j in range(i)], F.lit(0.0))) / low[i, i])
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _moments(w: Column) -> list[Column]:
    """Weight, sums and sums of products of the rows, as whole numbers."""
    x = [F.col(c) for c in COORDINATES]
    return [F.sum(w).alias("n"), *(F.sum(w * x[i]).alias(f"s_{i}") for i in _P), *(F.sum(w * x[i] * x[j]).alias(f"q_{i}_{j}") for i, j in _PAIRS)]


def _factored(found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, m_i and the Cholesky factor l_i_j of the covariance c_i_j."""
    for j in _P:
        inner = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        found = found.withColumn(f"l_{j}_{j}", F.expr(f"sqrt(greatest(c_{j}_{j}{inner}, {RIDGE[j] ** 2 / 100}D))"))
        below = {f"l_{i}_{j}": F.expr(f"(c_{i}_{j}{''.join(f' - l_{i}_{k} * l_{j}_{k}' for k in range(j))}) / l_{j}_{j}") for i in _P if i > j}
        found = found.withColumns(below) if below else found
    return found.select(*keys, *_FIT)


def _estimate(moments: DataFrame, keys: list[str], factor: float = FACTOR) -> DataFrame:
    means = [F.expr(f"s_{i} / cast(n as double)").alias(f"m_{i}") for i in _P]
    covariance = [
        F.expr(f"(q_{i}_{j} - cast(s_{i} as double) * s_{j} / n) / n * {factor!r}D" + (f" + {RIDGE[i] ** 2}D" if i == j else "")).alias(f"c_{i}_{j}")
        for i, j in _PAIRS
    ]
    return _factored(moments.select(*keys, *means, *covariance), keys)


def _measured(rows: DataFrame) -> Column:
    """The squared Mahalanobis distance of rows that have coordinates, m_i and l_i_j."""
    low = {(i, j): F.col(f"l_{i}_{j}") for i, j in _PAIRS}
    return _distance([F.col(COORDINATES[i]) - F.col(f"m_{i}") for i in _P], low)


def _met(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows with what `groups` has for their group; hot groups stay where they are if there
    are few groups."""
    return rows.join(F.broadcast(groups) if few else groups, "g")


def _starts(cells: DataFrame, few: bool) -> DataFrame:
    """(g, start, m_i, l_i_j): the estimates that concentration begins with."""
    middle = cells.groupBy("g").agg(*(F.expr(f"percentile({c}, 0.5D, w)").alias(f"m_{i}") for i, c in enumerate(COORDINATES)))
    apart = _met(cells, written(middle, "medians"), few)
    spread = apart.groupBy("g").agg(
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in _P),
        *(F.expr(f"percentile(abs({c} - m_{i}), 0.5D, w)").alias(f"a_{i}") for i, c in enumerate(COORDINATES)),
    )
    scale = [F.expr(f"sqrt(pow(1.4826D * a_{i}, 2) + {RIDGE[i] ** 2}D)").alias(f"r_{i}") for i in _P]
    spread = written(spread.select("g", *(f"m_{i}" for i in _P), *scale), "spread")
    flat = [(F.col(f"r_{i}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in _PAIRS]
    medians = spread.select("g", F.lit(0).alias("start"), *(f"m_{i}" for i in _P), *flat)
    everything = _estimate(cells.groupBy("g").agg(*_moments(F.col("w"))), ["g"], 1.0).withColumn("start", F.lit(1))
    # directions from the medians, each of the same length; products in millionths
    signs = _met(cells, spread, few)
    signs = signs.select("g", "w", *(f"m_{i}" for i in _P), *(f"r_{i}" for i in _P), *(F.expr(f"(x{i + 1} - m_{i}) / r_{i}").alias(f"z_{i}") for i in _P))
    length = F.expr(" + ".join(f"z_{i} * z_{i}" for i in _P))
    product = {(i, j): F.expr(f"cast(round(z_{i} * z_{j} / greatest(length, 1e-12D) * 1000000) as bigint) * w") for i, j in _PAIRS}
    signs = signs.withColumn("length", length).groupBy("g").agg(
        F.sum("w").alias("n"), *(F.first(f"{c}_{i}").alias(f"{c}_{i}") for c in "mr" for i in _P), *(F.sum(product[i, j]).alias(f"q_{i}_{j}") for i, j in _PAIRS)
    )
    covariance = [F.expr(f"q_{i}_{j} / 1000000D / n * {len(COORDINATES)} * r_{i} * r_{j}" + (f" + {RIDGE[i] ** 2}D" if i == j else "")).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    signs = _factored(signs.select("g", *(f"m_{i}" for i in _P), *covariance), ["g"]).withColumn("start", F.lit(2))
    return medians.unionByName(everything).unionByName(signs)


def _concentrated(cells: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """(g, start, moments) of the nearest vectors of each group and start."""
    rows = _met(cells, fit, few)
    shell = F.least(F.floor(F.sqrt(_measured(rows)) * SHELLS), F.lit(MOST_SHELLS - 1)).cast("int")
    shells = rows.withColumn("shell", shell).groupBy("g", "start", "shell").agg(F.max("size").alias("size"), *_moments(F.col("w")))
    order = Window.partitionBy("g", "start").orderBy("shell").rowsBetween(Window.unboundedPreceding, -1)
    inner = shells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < SHARE * F.col("size"))
    return inner.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in _MOMENTS))


def estimates(cells: DataFrame, few: bool = False) -> DataFrame:
    """(g, m_i, l_i_j): per group of `cells` (g, size, w, coordinates) the estimate with the
    smallest determinant; of equal ones the first start's."""
    keys = ["g", "start"]
    fit, last = written(_starts(cells, few), "starts"), None
    for _ in range(STEPS):
        subset = written(_concentrated(cells, fit, few), "subsets")
        fit = _estimate(subset, keys)
        if last is not None and subset.join(last, [*keys, *_MOMENTS], "left_anti").isEmpty():
            break
        last = subset
    determinant = reduce(lambda a, b: a * b, [F.col(f"l_{i}_{i}") * F.col(f"l_{i}_{i}") for i in _P])
    best = F.min_by(F.struct(*_FIT), F.struct(determinant.alias("d"), F.col("start"))).alias("fit")
    return fit.groupBy("g").agg(best).select("g", "fit.*")


def estimated(counts: DataFrame) -> DataFrame:
    """Per (lang, source) of `counts`: the estimate of its finest group that has one."""
    cells = counts.select("lang", "source", *coordinates()).groupBy("lang", "source", *COORDINATES).agg(F.count("*").alias("w"))
    cells = written(cells.withColumn("gs", _levels()), "cells")
    pairs = cells.groupBy("lang", "source").agg(F.first("gs").alias("gs"))
    grouped = cells.select("w", *COORDINATES, F.explode("gs").alias("g")).groupBy("g", *COORDINATES).agg(F.sum("w").alias("w"))
    sizes = grouped.groupBy("g").agg(F.sum("w").alias("size")).where(F.col("size") >= LEAST)
    sizes = written(sizes, "sizes")
    few = sizes.count() <= FEW
    found = written(estimates(written(_met(grouped, sizes, few), "grouped"), few), "estimates")
    each = pairs.select("lang", "source", F.posexplode("gs").alias("level", "g"))
    each = _met(each, found, few)
    best = each.groupBy("lang", "source").agg(F.min_by(F.struct(*_FIT), "level").alias("fit"))
    return best.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "fit.*")


def quality(docs: DataFrame) -> DataFrame:
    """Base counts and verdicts of every row of `docs` (doc_id, text, lang, source).

    Words are runs of code points other than U+0020 and U+0009-U+000D. Returns doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance
    (null if no group has LEAST documents) and kept: neither base_failed nor an outlier.
    A null text is as an empty one; null languages and sources are groups of their own;
    repeated rows stay, and count each time; ties of distance lie in one shell and so are
    taken together; very long texts are read in full; other columns are ignored; an empty
    table gives no rows.
    """
    counts = written(base_counts(docs), "counts")
    fits = written(estimated(counts), "fits")
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    found = counts.select("*", *coordinates()).join(fits, same, "left")
    found = found.withColumn("d", F.round(_measured(found), 6))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        F.col("d").alias("distance"),
        (~base_failed() & (F.coalesce("d", F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
