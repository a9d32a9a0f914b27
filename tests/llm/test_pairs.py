"""The n-gram join, components and decontamination against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pagestrata.llm import decontamination, ngram_join
from pagestrata.llm.components import components
from pagestrata.llm.ngram_join import CountTree, Sets, group_counts, joined, may_link, needed, ngram_components

from .fixtures import empty, hard, hard_rows

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k)) if s else i)) for k, (i, s) in enumerate(sets))


def near_copies(seed, groups=12, most=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300]))
        for _ in range(rng.randint(1, most)):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.005, 0.02, 0.04]) else w for w in base]
            rows.append(text + passage if rng.random() < 0.5 else text)
    rng.shuffle(rows)
    return [(k, " ".join(t)) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 7])
def test_components_equal_brute_force(spark, block):
    rows = near_copies(5)
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components(rows)


def test_components_of_hard_rows(spark):
    found = ngram_components(hard(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components([r[:2] for r in hard_rows()])
    kept = ngram_join.keep_first(hard(spark))
    assert kept.columns == hard(spark).columns
    # equal sets leave their smallest doc_id (7 and a null id repeat 4)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 8, 10, 11, 12, 13]))


def test_rows_with_the_same_id_are_judged_apart(spark):
    one, two, item = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(1, one), (1, one), (1, two), (2, one + " end"), (3, item), (3, two + " end"), (None, one), (None, "alone"), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (1, two), (3, item), (None, "alone"), (4, ""), (4, "")], key=str)
    swapped = docs.select("text", "doc_id")
    kept = decontamination.clean(swapped, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == ["text", "doc_id"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((r for r in rows if r[1] != item), key=str)


def test_sets_with_a_common_hash_stay_apart(spark, monkeypatch):
    plain = ngram_join.fingerprints
    monkeypatch.setattr(ngram_join, "fingerprints", lambda found: (plain(found)[0] % 7, plain(found)[1]) if len(found) else (0, 0))
    rows = near_copies(8, groups=6, most=8)
    members = spark.createDataFrame([(k, len(s), *ngram_join.fingerprints(s)) for k, s in enumerate(ngram_join.shingle_sets(pa.array([t for _, t in rows])))], "doc_id long, n long, fp long, fp2 long")
    clashes = ngram_join._clashes(members)
    assert clashes and clashes <= set(range(7))
    names, sets = ngram_join.Names(clashes), list(ngram_join.shingle_sets(pa.array([t for _, t in rows])))
    assert len({names.of(s) for s in sets}) == len({tuple(s) for s in sets})


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rows = near_copies(6, groups=5)
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.BLOCK).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components(rows)


def test_no_rows(spark):
    assert ngram_components(empty(spark)).count() == 0
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(empty(spark), benchmark).count() == 0


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(30, 60)).astype(np.uint64) * np.uint64(2)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.05], rng.integers(0, 1 << 63, 2).astype(np.uint64)])) for s in sets[:80]]
    counts, sizes = [group_counts(s) for s in sets], np.array([len(s) for s in sets])
    bits = min(len(c) for c in counts).bit_length() - 1
    points = np.stack([ngram_join.fold(c, bits) for c in counts])
    tree = CountTree(points, sizes)
    for i in range(len(sets)):
        want = {j for j in range(len(sets)) if 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and np.minimum(points[i], points[j]).sum() >= needed(sizes[i], sizes[j])}
        assert set(tree.search(points[i], int(sizes[i]))) == want

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)

    found, plain = Sets(len(sets)), Sets(len(sets))
    joined(sizes, counts, found, linked)
    for i, j in combinations(range(len(sets)), 2):
        if linked(i, j):
            assert may_link(int(sizes[i]), counts[i], int(sizes[j]), counts[j])
            plain.join(i, j)
    assert [found.root(k) for k in range(len(sets))] == [plain.root(k) for k in range(len(sets))]


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def folded(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower().replace("\u00df", "ss").replace("\u03c2", "\u03c3"))


def brute_overlaps(docs, items):
    out = {}
    for i, text in docs:
        d = folded(text)
        for k, item in items:
            b = folded(item)
            best, at = 0, {}
            for q, w in enumerate(b):
                at.setdefault(w, []).append(q)
            if 1 <= len(b) < 20:
                shifts = Counter(p - q for p, w in enumerate(d) for q in at.get(w, ()))
                best = max(shifts.values(), default=0)
                best = best if 20 * best >= 17 * len(b) else 0
            elif len(b) >= 20:
                shifts = Counter(p - q for p, w in enumerate(d) for q in at.get(w, ()))
                for shift in (s for s, n in shifts.items() if n >= 17):
                    same = [0 <= p < len(d) and d[p] == b[p - shift] for p in range(shift, shift + len(b))]
                    best = max([best, *(sum(same[q : q + 20]) for q in range(len(same)))])
                best = best if best >= 17 else 0
            if best:
                out[str((i, k))] = best
    return out


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_SEEDS, 0])
def test_overlaps_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 9, 19, 20, 30])))) for k in range(14)] + [(90, None), (91, ""), (3, "A B c D e")]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        part = words(rng.choice(items)[1])
        part = part[rng.randint(0, 6) :] if rng.random() < 0.4 else part
        part = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in part]
        at = rng.randint(0, len(text))
        docs.append((k, " ".join(text[:at] + part + text[at:])))
    docs += [(70, "x a b C d E y"), (None, items[5][1]), (71, None), (5, docs[5][1])]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {str((r["doc_id"], r["item_id"])): r["n_match"] for r in found} == brute_overlaps(docs, items)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})


def test_many_seeds(spark):
    # more seeds than are broadcast: a million items of a word each, and real ones
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(10, 200)))) for k in range(300)]
    items = [(k, " ".join(texts[k][1].split()[:25])) for k in range(0, 300, 7)]
    rows = spark.createDataFrame(items, "item_id long, text string").union(spark.range(1_000, 2_001_000).selectExpr("id", "concat('no', id)"))
    docs = spark.createDataFrame([*texts, (None, texts[7][1])], "doc_id long, text string")
    found = decontamination.contaminated(docs, rows).collect()
    want = brute_overlaps([*texts, (None, texts[7][1])], items)
    assert {str((r["doc_id"], r["item_id"])): r["n_match"] for r in found} == want


def test_very_long_text_is_searched_to_its_end(spark):
    item = " ".join(f"b{k}" for k in range(24))
    docs = spark.createDataFrame([(1, "x y z " * 200_000 + item), (2, "x " * 10)], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert [tuple(r) for r in found.collect()] == [(1, 5, 20)]


def test_seeds_are_lossless():
    assert decontamination.lossless()
    assert not decontamination.lossless(decontamination.MASKS[:1])


def test_clean_keeps_the_rest(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    kept = decontamination.clean(hard(spark), benchmark)
    assert kept.columns == hard(spark).columns and kept.count() == hard(spark).count()
    assert decontamination.clean(hard(spark), benchmark.limit(0)).count() == hard(spark).count()


def test_short_items_lose_a_few_words(spark):
    rng = random.Random(4)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 20)]
    docs, want = [], {}
    for n, item in items:
        for bad in range(4):
            for at in range(6):
                part = item.split()
                for k in rng.sample(range(n), min(bad, n)):
                    part[k] += "|#"
                docs.append((len(docs), " ".join(["x"] * at + part + ["y"] * (at % 2))))
                if 20 * (n - bad) >= 17 * n:
                    want[len(docs) - 1, n] = n - bad
    docs.append((len(docs), items[17][1].rsplit(" ", 1)[0]))
    want[len(docs) - 1, 18] = 17
    texts, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(texts, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_match"] for r in found} == want
    kept = {r["doc_id"] for r in decontamination.clean(texts, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_pieces_are_lossless():
    for n in range(1, 20):
        size, places = decontamination.pieces(n)
        runs = [set(range(j, j + size)) for j in places]
        assert size >= 1 and max(map(max, runs)) < n and sum(map(len, runs)) == len(set.union(*runs))
        assert len(runs) == n - decontamination.least_equal(n) + 1


def test_capitals_beyond_ascii(spark):
    item = "\u00fcber die stra\u00dfe ging \u00e9t\u00e9 ma\u00f1ana gr\u00f6\u00dfer w\u00e4re f\u00fcr \u00e0 o\u00f9 sch\u00f6n \u03bf\u03b4\u03cc\u03c2 \u043c\u0438\u0440 a b c d e f"
    texts = spark.createDataFrame([(1, item.upper()), (2, item), (3, "x " + item.title()), (4, "another text")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "\u00dcBER DIE STRASSE")], "item_id long, text string")
    found = decontamination.contaminated(texts, benchmark).collect()
    n = len(item.split())
    assert n == 20 and {(r["doc_id"], r["item_id"]): r["n_match"] for r in found} == {(d, k): (n, 3)[k - 1] for d in (1, 2, 3) for k in (1, 2)}
    assert [r["doc_id"] for r in decontamination.clean(texts, benchmark).collect()] == [4]
