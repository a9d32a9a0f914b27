"""Operators on single texts: quality, language, tokens, licenses, personal data."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagestrata.llm import language_id, licenses, pii, quality, token_counts
from pagestrata.llm.language_id import UNIT, code_lengths, train

from .fixtures import PROSE, empty, hard, hard_rows


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a ", "b ", "c", "\n", "\r\n", "\t", "#", "<", "\u00e9", "\U0001f600 ", "a b c "], k=rng.randint(0, 80))) for _ in range(300)]
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(1000 + k, r[1], r[2], r[3]) for k, r in enumerate(hard_rows())]
    found = {r[0]: tuple(r[3:]) for r in quality.base_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found == {i: brute_counts(t) for i, t, _, _ in rows}


def test_outliers_of_groups(spark):
    rng = random.Random(2)
    vocabulary = [PROSE.split()[k % 20] + str(k) for k in range(3000)]
    rows = []
    for k in range(600):
        n = rng.randint(100, 600)
        text = " ".join(rng.choices(vocabulary, k=n))
        if k % 30 == 0:
            text = " | ".join(text.split())
        elif k % 31 == 0:
            text = "\n".join(["the same line of words here again"] * 9 + [text])
        rows.append((k, text, rng.choice(["en", None]), rng.choice(["a", "b", None])))
    found = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    odd = {k for k in range(600) if k % 30 == 0 or k % 31 == 0}
    assert len(found) == 600
    assert all(not found[k]["kept"] for k in odd)
    assert sum(not found[k]["kept"] for k in found if k not in odd) <= 6


def cells_of(spark, groups):
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    names = ", ".join(f"{c} long" for c in quality.COORDINATES)
    cells = spark.createDataFrame(rows, f"g string, {names}").groupBy("g", *quality.COORDINATES).agg(F.count("*").alias("w"))
    return cells.join(cells.groupBy("g").agg(F.sum("w").alias("size")), "g")


def brute_mcd(x, starts=300, share=quality.SHARE):
    """The smallest determinant (ridge included) that many random starts lead to."""
    import numpy as np

    rng, best = np.random.default_rng(5), None
    h = -(-int(share * 100) * len(x) // 100)

    def fit(y, factor):
        return y.mean(0), np.cov(y.T, bias=True) * factor + np.diag(np.square(quality.RIDGE))

    for _ in range(starts):
        m, c = fit(x[rng.choice(len(x), 6, replace=False)], 1.0)
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            m, c = fit(x[np.argsort(d, kind="stable")[:h]], quality.FACTOR)
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c
    return best


def test_estimates_are_those_of_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    mix = rng.normal(size=(5, 5)) * 6
    groups = {
        "plain": rng.normal(size=(400, 5)) @ mix + 200,
        "cluster": np.concatenate([rng.normal(size=(400, 5)) * 12 + 200, rng.normal(size=(90, 5)) * 2 + 330]),
        "spread": np.concatenate([rng.normal(size=(300, 5)) @ mix + 200, rng.normal(size=(60, 5)) * 300 + 900]),
    }
    groups = {g: np.maximum(np.round(x), 0) for g, x in groups.items()}
    for r in quality.estimates(cells_of(spark, groups)).collect():
        x = groups[r["g"]]
        least, m, c = brute_mcd(x)
        low = np.zeros((5, 5))
        for i, j in quality._PAIRS:
            low[i, j] = r[f"l_{i}_{j}"]
        # a shell more than share of the weight, so a slightly larger determinant at most
        assert 0.9 * least <= np.prod(np.diag(low)) ** 2 <= 1.25 * least, r["g"]
        d = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        ours = d(np.array([r[f"m_{i}"] for i in range(5)]), low @ low.T)
        far = (ours > quality.CUTOFF) != (d(m, c) > quality.CUTOFF)
        assert far.mean() < 0.01 and np.median(abs(ours / d(m, c) - 1)) < 0.1


def test_several_starts_matter(spark):
    import numpy as np

    # a tight cluster of a fifth draws the mean and covariance of all, and not the medians
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(size=(400, 5)) * 10 + 200, rng.normal(size=(100, 5)) + 260]))
    r = quality.estimates(cells_of(spark, {"g": x})).first()
    assert all(abs(r[f"m_{i}"] - 200) < 5 for i in range(5))


def test_consistency_factor():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(400_000, 5))
    inner = x[np.argsort((x**2).sum(1))[: int(quality.SHARE * len(x))]]
    assert inner.var(0).mean() * quality.FACTOR == pytest.approx(1, abs=0.01)
    assert quality.chi_square(quality.CUTOFF, 5) == pytest.approx(1 - 1e-6, abs=2e-7)


def test_quality_of_hard_rows(spark):
    assert quality.quality(hard(spark)).count() == len(hard_rows())
    assert quality.quality(empty(spark)).count() == 0


def brute_code_length(texts, known, text, order=3):
    follow = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        b = [-1] * order + list(t.encode())
        for i in range(order, len(b)):
            for k in range(order + 1):
                follow[k][tuple(b[i - k : i])][b[i]] += 1
    b, total = [-1] * order + list(text.encode()), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            # bytes that training has not met stand like the beginning of the text
            c = follow[k].get(tuple(x if x in known else -1 for x in b[i - k : i]))
            if not c:
                continue
            n, kinds = sum(c.values()), len(c)
            if c[b[i]]:
                total += math.log2((n + kinds) / c[b[i]])
                break
            total += math.log2((n + kinds) / kinds)
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_trees():
    texts = {"en": ["the cat sat on the mat", "a hat"], "de": ["die katze", "der hut sitzt"]}
    model = train(texts)
    known = {x for ts in texts.values() for t in ts for x in t.encode()}
    asked = ["", "the", "die der", "cat the hat on", "the mat sat " * 50]
    found = code_lengths(model, pa.array(asked)) / UNIT
    for text, row in zip(asked, found):
        for lang, bits in zip(model.languages, row):
            assert bits == pytest.approx(brute_code_length(texts[lang], known, text), abs=len(text) / UNIT + 1e-9)
    # sums do not depend on what else is in the batch
    assert (code_lengths(model, pa.array(asked[::-1]))[::-1] == code_lengths(model, pa.array(asked))).all()


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right > 0.99


def test_many_languages(spark):
    rng = random.Random(7)
    made = {}
    for k in range(100):
        made[f"l{k:03}"] = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(40)]
    rows = [(f"{lang}-{k}", " ".join(rng.choices(own, k=60)), lang) for lang, own in made.items() for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language_id.learned(docs.where(~language_id.held_out()))
    assert model.languages == sorted(made) and model.order == 3
    found = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and all(r["lang_pred"] == r["lang"] for r in found)


def test_the_sample_is_bounded_and_the_same_again(spark):
    rows = [(k % 50, f"text {k % 70} of many words here", "en") for k in range(3000)] + [(7, "x" * 90_000, "en"), (8, "ein Text", "de")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language_id.sample(docs, per_language=20, most_bytes=10_000)
    again = language_id.sample(docs.repartition(7), per_language=20, most_bytes=10_000)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    counts = Counter(r["lang"] for r in chosen.collect())
    assert counts["de"] == 1 and 0 < counts["en"] <= 20
    few = language_id.sample(docs, per_language=20, most_bytes=100).where("lang = 'en'").collect()
    assert 1 <= len(few) <= 5


def test_pieces_of_a_long_text_cost_what_the_whole_does(monkeypatch):
    model = train({"en": [PROSE], "de": ["der hund und die katze sitzen"]})
    column = pa.array([PROSE * 7, "", None, "die katze", PROSE])
    whole = code_lengths(model, column)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 37)
    assert (code_lengths(model, column) == whole).all() and (whole[1:3] == 0).all()


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = [(-1, "\u042d\u0442\u043e \u043f\u0440\u0435\u0434\u043b\u043e\u0436\u0435\u043d\u0438\u0435 \u043e \u0434\u043e\u043c\u0435 \u0443 \u043c\u043e\u0440\u044f " * 3, None), (-2, "xq zzkw pqj vvx qqj wkz jxq zpq kkw vjq xzz qwk pzj " * 3, None)]
    kept = language_id.recognised(docs.union(spark.createDataFrame(other, docs.schema))).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}


def test_languages_of_hard_rows(spark):
    found = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language_id.languages(hard(spark)).collect()}
    assert len(language_id.languages(hard(spark)).collect()) == len(hard_rows())
    assert found[1] == found[2] == found[3] == found[12] == ("und", 0.0)
    assert found[11][0] != "und" and all(0 <= s <= 1 for _, s in found.values())
    assert language_id.languages(empty(spark)).count() == 0
    kept = language_id.recognised(hard(spark))
    assert kept.columns == hard(spark).columns and {1, 2, 3, 12}.isdisjoint({r["doc_id"] for r in kept.collect()})
    unlabelled = hard(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.languages(unlabelled).collect()} == {"und"}


def test_token_histogram(spark):
    rows = [(k, t) for k, t in enumerate(["", None, "a", "a b", "a b", "hello <|endoftext|> world", PROSE, PROSE * 40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    lengths = sorted(len(own.encode_ordinary(t or "")) for _, t in rows)
    assert sorted(r["n_tokens"] for r in token_counts.encoded_lengths(docs).collect()) == lengths
    found = token_counts.token_histogram(docs)
    for r in found.collect():
        at = r["length"]
        assert r["n_docs"] == lengths.count(at) and r["n_tokens"] == at * lengths.count(at)
        assert r["docs_at_most"] == sum(x <= at for x in lengths) and r["docs_at_least"] == sum(x >= at for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= at) and r["truncated_tokens"] == sum(min(x, at) for x in lengths)
        assert r["percent"] == 100 * sum(x <= at for x in lengths) // len(lengths)
    for limit in (0, 1, 3, 10, max(lengths), max(lengths) + 5):
        assert token_counts.truncated_total(found, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.truncated_total(token_counts.token_histogram(empty(spark)), 5) == 0
    assert {r["share"]: r["length"] for r in token_counts.quantiles(found, [0.5, 1.0]).collect()} == {0.5: lengths[3], 1.0: lengths[-1]}
    assert token_counts.token_histogram(empty(spark)).count() == 0
    assert token_counts.token_histogram(hard(spark)).agg(F.sum("n_docs")).first()[0] == len(hard_rows())


def brute_licenses(text):
    def cut(t):
        low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", low)
        return [tuple(w[k : k + 2]) for k in range(len(w) - 1)]

    out, runs = [], cut(text)
    for name, template in licenses.TEMPLATES:
        want, n = set(cut(template)), len(cut(template))
        best = None
        for p in range(max(1, len(runs) - n + 1)):
            share = len(want & set(runs[p : p + n])) / len(want)
            if share >= licenses.CONTAINED and (best is None or share > best[1]):
                best = (p, share)
        if best:
            out.append((name, *best))
    return sorted(out)


def test_licenses(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        filler = rng.choices(PROSE.split() + ["license", "under", "the", "public", "Licensed"], k=rng.randint(0, 30))
        notice = rng.choice(licenses.TEMPLATES)[1].split()
        if rng.random() < 0.3:
            notice[rng.randrange(len(notice))] = "zzz"
        at = rng.randint(0, len(filler))
        texts.append(" ".join(filler[:at] + notice + filler[at:]) if rng.random() < 0.8 else " ".join(filler))
    rows = [(k, t) for k, t in enumerate(texts)]
    found = defaultdict(list)
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].append((r["license"], r["at_word"], r["containment"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: b for k, t in rows if (b := brute_licenses(t))}
    assert licenses.license_scan(hard(spark)).count() == 0 and licenses.license_scan(empty(spark)).count() == 0
    assert licenses.miss_probability(2 / 3) < 1e-5


def test_license_texts(spark):
    mit = "Copyright 2020 X. " + next(x for n, x in licenses.TEMPLATES if n == "MIT" and "hereby" in x) + " THE SOFTWARE IS PROVIDED AS IS"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    isc = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    bsd = dict(licenses.TEMPLATES)["BSD-3-Clause"]
    rows = [(1, PROSE + mit), (2, mpl), (3, isc), (4, bsd), (5, PROSE)]
    found = {(r["doc_id"], r["license"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found - {(4, "BSD-2-Clause")} == {(1, "MIT"), (2, "MPL-2.0"), (3, "ISC"), (4, "BSD-3-Clause")}


def brute_force_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def brute_force_added(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9+.-]{1,32}://([^\x00-\x20\x7f<>\"'`{}|\\^\u00a0]+)", text):
        if "@" in re.split("[/?#]", m[1])[0]:
            found.append(("url", *m.span()))
    cues = {f for c in pii.CUES for f in (c, c.upper(), c.title())}
    cue = "|".join(sorted(map(re.escape, cues), key=len, reverse=True))
    iban = r"[ :=#]{0,3}(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    for m in re.finditer(rf"""(?<![^\W])(?:(?:iban|IBAN|Iban){iban}|(?:{cue}) ?[=:#] ?["']?(?P<value>[A-Za-z0-9_+/.-]{{6,}}))""", text):
        if m["iban"]:
            raw = m["iban"].replace(" ", "")
            digits = "".join(str(int(c, 36)) for c in raw[4:] + raw[:4])
            if len(raw) >= 15 and int(digits) % 97 == 1:
                found.append(("account", *m.span("iban")))
        elif re.search("[0-9]", m["value"]):
            found.append(("account", *m.span("value")))
    return found


def digest_of(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


PIECES = ["token", "Token", "iban", "IBAN", "api_key", "ssn", "password", "x", "_", " ", "=", ":", "#", '"', "abc123", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB00WEST12345698765432", "12345678", "http", "://", "bob", "@", "/", "?", "host.org", "<", "-", "\u00e9"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_added_spans_equal_pattern_search(text):
    found = [s for s in pii.find_spans(text, pii._automaton()) if s[0] not in pii.BASE_KINDS]
    assert found == brute_force_added(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@+-0123456789 ()_%:\u00e9\n", max_size=60))
def test_base_spans_equal_pattern_search(text):
    found = [s for s in pii.find_spans(text, pii._automaton()) if s[0] in pii.BASE_KINDS]
    assert found == brute_force_base(text)


def test_added_spans_and_masks():
    text = 'token = "04dbebab91ab" at ftp://bob:pw@host/x, IBAN: GB82 WEST 1234 5698 7654 32; a@b.co 10.0.0.1 +1 (017) 555-7713'
    spans = pii.find_spans(text, pii._automaton())
    assert [text[a:b] for k, a, b in spans if k == "account"] == ["04dbebab91ab", "GB82 WEST 1234 5698 7654 32"]
    assert [text[a:b] for k, a, b in spans if k == "url"] == ["ftp://bob:pw@host/x,"]
    assert pii.mask(text, spans) == 'token = "<ACCOUNT>" at <URL> IBAN: <ACCOUNT>; <EMAIL> <IP> <PHONE>'
    for run in ("a" * 10**6, "1" * 10**6, "a@" * 10**5, "+1" + " " * 10**6):
        assert pii.find_spans(run, pii._automaton()) == []


def test_personal_data_of_tables(spark):
    rows = [(1, "\u00e9 a@b.co 4111 1111 1111 1111"), (2, None), (3, ""), (1, "x")]
    found = sorted(map(tuple, pii.span_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    spans = [("email", 2, 8), ("card", 9, 28)]
    assert (1, 1, 0, 1, 0, digest_of(spans), "email:2:8,card:9:28", 2) in found and len(found) == 4
    masked = pii.redacted(hard(spark))
    assert masked.schema == hard(spark).schema and masked.count() == len(hard_rows())
    assert pii.span_digest(empty(spark)).count() == 0
    # a row each, nulls and repeats included, whatever other columns are called
    again = pii.span_digest(hard(spark)).collect()
    assert Counter(r["doc_id"] for r in again) == Counter(r[0] for r in hard_rows()) and {r["n_spans"] for r in again} == {0}


def test_personal_data_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = pii.span_digest(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        base, added = brute_force_base(texts[r["doc_id"]]), brute_force_added(texts[r["doc_id"]])
        assert r["base_sha256"] == digest_of(base) and r["n_spans"] == len(base) + len(added)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base + added)
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]


def test_spans_equal_sql():
    """The parsers against the SQL's patterns over texts mixed from anchors, values and breaks."""
    import duckdb

    from pagestrata.llm.oracles import ORACLE_SQL

    bits = (
        ["token", "Token", "IBAN", "iban", "user_id", "social security", "=", ":", "#", "'", '"', "abc123x", "secret9/", "DE89370400440532013000"]
        + ["GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "10.0.0.1"]
        + ["300.1.1.1", "001.02.3.0004", "1.2.3.4.5.6.7.8", "a.b@c.de", "x@y", "a@b.c@d.e", "http://u:p@host/x", "ftp://h/@", "://", "https://a@b c"]
        + ["\u00e9", "\u4e2d", "\U0001f600", "_", "/", ".", "-", "+", "@", "0000000000000", "\n", "12", "9"]
    )
    rng = random.Random(5)
    texts = [None, ""] + ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    automaton = pii._automaton()
    found = con.execute(f"SELECT doc_id, spans, n_spans FROM ({ORACLE_SQL['op10_pii']}) ORDER BY doc_id").fetchall()
    assert len(found) == len(texts) and {s.split(":")[0] for r in found for s in r[1].split(",") if s} == set(pii.KINDS)
    for k, listed, n in found:
        spans = pii.find_spans(texts[k] or "", automaton)
        assert (listed, n) == (",".join(f"{kind}:{a}:{b}" for kind, a, b in spans), len(spans))
