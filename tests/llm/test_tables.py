"""URL filters, mixing and archives."""

import hashlib
import re

from pyspark.sql import functions as F

from pagestrata.llm import mixing, url_filter, warc
from pagestrata.llm.store import shared_folder

from .fixtures import empty, hard, hard_rows


def brute_verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(n + p), n + p, a) for a, n, p in rules if (host == n or host.endswith("." + n)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    parts = host.split(".")
    bad = bool(host) and any(".".join(parts[k:]) in listed for k in range(len(parts)))
    return host, path, None, "block" if bad else "allow"


URLS = [None, "", "no scheme", "http://", "http://a.com", "HTTP://WWW.Example.com/en/x?y", "x://example.com/en/", "https://a.b.net/es/1#f", "https://a.net/es?x",
        "ftp://spam-farm.example.org/q", "http://m.casino-win.example.net:80/", "http://notexample.com/en/", "a://b://c/d", "http://h?x://y", "http://e.com\n/z", "http://.net/fr/", "http://a..net/x"]


def test_verdicts(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(0, None, "x"), (None, "http://a.org", "x")]
    found = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, slots string")).collect()
    want = [(k, *brute_verdict(u, url_filter.RULES, url_filter.LISTED)) for k, u, _ in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_long_urls_and_clashing_names(spark):
    rows = [(1, "http://ads-track.example.com/" + "a" * 500_000, "h", "p", "r", "v"), (2, "http://" + "x." * 3000 + "spam-farm.example.net/", "h", "p", "r", "v")]
    docs = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")
    found = {r["page_id"]: r for r in url_filter.judged(docs).collect()}
    assert found[1]["verdict"] == "allow" and found[1]["rule"] == "com/" and len(found[1]["path"]) == 500_001
    assert found[2]["verdict"] == "block" and found[2]["rule"] is None


def test_full_filters_fail(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(url_filter, "MOST_BITS", 256)
    universe = spark.range(20_000).select(F.format_string("h%d.example", "id").alias("key"))
    with pytest.raises(RuntimeError, match="too many keys"):
        url_filter.cascade(universe, universe.where("key like '%1%'"))


def test_cascade_is_exact_and_needs_levels(spark):
    universe = spark.range(20_000).select(F.format_string("h%d.example", "id").alias("key"))
    listed = spark.range(0, 40_000, 3).select(F.format_string("h%d.example", "id").alias("key"))
    model = url_filter.cascade(universe, listed)
    assert len(model.levels) > 1
    rows = universe.select("key", model.slots(F.col("key")).alias("s")).toPandas()
    import numpy as np

    found = model.holds(np.array(rows["s"].tolist()))
    assert list(found) == [int(k[1:].split(".")[0]) % 3 == 0 for k in rows["key"]]


def test_mixing(spark):
    rows = [(k, "w " * (k % 50), f"s{k % 7}" if k % 7 else None) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(5)).collect()
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)
    size, target, taken = {}, {}, {}
    for r in found:
        assert r["size"] == r["doc_id"] % 50 and r["taken"] <= 3 * r["size"]
        s = r["source"]
        size[s], target[s] = r["source_size"], r["target"]
        taken[s] = taken.get(s, 0) + r["taken"]
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s in size:
        assert target[s] <= 3 * size[s] and abs(taken[s] - target[s]) <= 0.02 * target[s] + 20
    # order by code point, null last, weights 5, 2, 1 in turn
    order = sorted((s for s in size if s is not None)) + [None]
    level = max(target[s] / (5, 2, 1)[k % 3] for k, s in enumerate(order))
    assert all(abs(target[s] - min(3 * size[s], level * (5, 2, 1)[k % 3])) < 1e-6 * total for k, s in enumerate(order))


def test_sources_of_all_sizes_meet_their_targets(spark):
    sizes = {"a": 700_000, "b": 7, "c": 50, "d": 100, "e": 900_000, "f": 1000, "g": 50_000, "h": 400_000, "i": 1_500_000, "j": 900, "k": 1, "l": 2000}
    parts = [(s, n // 50, k) for s, n in sizes.items() for k in range(50)] + [(s, n % 50, 50) for s, n in sizes.items()]
    rows = [(f"{s}{k}", s, n) for s, n, k in parts]
    docs = spark.createDataFrame(rows, "doc_id string, source string, n long").select("doc_id", "source", F.repeat(F.lit("w "), F.col("n").cast("int")).alias("text"))
    target, taken = {}, {}
    for r in mixing.mixed(docs).collect():
        target[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert target["b"] == 21 and target["c"] == 150
    assert sum(taken.values()) == sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1 + 1e-6, s


def test_schedule_is_even(spark):
    rows = [(k, "w " * (20 + k % 50), f"s{k % 5}") for k in range(3000)]
    mix = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    share = {r["sid"]: r for r in mix.sources.collect()}
    order = [(r["sid"], r["rank"]) for r in mix.slots.orderBy("slot").collect()]
    n = len(order)
    assert n == sum(r["n_slots"] for r in share.values()) == len(set(order))
    for sid, s in share.items():
        assert sorted(r for k, r in order if k == sid) == list(range(s["n_slots"]))
        assert [r for k, r in order if k == sid] == list(range(s["n_slots"]))
        # in any run of 200 slots a source has its part, to a few slots
        at = [k == sid for k, _ in order]
        for start in range(0, n - 200, 37):
            assert abs(sum(at[start : start + 200]) - 200 * s["n_slots"] / n) < 6
    blocks = mix.pieces.groupBy("sid", "rank").agg(F.sum("words").alias("w")).groupBy("sid").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).collect()
    assert all(r["hi"] - r["lo"] <= 1 and r["hi"] <= mixing.BLOCK for r in blocks)


def test_golden_step():
    from math import gcd

    for n in (1, 2, 3, 4, 6, 10, 97, 1024, 10**6, 2**33):
        g = mixing.golden_step(n)
        assert gcd(g, n) == 1 and (n < 4 or abs(g / n - mixing.GOLDEN) < 0.25)


def test_mixing_of_hard_rows(spark):
    assert mixing.mixed(hard(spark)).count() == len(hard_rows()) and mixing.mixed(empty(spark)).count() == 0
    shares = mixing.with_shares(hard(spark))
    assert shares.count() == len(hard_rows())
    assert all(r["taken"] <= 3 * r["size"] for r in shares.collect())


def test_archive_round_trip(spark, tmp_path):
    big, other = "\u00e9" * 600, "<p>x</p>\r\n\r\n" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", big), (9, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "e", None), (6, "f", ""),
            (7, "g", other), (8, "h", "x" * 999), (None, "i", big), (10, "j", "y" * 1000), (10, "j", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    found = {(r["page_id"]): r for r in warc.archived(pages).collect()}
    assert warc.archived(pages).count() == len(rows)
    for k, _, html in rows:
        body = (html or "").encode()
        r = found[k]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        revisit = html == big and k != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
    folder = f"{shared_folder(spark)}/round-trip"
    warc.write_archive(pages, folder)
    assert warc.payloads(spark, folder).count() == len({(r[2] or "") for r in rows})
    records = warc.records(spark, folder)
    names, refers = [], set()
    for r in records.collect():
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\nX: y" not in head
        names.append(re.search(rb"WARC-Record-ID: (\S+)", head)[1])
        refers |= set(re.findall(rb"WARC-Refers-To: (\S+)", head))
        assert b":page:1:" not in names[-1] or b"WARC-Target-URI: http://a/%0D%0AX: y\r\n" in head
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[length:] == b"\r\n\r\n"
        if b"Type: response" in head:
            assert hashlib.sha1(body[:length]).hexdigest().encode() in head
    assert len(set(names)) == len(rows) and len(refers) == 1 and refers <= set(names)
    warc.as_files(records, str(tmp_path / "files"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert sorted(written) == sorted(b"".join(bytes(r["record"]) for r in records.collect()))
    assert warc.archived(pages.limit(0)).count() == 0
