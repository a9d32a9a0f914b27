"""DuckDB SQL for the queries that SQL can express; each is written apart from the Spark code."""

from __future__ import annotations

from .pii import CUES

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
)

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""

_FOLDED = (
    "list_filter(string_split_regex(replace(replace(lower(coalesce(text, '')), chr(223), 'ss'), chr(962), chr(963)), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
)

# diagonals with enough equal pairs; items shorter than 20 words may lose 3 in 20
OP2 = f"""
WITH d AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT doc_id, {_FOLDED} AS w FROM documents)),
it AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
b AS (SELECT item_id, len(w) AS n, generate_subscripts(w, 1) AS j, unnest(w) AS x FROM it),
m AS (SELECT doc_id, item_id, n, i - j AS diagonal, list_sort(list(j)) AS p FROM d JOIN b USING (x) GROUP BY ALL HAVING 20 * count(*) >= 17 * least(n, 20)),
c AS (SELECT doc_id, item_id, n, CASE WHEN n < 20 THEN len(p) ELSE
  list_max(list_transform(p, lambda a: len(list_filter(p, lambda q: q >= a AND q <= a + 19)))) END AS k FROM m)
SELECT doc_id, item_id, max(k) AS n_match FROM c WHERE 20 * k >= 17 * least(n, 20) GROUP BY 1, 2
"""

# the contract: quotas are targets rounded by largest remainders, and a source's words in
# shuffled order are taken from the first on, as often round as its quota asks
OP8 = """
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
wt AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 3.0::DOUBLE * source_size AS cap,
       sum(source_size) OVER () AS total FROM src),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM wt),
tg AS (SELECT *, least(cap, max(lev) OVER () * w) AS target FROM lv),
dn AS (SELECT *, floor(target + 1e-6)::BIGINT AS down FROM tg),
rk AS (SELECT *, total - sum(down) OVER () AS rest, row_number() OVER (ORDER BY round(target - down, 6) DESC, sid) AS nth FROM dn),
q AS (SELECT *, least(down + CASE WHEN nth <= rest THEN 1 ELSE 0 END, 3 * source_size)::BIGINT AS quota FROM rk),
laid AS (SELECT s.doc_id, s.size, q.*, sum(s.size) OVER (PARTITION BY q.sid ORDER BY md5(s.doc_id::VARCHAR), s.doc_id) - s.size AS first
         FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + least(size, greatest(0, quota % source_size - first)) END::BIGINT AS taken
FROM laid
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS lead FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> lead THEN lead END AS refers_to
FROM f
"""


def _op3() -> str:
    """Counts and estimates document by document; every concentration step is spelled out.

    1.4120... is 0.75 over the chi-square (7 degrees) share within the 0.75 quantile of 5.
    """
    p = range(1, 6)
    pairs = [(i, j) for i in p for j in p if j <= i]
    ridge = (6.25, 0.64, 25.0, 25.0, 25.0)
    xs = ", ".join(f"x{i}" for i in p)

    def factor() -> str:
        """Cholesky by columns; each alias may use those before it."""
        out = []
        for j in p:
            inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
            out.append(f"sqrt(greatest(c{j}{j}{inner}, {ridge[j - 1] / 100}::DOUBLE)) AS l{j}{j}")
            out += [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(1, j))}) / l{j}{j} AS l{i}{j}" for i in p if i > j]
        return ", ".join(out)

    def ridged(i: int, j: int) -> str:
        return f" + {ridge[i - 1]}::DOUBLE" if i == j else ""

    def estimate(scale: str) -> str:
        means = ", ".join(f"s{i} / n::DOUBLE AS m{i}" for i in p)
        cov = ", ".join(f"(q{i}{j}::DOUBLE - s{i}::DOUBLE * s{j} / n) / n * {scale}::DOUBLE{ridged(i, j)} AS c{i}{j}" for i, j in pairs)
        return f"{means}, {cov}, {factor()}"

    sums = f"{', '.join(f'sum(x{i}) AS s{i}' for i in p)}, {', '.join(f'sum(x{i} * x{j}) AS q{i}{j}' for i, j in pairs)}"
    fit = f"{', '.join(f'm{i}' for i in p)}, {', '.join(f'l{i}{j}' for i, j in pairs)}"
    z = ", ".join(f"(x{i} - m{i} - ({' + '.join(['0.0::DOUBLE', *(f'l{i}{k} * z{k}' for k in range(1, i))])})) / l{i}{i} AS z{i}" for i in p)
    squared = " + ".join(f"z{i} * z{i}" for i in p)
    sign = ", ".join(f"sum(round(z{i} * z{j} / greatest({squared}, 1e-12::DOUBLE) * 1000000)::BIGINT) AS q{i}{j}" for i, j in pairs)
    flat = ", ".join(f"r{i} AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in pairs)
    signed = ", ".join(f"q{i}{j} / 1000000::DOUBLE / n * 5 * r{i} * r{j}{ridged(i, j)} AS c{i}{j}" for i, j in pairs)
    steps = []
    for k in range(12):
        steps.append(f"""
b{k} AS MATERIALIZED (SELECT g, start, shell, max(size) AS size, count(*) AS n, {sums} FROM (SELECT v.*, start, {z}, least(floor(sqrt({squared}) * 64), 4095)::INT AS shell FROM v JOIN f{k} USING (g)) GROUP BY g, start, shell),
i{k} AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY shell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b{k}) WHERE before < 0.75::DOUBLE * size),
f{k + 1} AS MATERIALIZED (SELECT g, start, {estimate('1.41207106018905')} FROM (SELECT g, start, sum(n) AS n, {', '.join(f'sum(s{i}) AS s{i}' for i in p)}, {', '.join(f'sum(q{i}{j}) AS q{i}{j}' for i, j in pairs)} FROM i{k} GROUP BY g, start))""")
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
x AS (SELECT *, least(round(ln(1 + n_words) / 2 * 10), 10000)::BIGINT AS x1, least(round(word_chars / greatest(n_words, 1)::DOUBLE * 10), 10000)::BIGINT AS x2,
  least(round(ln(1 + 200.0::DOUBLE * n_symbols / greatest(word_chars, 1)) * 10), 10000)::BIGINT AS x3, least(round(ln(1 + n_dup_lines) * 10), 10000)::BIGINT AS x4,
  least(round(ln(1 + 20.0::DOUBLE * n_repeat_words / greatest(n_words, 1)) * 10), 10000)::BIGINT AS x5 FROM b),
g AS (SELECT doc_id, {xs}, 0 AS level, {{'k': 0, 'lang': lang, 'source': source}} AS g FROM x UNION ALL SELECT doc_id, {xs}, 1, {{'k': 1, 'lang': lang, 'source': NULL}} FROM x
  UNION ALL SELECT doc_id, {xs}, 2, {{'k': 2, 'lang': NULL, 'source': NULL}} FROM x),
v AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM g) WHERE size >= 100),
mid AS (SELECT g, {', '.join(f'quantile_cont(x{i}, 0.5) AS m{i}' for i in p)} FROM v GROUP BY g),
dev AS (SELECT g, {', '.join(f'm{i}' for i in p)}, {', '.join(f'sqrt(pow(1.4826::DOUBLE * a{i}, 2) + {ridge[i - 1]}::DOUBLE) AS r{i}' for i in p)} FROM
  (SELECT v.g, {', '.join(f'any_value(m{i}) AS m{i}, quantile_cont(abs(x{i} - m{i}), 0.5) AS a{i}' for i in p)} FROM v JOIN mid USING (g) GROUP BY v.g)),
sg AS (SELECT g, count(*) AS n, {', '.join(f'any_value(m{i}) AS m{i}, any_value(r{i}) AS r{i}' for i in p)}, {sign} FROM (SELECT *, {', '.join(f'(x{i} - m{i}) / r{i} AS z{i}' for i in p)} FROM v JOIN dev USING (g)) GROUP BY g),
f0 AS MATERIALIZED (SELECT g, 0 AS start, {', '.join(f'm{i}' for i in p)}, {flat} FROM dev
  UNION ALL SELECT g, 1, {fit} FROM (SELECT g, {estimate('1.0')} FROM (SELECT g, count(*) AS n, {sums} FROM v GROUP BY g))
  UNION ALL SELECT g, 2, {fit} FROM (SELECT g, {', '.join(f'm{i}' for i in p)}, {factor()} FROM (SELECT *, {signed} FROM sg))),
{', '.join(steps)},
best AS (SELECT g, {fit} FROM f12 QUALIFY row_number() OVER (PARTITION BY g ORDER BY {' * '.join(f'(l{i}{i} * l{i}{i})' for i in p)}, start) = 1),
dist AS (SELECT doc_id, level, {z}, round({squared}, 6) AS d FROM v JOIN best USING (g)),
last AS (SELECT doc_id, arg_min(d, level) AS d FROM dist GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(d, 0) <= 36 AS kept FROM b LEFT JOIN last USING (doc_id)
"""


OP3 = _op3()

_PLAIN = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents WHERE text IS NOT NULL),
n(license, t) AS (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('MIT', 'Released under the MIT License.')),
k AS (SELECT license, {_PLAIN.format('t')} AS w FROM n),
p AS (SELECT license, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS s FROM k),
r AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS r FROM d),
c AS (SELECT doc_id, license, r, s, unnest(range(1, greatest(len(r) - len(s), 0) + 2)) AS o FROM r JOIN p ON len(list_intersect(r, s)) >= 0.8 * len(list_distinct(s))),
h AS (SELECT doc_id, license, o - 1 AS at_word, len(list_intersect(s, r[o:o + len(s) - 1])) / len(list_distinct(s))::DOUBLE AS containment FROM c)
SELECT doc_id, license, at_word, containment FROM h WHERE containment >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, at_word) = 1
"""

OP7 = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, name, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(name || start, len(name || start)) AS rule, arg_max(action, len(name || start)) AS action
        FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id),
k(d) AS (SELECT a || '.example.' || b FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(a), (VALUES ('com'), ('net'), ('org')) y(b))
SELECT h.page_id, host, path, rule,
  CASE WHEN action IS NOT NULL THEN action WHEN EXISTS (SELECT 1 FROM k WHERE host = d OR ends_with(host, '.' || d)) THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN fit ON fit.page_id = h.page_id
"""

# CRC-32 of the digits of doc_id, bit by bit
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: "
    "list_reduce(list_prepend(xor(r, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"
)


def _op4() -> str:
    """Byte trees as tables: g3 is a byte with the three before it, in hexadecimal."""
    orders = range(4)
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, substr(g, {7 - 2 * k}) AS g, n FROM seen" for k in orders)
    direct = " ".join(f"LEFT JOIN direct d{k} ON d{k}.lang = l.lang AND d{k}.k = {k} AND d{k}.g = substr(c.g, {7 - 2 * k})" for k in orders)
    leave = " ".join(f"LEFT JOIN leave e{k} ON e{k}.lang = l.lang AND e{k}.k = {k} AND e{k}.c = substr(c.g, {7 - 2 * k}, {2 * k})" for k in orders)
    cost = "524288"
    for k in orders:
        cost = f"coalesce(d{k}.cost, coalesce(e{k}.cost, 0) + {cost})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS u, doc_id, lang, text, coalesce({_CRC} % 4 = 2, false) AS held_out FROM documents),
drawn AS (SELECT DISTINCT lang, doc_id, text, md5(coalesce(doc_id::VARCHAR, '') || '|' || text) AS h FROM docs
  WHERE NOT held_out AND text IS NOT NULL AND lang IS NOT NULL AND octet_length(encode(text)) <= 4000000),
learned AS (SELECT lang, text FROM (SELECT *, row_number() OVER w AS nth, coalesce(sum(octet_length(encode(text))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn WINDOW w AS (PARTITION BY lang ORDER BY h, doc_id, text)) WHERE nth <= 500 AND before < 4000000),
seen AS MATERIALIZED (SELECT lang, substr(x, 2 * i + 1, 8) AS g, count(*) AS n FROM (SELECT lang, '000000' || hex(encode(text)) AS x, unnest(range(octet_length(encode(text)))) AS i FROM learned) GROUP BY ALL),
gram AS (SELECT lang, k, g, sum(n) AS n FROM ({grams}) GROUP BY ALL),
context AS (SELECT lang, k, left(g, 2 * k) AS c, sum(n)::DOUBLE AS total, count(*) AS kinds FROM gram GROUP BY ALL),
direct AS MATERIALIZED (SELECT g.lang, g.k, g, round(log2((total + kinds) / n) * 65536)::BIGINT AS cost FROM gram g JOIN context x ON x.lang = g.lang AND x.k = g.k AND x.c = left(g.g, 2 * g.k)),
leave AS MATERIALIZED (SELECT lang, k, c, round(log2((total + kinds) / kinds) * 65536)::BIGINT AS cost FROM context),
asked AS MATERIALIZED (SELECT u, substr(x, 2 * i + 1, 8) AS g, count(*) AS n FROM (SELECT u, '000000' || hex(encode(text)) AS x, unnest(range(octet_length(encode(text)))) AS i FROM docs) GROUP BY ALL),
priced AS MATERIALIZED (SELECT l.lang, c.g, {cost} AS cost FROM (SELECT DISTINCT g FROM asked) c CROSS JOIN (SELECT DISTINCT lang FROM learned) l {direct} {leave}),
bits AS (SELECT u, lang, sum(n * cost) / 65536::DOUBLE AS b FROM asked JOIN priced USING (g) GROUP BY ALL),
best AS (SELECT u, arg_min(lang, (b, lang)) AS lang, min(b) AS b FROM bits GROUP BY u),
won AS (SELECT u, any_value(best.lang) AS lang, 1 / sum(pow(2::DOUBLE, greatest(best.b - bits.b, -1000))) AS score FROM bits JOIN best USING (u) GROUP BY u)
SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN coalesce(won.lang, 'und') ELSE 'und' END AS lang_pred,
  CASE WHEN regexp_matches(text, '\\p{{L}}') THEN coalesce(round(score, 6), 0) ELSE 0 END::DOUBLE AS score FROM docs LEFT JOIN won USING (u)
"""


OP4 = _op4()


def _op10() -> str:
    """Base kinds by the contract's patterns, `url` by one more, `account` from the places of all
    cues; offsets are sums over the matches and the gaps between them."""
    cues = "|".join(form for cue in CUES for form in (cue, cue.upper(), cue.title()))
    # by kind: pattern and what a match m must fulfil
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (
            r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
            "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR ('0' || right(p, 3))::INTEGER > 255)) = 0",
        ),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
        "url": (
            r"""[A-Za-z0-9+.-]{1,32}://[^\x00-\x20\x7f<>"'`{}|\\^\x{A0}]+""".replace("'", "''"),
            "contains(regexp_extract(m, '://([^/?#]*)', 1), '@')",
        ),
        # a space stands before the text, so that every cue has a character before it
        "cue": (rf"[^\p{{L}}\p{{N}}_](?:{cues})", "true"),
    }
    cut = " UNION ALL ".join(
        f"SELECT u, {k} AS k, '{kind}' AS kind, regexp_extract_all(x, '{re}') AS ms, string_split_regex(x, '{re}') AS gaps"
        f" FROM (SELECT u, {chr(39) + ' ' + chr(39) + ' || ' if kind == 'cue' else ''}text AS x FROM docs)"
        for k, (kind, (re, _)) in enumerate(kinds.items())
    )
    valid = " ".join(f"WHEN '{kind}' THEN {rule}" for kind, (_, rule) in kinds.items())
    iban = r"^([\x20:=#]{0,3})([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)"
    cued = r"""^([\x20]?[=:#][\x20]?["']?)([A-Za-z0-9_+/.-]{6,})""".replace("'", "''")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}" for kind in list(kinds)[:4])
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({cut})),
hits AS MATERIALIZED (SELECT u, k, kind, i, ms[i] AS m,
  (sum(len(gaps[i]) + CASE WHEN i > 1 THEN len(ms[i - 1]) ELSE 0 END) OVER (PARTITION BY u, k ORDER BY i))::BIGINT AS a FROM cut),
-- a cue's place without the character and the space before it
cue AS (SELECT u, i, a, a + len(m) - 1 AS b, lower(substr(m, 2)) = 'iban' AS is_iban, substr(text, a + len(m)) AS rest FROM hits JOIN docs USING (u) WHERE kind = 'cue'),
tried AS (SELECT *, is_iban AND regexp_matches(rest, '{iban}') AS by_iban, regexp_matches(rest, '{cued}') AS by_cue FROM cue),
value AS (SELECT u, a, by_iban, row_number() OVER (PARTITION BY u ORDER BY i) AS nth,
  b + len(regexp_extract(rest, CASE WHEN by_iban THEN '{iban}' ELSE '{cued}' END, 1)) AS s,
  regexp_extract(rest, CASE WHEN by_iban THEN '{iban}' ELSE '{cued}' END, 2) AS v FROM tried WHERE by_iban OR by_cue),
-- a cue inside what an earlier one took is passed over
walk(u, nth, free, taken) AS (
  SELECT DISTINCT u, 0::BIGINT, 0::BIGINT, false FROM value
  UNION ALL SELECT v.u, v.nth, CASE WHEN v.a >= w.free THEN v.s + len(v.v) ELSE w.free END, v.a >= w.free FROM walk w JOIN value v ON v.u = w.u AND v.nth = w.nth + 1),
account AS (SELECT u, 5 AS k, 'account' AS kind, s AS a, s + len(v) AS b FROM walk JOIN value USING (u, nth) WHERE taken AND CASE WHEN by_iban THEN
    len(replace(v, ' ', '')) >= 15 AND list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(v, 4), ''),
      lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), lambda r, d: (r * CASE WHEN d < 10 THEN 10 ELSE 100 END + d) % 97, 0::BIGINT) = 1
  ELSE regexp_matches(v, '[0-9]') END),
spans AS (SELECT u, k, kind, a, a + len(m) AS b FROM hits WHERE kind <> 'cue' AND CASE kind {valid} END UNION ALL SELECT * FROM account),
listed AS (SELECT u, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) FILTER (k < 4) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans, count(*)::BIGINT AS n_spans FROM spans GROUP BY u)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in list(kinds)[:4])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM docs LEFT JOIN listed USING (u)
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda c, k:"
    " CASE WHEN k % 2 = 1 THEN c::INTEGER WHEN c < '5' THEN 2 * c::INTEGER ELSE 2 * c::INTEGER - 9 END))"
)

OP10 = _op10()

ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1,
    "op2_benchmark_decontamination": OP2,
    "op3_quality_rules": OP3,
    "op4_language_id": OP4,
    "op6_license_scans": OP6,
    "op7_url_filters": OP7,
    "op8_mixing": OP8,
    "op9_warc": OP9,
    "op10_pii": OP10,
}
