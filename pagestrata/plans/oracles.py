"""DuckDB SQL for the block queries, written apart from the Spark expressions.

Joins stand where Spark uses windows and arrays: heading texts are an anti join, figure
context a range join, block order a union.
"""

from __future__ import annotations

from ..sources.synthetic import CASES

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '{_BREAK}'), lambda l: {_strip('l')}), lambda l: l <> '')"


def _normal(x: str) -> str:
    spaces = "".join(f"chr({c})" + " || " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F))[:-4]
    plain = f"translate(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {spaces}, repeat(' ', 14))"
    each = f"list_transform(string_split({plain}, chr(10)), lambda l: regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '{_WS}+$', ''))"
    return f"regexp_replace({_strip(f'array_to_string({each}, chr(10))')}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _full(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, '{pattern}')"


def _in(x: str, names: str) -> str:
    return f"{x} IN ({', '.join(repr(n) for n in names.split('|'))})"


_RAW = r"""
k AS (SELECT o_orderkey // 130 AS doc, o_orderkey % 5 + 1 AS page_number, o_orderkey % 26 AS c FROM orders),
texts(c, t) AS (VALUES (0, '1. SCOPE'), (1, '2.2 Government documents'), (2, '101.3 Details to be specified.'),
  (3, '3. The contractor shall keep a record of the work and of the results'), (4, 'MIL-STD-882E'),
  (6, 'Source: https://example.org/doc -- Downloaded'), (7, 'Guide | Page 12'), (8, 'FIGURE 1. System overview'),
  (9, 'Figure 2: System overview'), (10, 'TABLE II. Probability levels'), (11, 'Severity@Category@Description'), (12, 'Critical@2'),
  (13, 'Element 4:@Identify and Document@Risk Mitigation Measures'), (14, 'Hazard ID@Hazard Title@Hazard Description@Hazard Causes'),
  (15, '3.2.29 Risk. A combination of severity and of probability, for one item.'), (16, 'See Table I for severity categories.'),
  (17, 'c. Included additional tasks:'), (18, 'CONTENTS@PARAGRAPH PAGE@1. SCOPE ..... 1@TASK 102 PLAN ..... 24'),
  (19, 'Body introduction here.@2. APPLICABLE DOCUMENTS'), (20, 'TASK 101@HAZARD ANALYSIS'),
  (21, 'System Risk@Accepted in accordance@with policy@5000 series'), (22, '   '), (23, 'This is ordinary body text.'),
  (24, 'A' || chr(160) || 'B' || chr(13) || '@C' || chr(9) || chr(9) || 'D  '), (25, 'Node Alpha one@Node Beta two@Node Gamma three')),
raw AS (SELECT 'manual-' || doc AS document_id, doc, page_number, k.c,
  CASE WHEN page_number = 5 THEN ' ' WHEN page_number = 1 AND k.c = 8 THEN 'This is ordinary body text.' WHEN k.c = 5 THEN doc::VARCHAR
       WHEN k.c = 17 AND doc % 2 = 1 THEN 'C. Included additional tasks:' ELSE replace(t, '@', chr(10)) END AS text,
  NOT (page_number = 4 AND k.c IN (8, 21)) AS placed,
  CASE WHEN k.c <> 21 THEN 80.0 WHEN doc % 4 = 3 THEN 400.0 ELSE 100.0 END::DOUBLE AS x0,
  CASE WHEN k.c = 21 AND doc % 4 = 3 THEN 500.0 ELSE 300.0 END::DOUBLE AS x1,
  CASE WHEN k.c = 4 THEN CASE doc % 2 WHEN 1 THEN 400 ELSE 20 END WHEN k.c = 5 AND doc % 2 = 0 THEN 760
       WHEN k.c = 8 AND page_number = 2 THEN 700 WHEN k.c = 8 AND page_number = 3 THEN 40
       WHEN k.c = 21 THEN CASE doc % 4 WHEN 0 THEN 430 WHEN 1 THEN 100 WHEN 2 THEN 300 ELSE 640 END ELSE 60 + 25 * k.c END::DOUBLE AS y0,
  CASE WHEN k.c <> 21 THEN 20 WHEN doc % 4 = 0 THEN 70 WHEN doc % 4 = 2 THEN 40 ELSE 50 END::DOUBLE AS h
  FROM k LEFT JOIN texts USING (c)),
"""

_TEXT = f"""
kept AS (SELECT *, y0 + h AS y1, row_number() OVER (PARTITION BY doc, page_number ORDER BY c) AS block_index FROM raw WHERE {_strip('text')} <> ''),
nt AS (SELECT *, 'page-' || page_number || '-text-' || block_index AS id, {_normal('text')} AS normalized_text FROM kept),
tb0 AS (SELECT *, {_ws('normalized_text')} AS ws, placed AND y0 <= 800 * 0.12::DOUBLE AS top, placed AND y1 >= 800 * 0.88::DOUBLE AS bottom FROM nt),
tb1 AS (SELECT *, {_full('ws', '[0-9]+')} OR {_in('lower(ws)', 'i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii')} AS num,
  regexp_matches(ws, '(?i)source: ?https?://') OR (contains(lower(ws), 'check the source to verify') AND contains(lower(ws), 'current version'))
   OR (contains(lower(ws), 'source:') AND contains(lower(ws), 'verify')) OR (length(ws) <= 140 AND regexp_matches(ws, '(?i)\\| ?Page [0-9]+\\b')) AS foot,
  top AND {_full('ws', '(?i)MIL-STD-[A-Z0-9]+(?: w/CHANGE [0-9]+)?|FTIAS Manual')}
   AND NOT {_full('ws', '(?i)[0-9]+(?:[.][0-9]+)*[.] [^ ].+|FOREWORD|CONTENTS|SUMMARY OF CHANGE 1 MODIFICATIONS')} AS head FROM tb0),
tb AS (SELECT *, (num AND top) OR head AS is_page_header, (num AND bottom) OR foot AS is_page_footer, num AS is_page_number, num OR foot OR head AS is_page_furniture FROM tb1)
"""


def _upper_share(x: str) -> str:
    return f"(length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) * 4 >= 3 * length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')))"


def _headings(source: str, name: str) -> str:
    """CTEs that judge the column ws of `source`; the last is `name`."""
    starters = "A|AN|COMMENTS|DOD|IF|SINCE|THE|THESE|THIS|WHEN"
    stops = "a|an|and|are|as|be|by|for|from|in|is|of|on|or|that|the|this|to|with"
    front = "ABSTRACT|EXECUTIVE SUMMARY|CONTENTS"
    short = "BACKEND|DATABASE|DOCKER|FRONTEND|LIMITATIONS|LOGS|MIGRATIONS|OVERVIEW|PREREQUISITES"
    known = "APPLICABLE DOCUMENTS|DEFINITIONS|DETAILED REQUIREMENTS|GENERAL REQUIREMENTS|NOTES|SCOPE"
    return f"""
{name}_a AS (SELECT *, upper(ws) AS u, length(ws) AS n,
  CASE WHEN {_full('ws', '[0-9]+[.] [^ ].+')} THEN split_part(ws, '.', 1) WHEN {_full('ws', '[0-9]+(?:[.][0-9]+)+ [^ ].+')} THEN split_part(ws, ' ', 1) END AS number,
  {_full('ws', '(?i)CHAPTER [0-9]+ - [^ ].+|ANNEX [A-Z] - [^ ].+')} AS chapter,
  {_full('ws', '(?i)TASK [0-9]+(?: [^ ].+)?|TASK SECTION [0-9]+ - [^ ].+|APPENDIX [A-Z] [^ ].+')} AS task FROM {source}),
{name}_b AS (SELECT *, CASE WHEN number IS NOT NULL THEN nullif(trim(substr(ws, length(number) + CASE WHEN contains(number, '.') THEN 2 ELSE 3 END)), '') END AS title,
  number IS NOT NULL AND try_cast(split_part(number, '.', 1) AS HUGEINT) >= 100 AS hundreds, {_in('u', front)} AS front, {_in('u', front + '|' + short)} AS listed,
  len(string_split(ws, ' ')) >= 3 AND NOT ({_full('ws', '(?i)APPENDIX [A-Z] [^ ].+')} AND {_upper_share('ws')}) AND NOT {_full('ws', '(?i)APPENDIX [A-Z] - [^ ].+')}
   AND (starts_with(u, 'SEE APPENDIX ') OR starts_with(u, 'REFER TO APPENDIX ') OR {_full('ws', 'Appendix [A-Z] for [^ ].+')}) AS reference FROM {name}_a),
{name}_c AS (SELECT *, rtrim(title, '.:') AS bare, list_filter(string_split(title, ' '), lambda w: {_in('lower(w)', stops)}) AS stops FROM {name}_b),
{name}_d AS (SELECT *, coalesce(title IS NOT NULL AND NOT contains(number, '.') AND NOT {_in('upper(bare)', known)} AND NOT {_upper_share('title')}
   AND NOT (len(string_split(bare, ' ')) <= 6 AND NOT ends_with(title, '.') AND len(list_filter(string_split(bare, ' '), lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0)
   AND ({_in("upper(regexp_extract(title, '^[A-Za-z]+'))", starters)} OR (len(string_split(title, ' ')) >= 10 AND len(stops) >= 3) OR (length(title) > 70 AND len(stops) >= 2)), false) AS body,
   regexp_matches(ws, '[.!?]$') AND NOT coalesce(hundreds, false) AND NOT chapter AND NOT task AND NOT front AS sentence,
   contains(ws, '.....') AND regexp_matches(ws, '(?i)[.]{{5,}} ?(?:[ivxlcdm]+|[0-9]+)$') AS toc FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN listed OR (task AND NOT reference) THEN NULL WHEN left(ws, 1) IN ('-', '*', chr(8226)) THEN 'bullet' WHEN n < 3 THEN 'short'
   WHEN contains(ws, '.....') THEN 'dots' WHEN regexp_matches(ws, '(?i)https?://|@') THEN 'link'
   WHEN regexp_matches(ws, '(?i)\\| ?Page [0-9]+ (?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{{1,2}}, [0-9]{{4}}') AND contains(ws, '| Page ') THEN 'dated_footer'
   WHEN {_full('ws', '(?i)MIL-STD-[0-9]+[A-Z]?')} THEN 'document_header' WHEN {_full('ws', '[0-9]+')} THEN 'digits' WHEN {_full('ws', '(?i)[IVXLCDM]+')} THEN 'roman'
   WHEN {_full('ws', '[A-Z][A-Z0-9-]{1,7}')} THEN 'acronym' WHEN n > 120 AND NOT chapter AND NOT task THEN 'long' WHEN sentence THEN 'sentence' END AS refused,
   coalesce(length(title) <= 100 AND NOT contains(rtrim(title, '.'), '. ') AND (NOT regexp_matches(title, '[.!?]$') OR (hundreds AND length(title) <= 80)), false) AS numbered FROM {name}_d),
{name} AS (SELECT *, CASE WHEN ws = '' THEN 'no:empty' WHEN toc THEN 'no:toc_entry' WHEN body THEN 'no:numbered_body' WHEN reference THEN 'no:appendix_reference'
   WHEN refused IS NOT NULL THEN 'no:' || refused WHEN listed THEN 'yes:listed_title' WHEN chapter THEN 'yes:chapter_or_annex' WHEN task THEN 'yes:task_or_appendix'
   WHEN n > 120 THEN 'no:long' WHEN number IS NOT NULL THEN CASE WHEN numbered THEN 'yes:numbered' ELSE 'no:numbered' END
   WHEN {_full('ws', '[A-Z][.][0-9]+(?:[.][0-9]+)* [^ ].+')} THEN CASE WHEN sentence THEN 'no:sentence' ELSE 'yes:annex_section' END ELSE 'no:plain' END AS reason,
   CASE WHEN front OR chapter OR task THEN 1 WHEN number IS NOT NULL THEN len(string_split(number, '.')) ELSE 2 END AS level FROM {name}_e)"""


_CONTENTS = f"""
toc AS (SELECT doc, page_number, block_index, contains(upper(ws), 'CONTENTS')::INT + contains(upper(ws), 'PARAGRAPH')::INT + contains(upper(ws), 'PAGE')::INT + contains(normalized_text, '.....')::INT
  + (len(list_filter({_lines('normalized_text')}, lambda l: regexp_matches({_ws('l')}, '(?i) (?:[ivxlcdm]+|[0-9]+)$'))) >= 3)::INT
  + (len(list_filter({_lines('normalized_text')}, lambda l: regexp_matches({_ws('l')}, '(?i)[.]{{5,}} ?(?:[ivxlcdm]+|[0-9]+)$'))) >= 2)::INT >= 3 AS is_contents FROM tb)"""

_PIECES = f"""
pc AS (SELECT doc, document_id, page_number, block_index, id AS text_id, text, normalized_text, 0 AS pos, ws FROM tb WHERE NOT is_page_furniture
  UNION ALL SELECT doc, document_id, page_number, block_index, id, text, normalized_text, unnest(range(1, len(l) + 1)), unnest(list_transform(l, lambda x: {_ws('x')}))
  FROM (SELECT *, {_lines('normalized_text')} AS l FROM tb WHERE NOT is_page_furniture))"""

_HEADS = """
hl AS (SELECT *, row_number() OVER (PARTITION BY doc, page_number, block_index, lower(ws) ORDER BY pos) AS r FROM pj JOIN toc USING (doc, page_number, block_index)
  WHERE starts_with(reason, 'yes') AND (pos = 0 OR NOT is_contents OR u = 'CONTENTS')),
hd AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE row_number() OVER (PARTITION BY doc, page_number, block_index, pos = 0 ORDER BY pos) END AS sub_index FROM hl WHERE r = 1),
heads AS (SELECT document_id, doc, page_number, block_index, sub_index, level, CASE WHEN pos = 0 THEN replace(text_id, '-text-', '-heading-') ELSE text_id || '-line-heading-' || sub_index END AS id,
  CASE WHEN pos = 0 THEN text ELSE ws END AS text, CASE WHEN pos = 0 THEN normalized_text ELSE ws END AS normalized_text, ws FROM hd)"""


def _any(x: str, words: str) -> str:
    return " + ".join(f"contains({x}, '{w}')::INT" for w in words.split("|"))


_HEADER = "category|criteria|description|entity|key links|level|mishap result criteria|probability|purpose|severity|specific individual item|fleet or inventory|why it matters"
_PHRASES = (
    "cm/drawing control|contribution to system risk|engineering design process|hazard tracking log|operator training|safety-significant software"
    "|system and software system|system risk|typical safety activities"
)
_SHORT_TITLE = (
    "len(string_split({x}, ' ')) <= 6 AND {x} <> '' AND len(list_filter(string_split({x}, ' '), lambda w: length(w) > 18)) = 0"
)
_TABLE_RULES = f"""
ta AS (SELECT *, starts_with(reason, 'yes') AS heading, {_lines('normalized_text')} AS l, lower(ws) AS lo, string_split(ws, ' ') AS w FROM bj),
tb2 AS (SELECT *, len(l) AS nl, len(w) AS nw, list_transform(l, lambda x: lower({_ws('x')})) AS p, len(list_filter(l, lambda x: regexp_matches(x, '[^ ](?: {{2,}}|\\t+)[^ ]'))) AS columns,
  len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Ll}}'))) / len(w)::DOUBLE AS low,
  {_full('ws', '(?i)TABLE (?:[0-9]+|[A-Z]-?[IVXLCDM]+|[IVXLCDM]+)[.]?(?: [^ ].+)?')} OR {_full('ws', '(?:[IVXLCDM]+|[A-Z]-[IVXLCDM]+)[.] [^ ].+')} AS caption FROM ta),
tc AS (SELECT *, ({_any('lo', _HEADER)}) >= 2 AS terms, nl BETWEEN 3 AND 8 AND len(list_intersect(p, string_split('{_HEADER}', '|'))) >= 3 AS vertical,
  nl >= 2 AND {_in('p[1]', 'catastrophic|critical|frequent|marginal|negligible|probable|occasional|remote|improbable')}
   AND (regexp_full_match(l[2], '[0-9]+|\\p{{Lu}}') OR {_in('p[2]', 'i|ii|iii|iv')}) AND (nl = 2 OR len(list_filter(l[3:], lambda x: len(string_split({_ws('x')}, ' ')) >= 4)) > 0) AS fragment,
  len(list_filter(p, lambda x: NOT ({_SHORT_TITLE.format(x="rtrim(x, ':')")}))) = 0 AS titles FROM tb2),
td AS (SELECT *, CASE WHEN nl = 1 THEN lo IN ('probability levels', 'severity categories') ELSE nl <= 12 AND n <= 240 AND (terms OR vertical) END AS headers,
  columns >= 2 OR vertical OR fragment AS structured,
  nl >= 2 AND (columns >= 2 OR fragment OR (nl >= 3 AND len(list_filter(p, lambda x: len(string_split(x, ' ')) BETWEEN 2 AND 8)) >= 3
    AND NOT (nw >= 18 AND low >= 0.45 AND len(list_filter(l[2:], lambda x: regexp_matches(x, '^\\p{{Ll}}'))) > 0))) AS layout,
  regexp_extract_all(array_to_string(p, ' '), '[a-z]+') AS labels, regexp_matches(ws, '[.;:,]') AS marks,
  nl BETWEEN 2 AND 4 AND len(list_filter(p, lambda x: x NOT IN ('decision', 'end', 'input', 'output', 'start'))) = 0 AS cluster FROM tc),
te AS (SELECT *, NOT caption AND NOT structured AS free, regexp_extract(ws, '^[0-9]+(?:[.][0-9]+){{2,}} [^.]{{1,80}}[.] ([^ ].+)$', 1) AS dbody,
  string_split(regexp_extract(ws, '^[0-9]+(?:[.][0-9]+){{2,}} ([^.]{{1,80}})[.] [^ ].+$', 1), ' ') AS dterm,
  CASE WHEN regexp_matches(l[1], '(?i)^(?:Element|Process Step|Step) [0-9]+: ?$') THEN nl BETWEEN 2 AND 4 AND titles ELSE cluster END AS steps,
  nl BETWEEN 3 AND 8 AND titles AND len(labels) > 0 AND len(list_filter(labels, lambda x: {_in('x', 'approved|by|causes|date|description|hazard|id|log|prepared|report|title|tracking')})) >= 0.75 * len(labels) AS form FROM td),
tf AS (SELECT *, CASE WHEN ws = '' THEN 'empty' WHEN regexp_matches(ws, '(?i)[.]{{5,}} ?(?:[ivxlcdm]+|[0-9]+)$') THEN 'dot_leader'
  WHEN regexp_matches(ws, 'https?://') THEN 'link' WHEN starts_with(lo, 'source:') THEN 'source' WHEN caption THEN NULL
  WHEN free AND dbody <> '' AND len(dterm) <= 8 AND len(string_split(dbody, ' ')) >= 5 AND regexp_matches(dbody, '[.;:,]')
    AND len(list_filter(string_split(dbody, ' '), lambda x: regexp_matches(x, '^\\p{{Ll}}'))) >= 0.35 * len(string_split(dbody, ' ')) THEN 'definition'
  WHEN free AND regexp_matches(ws, '(?i)\\bTables? [A-Z0-9][A-Z0-9.-]*\\b') THEN 'table_reference'
  WHEN regexp_matches(ws, '(?i)^Figure (?:[0-9]+|[A-Z]-?[0-9]+)[.:] [^ ].+$') OR (NOT structured AND regexp_matches(ws, '(?i)\\bFigures? (?:[0-9]+|[A-Z]-?[0-9]+)[A-Z0-9.-]*\\b')) THEN 'figure_text'
  WHEN free AND steps THEN 'process_label' WHEN free AND form THEN 'form_labels'
  WHEN free AND regexp_matches(ws, '^[0-9]+(?:[.][0-9]+)+ [^ ][^.]{{1,80}}[.] [^ ].+$') AND ({_any('lo', 'category|description|details|level|probability|purpose|severity|specified')}) > 0 AND low >= 0.35 AND marks THEN 'section_prose'
  WHEN regexp_matches(l[1], '(?i)^[a-z][.]{_WS}+[^ ].+$') OR len(list_filter(l, lambda x: regexp_full_match(x, '\\([0-9]+\\)'))) >= CASE WHEN nl <= 3 THEN 1 ELSE 2 END THEN 'list_item'
  WHEN heading THEN 'heading'
  WHEN NOT headers AND NOT fragment AND ((regexp_matches(ws, '(?i)^[0-9]+[.] (?:This|These|The|DoD|Comments|Since|When|If|A|An)\\b') AND nw >= 12)
    OR (nw >= 24 AND low >= 0.45 AND marks) OR (nw >= 18 AND low >= 0.4 AND list_sum(list_transform(l, lambda x: length(x))) >= 65 * nl)) THEN 'long_prose' END AS reject_reason,
  CASE WHEN caption THEN 'caption' WHEN headers THEN 'header_terms' WHEN layout THEN 'line_structure' END AS evidence,
  NOT (caption OR headers OR columns >= 2 OR fragment) AND CASE WHEN free AND (steps OR form) THEN true
    WHEN ({_any('lo', _PHRASES)}) > 0 OR len(list_filter(l, lambda x: left(x, 1) IN ('-', '*', chr(8226)))) > 0 THEN nl BETWEEN 2 AND 8 AND nw <= 36 AND len(list_filter(l, lambda x: length(x) > 70)) = 0
    ELSE (nl BETWEEN 2 AND 4 AND len(list_filter(p, lambda x: x NOT IN ('decision', 'end', 'input', 'output', 'start', 'process'))) = 0)
      OR (nl >= 3 AND list_max(list_transform(p, lambda x: len(list_filter(p, lambda y: split_part(y, ' ', 1) = split_part(x, ' ', 1))))) >= 3) END AS figure_internal FROM te)"""

_TABLES = f"""{_TABLE_RULES},
figs AS (SELECT doc, page_number, block_index, placed, x0, x1, y0, y1 FROM tb WHERE NOT is_page_furniture AND {_full('ws', '(?i)FIGURE (?:[0-9]+|[A-Z]-[0-9]+)[.] [^ ].+')}),
body AS (SELECT f.* FROM tf f WHERE NOT is_page_furniture AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc = f.doc AND h.page_number = f.page_number AND h.ws = f.ws)),
near AS (SELECT DISTINCT b.doc, b.page_number, b.block_index FROM body b JOIN figs g ON b.doc = g.doc AND b.page_number = g.page_number AND b.placed AND g.placed
   AND b.x0 <= g.x1 AND g.x0 <= b.x1 WHERE least(abs(b.y1 - g.y0), abs(g.y1 - b.y0)) <= CASE WHEN (g.y0 >= 480 AND b.y1 <= g.y0) OR (g.y1 <= 320 AND g.y1 <= b.y0) THEN 360 ELSE 120 END),
ctx AS (SELECT b.*, (SELECT count(*) FROM figs g WHERE g.doc = b.doc AND g.page_number = b.page_number) AS n_figures,
   CASE WHEN NOT figure_internal OR NOT EXISTS (SELECT 1 FROM figs g WHERE g.doc = b.doc AND g.page_number = b.page_number) THEN NULL
        WHEN EXISTS (SELECT 1 FROM near x WHERE x.doc = b.doc AND x.page_number = b.page_number AND x.block_index = b.block_index) THEN 'near_caption'
        WHEN NOT (b.placed AND EXISTS (SELECT 1 FROM figs g WHERE g.doc = b.doc AND g.page_number = b.page_number AND g.placed)) THEN 'no_geometry' END AS suppressed
   FROM body b WHERE reject_reason IS NULL AND evidence IS NOT NULL),
blocks AS (
  SELECT document_id, page_number, 0 AS phase, block_index, -1 AS sub_index, id, 'text' AS block_type, NULL AS text_id, normalized_text, NULL AS level, is_page_furniture FROM tb
  UNION ALL SELECT document_id, page_number, 0, block_index, sub_index, id, 'heading', NULL, normalized_text, level, NULL FROM heads
  UNION ALL SELECT document_id, page_number, 1, block_index, 0, 'page-' || page_number || '-paragraph-' || row_number() OVER (PARTITION BY doc, page_number ORDER BY block_index), 'paragraph', id, normalized_text, NULL, NULL FROM body
  UNION ALL SELECT document_id, page_number, 2, block_index, 0, 'page-' || page_number || '-figure-' || row_number() OVER (PARTITION BY doc, page_number ORDER BY block_index), 'figure', id, normalized_text, NULL, NULL
    FROM tb SEMI JOIN figs USING (doc, page_number, block_index)
  UNION ALL SELECT document_id, page_number, 3, block_index, 0, 'page-' || page_number || '-table-' || row_number() OVER (PARTITION BY doc, page_number ORDER BY block_index), 'table', id, normalized_text, NULL, NULL
    FROM ctx WHERE suppressed IS NULL)
"""
_JUDGED = f"WITH {_RAW} {_TEXT}, {_headings('tb', 'bj')}"
_HEADED = f"{_JUDGED}, {_CONTENTS}, {_PIECES}, {_headings('pc', 'pj')}, {_HEADS}"
_ALL = f"{_HEADED}, {_TABLES}"
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# texts of the bank as they are, or normalized ones; then every rule on its own
_CASE_ROWS = ", ".join(f"({k}, {_quoted(text.strip(' '))})" for k, text in enumerate(CASES))
_CASES = f"t AS (SELECT *, {_ws('normalized_text')} AS ws FROM (VALUES {_CASE_ROWS}) v(case_id, normalized_text))"
_TEXTS = f"""t AS (SELECT *, {_ws('normalized_text')} AS ws FROM (SELECT key, coalesce({_normal('text')}, '') AS normalized_text FROM (
  SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)))"""
_SECTION = "(?i)[0-9]+(?:[.][0-9]+)*[.] [^ ].+|FOREWORD|CONTENTS|SUMMARY OF CHANGE 1 MODIFICATIONS"


def _ruled(key: str, texts: str) -> str:
    return f"""WITH {texts}, {_headings('t', 'bj')}, {_TABLE_RULES}
SELECT {key}, heading AS is_heading, reason, CASE WHEN heading THEN level END::BIGINT AS level, reject_reason, evidence, reject_reason IS NULL AND evidence IS NOT NULL AS is_candidate,
  coalesce(figure_internal, false) AND ws <> '' AS figure_internal, {_full('ws', '(?i)FIGURE (?:[0-9]+|[A-Z]-[0-9]+)[.] [^ ].+')} AS is_caption,
  {_full('ws', '[0-9]+')} OR {_in('lower(ws)', 'i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii')} AS is_number,
  regexp_matches(ws, '(?i)source: ?https?://') OR (contains(lower(ws), 'check the source to verify') AND contains(lower(ws), 'current version'))
   OR (contains(lower(ws), 'source:') AND contains(lower(ws), 'verify')) OR (length(ws) <= 140 AND regexp_matches(ws, '(?i)\\| ?Page [0-9]+\\b')) AS is_footer,
  {_full('ws', '(?i)MIL-STD-[A-Z0-9]+(?: w/CHANGE [0-9]+)?|FTIAS Manual')} AND NOT {_full('ws', _SECTION)} AS is_header FROM tf"""


_SUMMED = ", ".join(f"sum(is_page_{f}::INT)::BIGINT AS n_{f}" for f in ("header", "footer", "number", "furniture"))

ORACLE_SQL = {
    "rule_cases": _ruled("case_id", _CASES),
    "rules_over_texts": _ruled("key", _TEXTS),
    "normalize_documents": f"SELECT doc_id, {_normal('text')} AS normalized FROM documents",
    "match_text_lines": f"SELECT doc_id, {_ws('text')} AS ws, len(l)::BIGINT AS n_lines, array_to_string(l, '|') AS joined_lines FROM (SELECT *, {_lines('text')} AS l FROM documents)",
    "keywords_split": f"""WITH d AS (SELECT DISTINCT o_orderkey // 130 AS doc FROM orders),
m AS (SELECT doc, CASE doc % 4 WHEN 0 THEN ['safety', 'risk', 'a;b'] WHEN 1 THEN ['one', 'two', 'three four'] WHEN 2 THEN ['alpha', 'beta', 'gamma'] ELSE [] END AS kw FROM d)
SELECT '/library/manual-' || doc || '.pdf' AS document_path, 'Manual ' || doc AS title, CASE WHEN doc % 3 <> 0 THEN 'A. Writer' END AS author, NULL::VARCHAR AS subject,
 array_to_string(kw, '|') AS keywords, len(kw)::BIGINT AS n_keywords FROM m""",
    "raw_blocks_scan": f"WITH {_RAW} {_TEXT} SELECT document_id, page_number, id, block_index, normalized_text FROM tb",
    "page_ocr_status": f"WITH {_RAW.rstrip().rstrip(',')} SELECT document_id, page_number, 612.0::DOUBLE AS width, 800.0::DOUBLE AS height, bool_or({_strip('text')} <> '') AS has_native_text, NOT bool_or({_strip('text')} <> '') AS requires_ocr FROM raw GROUP BY document_id, page_number",
    "furniture_flags": f"WITH {_RAW} {_TEXT} SELECT document_id, page_number, id, is_page_header, is_page_footer, is_page_number, is_page_furniture FROM tb",
    "furniture_summary": f"WITH {_RAW} {_TEXT} SELECT page_number, count(*) AS n_blocks, {_SUMMED} FROM tb GROUP BY page_number",
    "heading_predicate": f"{_JUDGED} SELECT document_id, page_number, id, starts_with(reason, 'yes') AS is_heading, reason FROM bj",
    "heading_levels": f"{_JUDGED} SELECT document_id, page_number, id, level::BIGINT AS level, number FROM bj WHERE starts_with(reason, 'yes')",
    "heading_lines": f"{_HEADED} SELECT document_id, page_number, id, block_index, sub_index::BIGINT AS sub_index, level::BIGINT AS level, text, normalized_text FROM heads",
    "toc_blocks": f"WITH {_RAW} {_TEXT}, {_CONTENTS} SELECT document_id, page_number, id, is_contents FROM tb JOIN toc USING (doc, page_number, block_index)",
    "paragraph_blocks": f"{_ALL} SELECT document_id, page_number, id, normalized_text, text_id FROM blocks WHERE block_type = 'paragraph'",
    "figure_blocks": f"{_ALL} SELECT document_id, page_number, id, {_ws('normalized_text')} AS caption, text_id FROM blocks WHERE block_type = 'figure'",
    "table_reject_reasons": f"{_ALL} SELECT document_id, page_number, id, reject_reason, evidence, reject_reason IS NULL AND evidence IS NOT NULL AS is_candidate FROM tf",
    "table_candidates": f"{_ALL} SELECT document_id, page_number, id, array_to_string({_lines('normalized_text')}, '|') AS cells, text_id FROM blocks WHERE block_type = 'table'",
    "figure_context_join": f"{_ALL} SELECT document_id, page_number, id, figure_internal, n_figures, suppressed FROM ctx",
    "prose_features_documents": f"""WITH r AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
f AS (SELECT key, {_ws('text')} AS ws, len({_lines('text')}) AS nl FROM r), g AS (SELECT *, list_filter(string_split(ws, ' '), lambda w: w <> '') AS w FROM f)
SELECT key, len(w)::BIGINT AS n_words, nl::BIGINT AS n_lines, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Ll}}')))::DOUBLE / len(w), 6) END AS lower_share,
 regexp_matches(ws, '[.;:,]') AS has_marks FROM g""",
    "page_block_order": f"{_ALL} SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY phase, block_index, sub_index) AS position, block_type, id FROM blocks",
    "lineage_join": f"{_ALL} SELECT b.document_id, b.page_number, b.id, b.block_type, b.text_id, t.normalized_text AS source_text FROM blocks b JOIN tb t ON t.document_id = b.document_id AND t.id = b.text_id",
    "json_export": f"""{_ALL} SELECT document_id, page_number, id, block_type, '/library/' || document_id || '.pdf' AS path, coalesce(level, 0)::BIGINT AS level, is_page_furniture::VARCHAR AS furniture,
 CASE WHEN block_type IN ('text', 'table', 'figure') THEN 9 ELSE 6 END::BIGINT AS n_keys FROM blocks""",
    "markdown_export": f"""WITH {_RAW} {_TEXT},
one AS (SELECT document_id, page_number, block_index, 'Source: page ' || page_number || ', bbox ' || CASE WHEN placed THEN '(' || x0 || ', ' || y0 || ', ' || x1 || ', ' || y1 || ')' ELSE 'None' END || ', method synthetic, confidence 1.0' || chr(10)
 || CASE WHEN is_page_furniture THEN 'Page furniture: yes' || chr(10) ELSE '' END || CASE WHEN is_page_header THEN 'Header: yes' || chr(10) ELSE '' END || CASE WHEN is_page_footer THEN 'Footer: yes' || chr(10) ELSE '' END
 || CASE WHEN is_page_number THEN 'Page number: yes' || chr(10) ELSE '' END || CASE WHEN normalized_text <> text THEN 'Normalized text available: yes' || chr(10) ELSE '' END || chr(10) || text || chr(10) AS part FROM tb),
agg AS (SELECT document_id, page_number, string_agg(part, chr(10) ORDER BY block_index) AS parts FROM one GROUP BY ALL),
pg AS (SELECT DISTINCT document_id, page_number FROM raw)
SELECT document_id, page_number, chr(10) || '## Page ' || page_number || chr(10) || chr(10) || '- has_native_text: ' || CASE WHEN parts IS NULL THEN 'False' ELSE 'True' END || chr(10) || '- requires_ocr: '
 || CASE WHEN parts IS NULL THEN 'True' ELSE 'False' END || chr(10) || coalesce(chr(10) || parts, '') AS markdown FROM pg LEFT JOIN agg USING (document_id, page_number)""",
    "block_type_rollup": f"{_ALL} SELECT coalesce(page_number, 0) AS page_number, coalesce(block_type, 'all') AS block_type, count(*) AS n_blocks, count(DISTINCT document_id) AS n_documents, grouping(blocks.page_number)::BIGINT AS all_pages, grouping(blocks.block_type)::BIGINT AS all_types FROM blocks GROUP BY ROLLUP (blocks.page_number, blocks.block_type)",
    "turns_as_blocks": f"""SELECT 'conversation-' || conv_id AS document_id, 'page-1-text-' || k AS id, k AS block_index, {_normal('text')} AS normalized_text
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE {_strip('text')} <> '')""",
    "html_as_blocks": f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''),
  '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<nav\\b.*?</nav\\s*>', '', 'g') AS body FROM pages),
e AS (SELECT page_id, unnest(regexp_split_to_array(body, '(?i)<(?:p|h[1-6]|li|div|br|tr|td|article|section|blockquote)\\b[^>]*>')) AS x FROM p),
t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM e)
SELECT 'page-' || page_id AS document_id, count(*) AS n_blocks, sum(length({_normal('x')}))::BIGINT AS n_chars FROM t WHERE {_strip('x')} <> '' GROUP BY page_id""",
}
