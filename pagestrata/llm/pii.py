"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. At each anchor a deterministic local parser expands
to the boundaries of an email, an address, a card, a phone number, or the value
behind a cue, and validates it. Every parser moves forward only, so the work is
linear in the text, however long a run of word characters or digits is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released, small_batches

#: Kinds in the order of the digest; later ones are this method's own.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]

#: Words before a value that identifies a person or an account.
CUES = (
    "account", "acct", "api_key", "apikey", "bic", "customer_id", "iban", "passport",
    "passwd", "password", "secret", "social security", "ssn", "tax_id", "token", "user_id",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\x00-\x20\x7f<>\"'`{}|\\^ ]+")
_CUED = re.compile(r"""[\x20]?[=:#][\x20]?["']?([A-Za-z0-9_+/.-]{6,})""")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("scheme", ["://"])):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.title()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _checked_iban(raw: str) -> bool:
    raw = raw.replace(" ", "")
    return len(raw) >= 15 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start.

    Spans of one kind never overlap; those of the base kinds are the leftmost matches
    of their patterns, less those that fail validation.
    """
    spans: list[tuple[str, int, int]] = []
    # where each kind may start next; a failed match is passed over as a whole
    free = dict.fromkeys(KINDS, 0)
    run = 0  # no local-part character stands between an earlier look-back and here
    for last, (anchor, length) in automaton.iter(text):
        start = last - length + 1
        if anchor == "digit":
            if start >= free["ip"]:
                if m := _IP.match(text, start):
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        spans.append(("ip", start, m.end()))
                else:
                    # no match can start inside this run of digits
                    end = start + 1
                    while end < len(text) and "0" <= text[end] <= "9":
                        end += 1
                    free["ip"] = end
            if start >= free["card"] and (m := _CARD.match(text, start)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", start, m.end()))
        elif anchor == "at":
            low = max(free["email"], run)
            at = start
            while at > low and text[at - 1] in _LOCAL:
                at -= 1
            run = start + 1
            if at < start and (m := _DOMAIN.match(text, start + 1)):
                free["email"] = m.end()
                spans.append(("email", at, m.end()))
        elif anchor == "plus":
            if start >= free["phone"] and (m := _PHONE.match(text, start)):
                free["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append(("phone", start, m.end()))
        elif anchor == "scheme":
            at = start
            while at > free["url"] and start - at < 32 and (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "+.-")):
                at -= 1
            # an address with a user's name before its host
            if at < start and (m := _URL.match(text, last + 1)):
                free["url"] = m.end()
                if "@" in re.split(r"[/?#]", m[0], maxsplit=1)[0]:
                    spans.append(("url", at, m.end()))
        elif start >= free["account"] and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            if text[start : last + 1].lower() == "iban" and (m := _IBAN.match(text, last + 1)):
                free["account"] = m.end()
                if _checked_iban(m[1]):
                    spans.append(("account", m.start(1), m.end(1)))
            elif m := _CUED.match(text, last + 1):
                free["account"] = m.end()
                if any("0" <= c <= "9" for c in m[1]):
                    spans.append(("account", m.start(1), m.end(1)))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (order[s[0]], s[1]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by its first kind's tag."""
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans: array of (kind, start, end)) per row; a null or empty text has none.

    Offsets are code points of the whole text, ends exclusive. Repeated and null keys keep
    a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [find_spans(t, automaton) if t else [] for t in batch.column(1).to_pylist()]
            found = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "spans"])

    small_batches(docs.sparkSession)
    keys = docs.select(key, text)
    return keys.mapInArrow(released(run), f"`{key}` {keys.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every row.

    base_sha256 is over the base kinds' spans, spans and n_spans (their number) over all
    kinds. A null or empty text has none. Repeated and null doc_ids keep a row each; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    found = personal_data(docs)

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(counted, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with the personal data in `text` replaced by tags and `n_chars` following it.

    Rows and other columns stay as they are; a null text stays null.
    """
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        at = names.index("text")
        for batch in batches:
            texts = [t and mask(t, find_spans(t, automaton)) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            if "n_chars" in names:
                kind = batch.column(names.index("n_chars")).type
                lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
                columns[names.index("n_chars")] = lengths
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), schema)

