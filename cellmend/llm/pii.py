"""Personal data in texts (operator 10).

Regular expressions propose spans, checksum validators confirm them (Luhn for card numbers, mod 97 for account numbers) and
words nearby raise or lower the score of a span. Spans are in code points, end exclusive.

Base kinds, always kept when they pass their validator:
email, ip, card, phone. Added by the method: iban (mod 97), and local phone numbers, national ids and secrets (long runs of letters and
digits) that context supports.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmend.llm.common import carried, slices, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# The patterns start where a run of their first class starts, so that a long run costs one attempt, not one for each character.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")

#: Score that a span needs, the score a proposal starts with, and what each word nearby adds.
THRESHOLD, WINDOW = 0.5, 40
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4, "secret": 0.3}
CONTEXT = {
    "email": {"mail": 0.1, "contact": 0.1},
    "ip": {"ip": 0.2, "host": 0.1, "server": 0.1, "version": -0.2},
    "card": {"card": 0.1, "visa": 0.1, "pay": 0.1},
    "phone": {"phone": 0.2, "call": 0.2, "tel": 0.2, "fax": 0.1},
    "iban": {"iban": 0.1, "account": 0.1, "bank": 0.1},
    "ssn": {"ssn": 0.5, "social": 0.4, "security": 0.2},
    "local_phone": {"phone": 0.4, "call": 0.3, "tel": 0.4, "fax": 0.3, "mobile": 0.4},
    "secret": {"token": 0.4, "secret": 0.4, "password": 0.4, "passwd": 0.4, "key": 0.3, "api": 0.2, "bearer": 0.3, "credential": 0.3},
}
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account number check: moved to the end, letters as numbers, the remainder by 97 is 1."""
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans by the patterns and validators alone, unordered."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD_RUN.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's starting score changed by words within ``WINDOW`` characters, between 0 and 1."""
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    words = set(_WORD.findall(near.lower()))
    return min(1.0, max(0.0, START[kind] + sum(v for w, v in CONTEXT[kind].items() if w in words)))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: the longest run of groups from each start that passes its check."""
    at = 0
    while m := _IBAN.search(text, at):
        ends = [m.end(), *[i for i in range(m.end() - 1, m.start(), -1) if text[i] == " "]]
        ends = [e for e in ends if not text[e : e + 1].isalnum() and mod97(text[m.start() : e].replace(" ", ""))]
        at = ends[0] if ends else m.start() + 4
        if ends:
            yield m.start(), ends[0]


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            yield m.span()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with their scores by start, then kind in the order of ``KINDS``. An added span may overlap base spans of other kinds, but no other added span."""
    found, added = base_spans(text), []
    for kind, spans in (("iban", _accounts(text)), ("ssn", (m.span() for m in _SSN.finditer(text))), ("local_phone", (m.span() for m in _LOCAL_PHONE.finditer(text))), ("secret", _secrets(text))):
        at, new = 0, []  # both the spans of a kind and those added before are in order and apart from each other
        for a, b in spans:
            while at < len(added) and added[at][1] <= a:
                at += 1
            if (at == len(added) or b <= added[at][0]) and context_score(text, kind, a, b) >= THRESHOLD:
                new.append((a, b))
        found += [(kind, a, b) for a, b in new]
        added = sorted(added + new)
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return [(k, a, b, round(context_score(text, k, a, b), 4)) for k, a, b in found]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = False) -> DataFrame:
    """``(id, keep..., spans array<struct<kind, start, end, score>>[, redacted string])`` of every whole text.

    Null and empty texts have no spans (and a null text stays null when redacted); repeated rows give repeated results; an empty table
    gives an empty result. Columns other than those named take no part; ``keep`` may not name ``spans`` or ``redacted``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = [find_spans(t or "") for t in texts]
            columns = [*batch.columns[:-1], pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in spans], pa.list_(_SPAN))]
            if redacted:
                columns.append(pa.array([t if t is None else redact(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "spans", *["redacted"] * redacted])

    rest = carried((id_col, *keep), ("spans", "redacted"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`c{i}` {kinds[c]}" for i, c in enumerate(rest)) + ", spans array<struct<kind:string,start:bigint,end:bigint,score:double>>" + ", redacted string" * redacted
    text = F.col(text_col).cast("string") if redacted else text_of(text_col)
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], text.alias("text")).mapInArrow(run, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(rest)})


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
