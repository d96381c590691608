"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, digits, plus signs, schemes and
identifier cues in one pass; a deterministic parser beside each anchor expands and validates the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import span_digest, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}
SPANS = "array<struct<kind:string,start:long,end:long>>"

# Each parser starts at a fixed place, so none of them scans a long run more than once.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://[^\s/@:]+:([^\s/@]+)@")
_IBAN = re.compile(r"[\x20:#=.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num|id))?[\x20.:#=]{0,4}([0-9](?:[\x20-]?[0-9]){6,17})(?![0-9])", re.I)

IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "ssn", "routing", "passport")


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(text: str) -> int:
    """The end of the longest beginning of text that is an IBAN, or 0."""
    for end in range(len(text), 14, -1):
        s = text[:end].replace(" ", "")
        if text[end - 1] != " " and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return end
    return 0


def automaton() -> ahocorasick.Automaton:
    words = {"@": "@", "+": "+", "://": ":"} | {str(d): "0" for d in range(10)}
    for cues, mark in ((IBAN_CUES, "i"), (ACCOUNT_CUES, "a")):
        for w in cues:
            words |= {w: mark, w.upper(): mark, w.capitalize(): mark}
    a = ahocorasick.Automaton()
    for w, mark in words.items():
        a.add_word(w, (mark, len(w)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then kind."""
    out: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = seen = account_end = 0
    n = len(text)
    for last, (mark, size) in anchors.iter(text):
        at = last - size + 1
        if mark == "0":
            if at < seen:
                continue  # inside a run of digits that has been parsed
            seen = _DIGITS.match(text, at).end()
            if at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                    out.append(("ip", at, ip_end))
            if at >= card_end:
                card_end = (m := _CHAIN.match(text, at)).end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", at, card_end))
        elif mark == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append(("email", start, email_end))
        elif mark == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, phone_end))
        elif mark == ":":
            if m := _LOGIN.match(text, at):
                out.append(("login", at + 3, m.end() - 1))
        elif mark == "i":
            if (m := _IBAN.match(text, last + 1)) and (end := _iban(m[1])):
                out.append(("iban", m.start(1), m.start(1) + end))
        elif at >= account_end and last + 1 < n and (m := _ACCOUNT.match(text, last + 1)):
            account_end = m.end(1)
            out.append(("account", m.start(1), account_end))
    out.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return out


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): spans array<struct<kind, start, end>> in code points, end exclusive, by start and then kind.

    Base kinds are email, ip, card and phone; login (credentials in a URL), iban and account come from schemes and
    cues. A null text counts as empty and has no spans; an empty table gives no rows; repeated rows each give
    theirs; texts are scanned whole, one at a time, in one pass; other columns of docs are ignored.
    """
    kind = dict(docs.select(F.col(id_col).alias(id_col)).dtypes)[id_col]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = ([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "", anchors)] for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], [id_col, "spans"])

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"`{id_col}` {kind}, spans {SPANS}")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """scan_pii of all documents, whose docstring defines every case."""
    return span_digest(scan_pii(table(spark, sf_dir, "documents")), "doc_id", "spans", BASE)
