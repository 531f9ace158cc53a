"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.llm.common import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")

# Each pattern takes a run of its characters whole and then asks whether it goes on as a match; a run that does not is
# passed over at once, so that long runs cost no more than their length.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?[ ./-]?[0-9][0-9 ./-]{4,12}[0-9](?![0-9-])")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Score of a confirmed pattern alone, and the words that raise or lower it.  Fixed values.
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "tel": 0.2}
_NEAR = {
    "email": {"mail", "email", "contact", "write", "address", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "client", "login", "adresse"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "carte", "tarjeta", "karte", "kreditkarte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "tel": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"},
}
_AGAINST = {"version", "isbn", "issn", "order", "invoice", "serial", "section", "page", "build", "part"}
#: Code points looked at before and after a span; words against it count only close before it.
BEFORE, AFTER, CLOSE, FLOOR = 40, 20, 15, 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and not overlapping in each kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text) if "." in text else ():
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def _iban(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _IBAN.finditer(text):
        end = m.end()
        while True:   # words after the number may look like its going on: drop them from the right
            s = text[m.start():end].replace(" ", "")
            if len(s) < 15:
                break
            if mod97(s):
                yield m.start(), end, "iban"
                break
            end = text.rfind(" ", m.start(), end)
            if end < 0:
                break


def _score(text: str, start: int, end: int, kind: str) -> float:
    words = lambda a, b: {w.lower() for w in _LETTERS.findall(text[max(0, a):b])}
    near = words(start - BEFORE, start) | words(end, end + AFTER)
    against = words(start - CLOSE, start) & _AGAINST
    return min(1.0, max(0.0, _PRIOR[kind] + 0.3 * bool(near & _NEAR[kind]) - 0.3 * bool(against)))


_ANY = re.compile(r"[0-9@]")


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Base spans, and all spans with their scores; both by start, then kind.

    Spans that the base does not know need a checksum or context that brings their score to FLOOR, and those without
    a checksum must not touch another span.  Base spans stay whatever their score.
    """
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    more = list(_iban(text))
    for kind, pattern in (("ssn", _SSN), ("tel", _TEL)):
        taken = sorted((s, e) for s, e, _ in [*base, *more])
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))   # the farthest end so far
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())
            if not (before and reach[before - 1] > m.start()) and 7 <= len(_digits(m[0])) <= 13 and _score(text, m.start(), m.end(), kind) >= FLOOR:
                more.append((m.start(), m.end(), kind))
    both = [(*s, _score(text, *s)) for s in [*base, *more]]
    return sorted(base, key=order), sorted(both, key=order)


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in spans)


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, n_more, scores) of every row.

    Offsets are code points, ends exclusive.  Null text counts as empty: no spans, the checksum of nothing.  Each row
    is looked at alone, so repeated rows repeat; columns besides id and text are not read.
    """
    kinds = ", ".join(f"n_{k} long" for k in BASE)

    @F.pandas_udf(f"{kinds}, base_sha256 string, spans string, n_more long, scores string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, both = find(t)
            rows.append([*[sum(s[2] == k for s in base) for k in BASE], hashlib.sha256(_joined(base).encode()).hexdigest(),
                         _joined(both), len(both) - len(base), ",".join(f"{s[3]:.2f}" for s in both)])
        return pd.DataFrame(rows, columns=[*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_more", "scores"])

    return docs.select(F.col(doc_id).alias("doc_id"), scan(text_of(text)).alias("f")).select("doc_id", "f.*")
