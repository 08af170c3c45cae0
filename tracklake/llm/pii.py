"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import bisect
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct, text_batches

# The base patterns that results must follow.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "credential")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: A person's access token: hex digits, which need a word beside them that says so.
CREDENTIAL = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")

#: Score of a span from its pattern and checksum alone.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "credential": 0.3}
#: Words near a span that raise its score, and words that lower it.
CONTEXT = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
    "credential": ("token", "password", "passwd", "secret", "key", "login"),
}
AGAINST = ("example", "version", "order", "invoice", "sample", "serial")
NEAR, STEP, LEAST = 40, 0.2, 0.5  # characters on either side, what a word moves a score by, the least score
WORDS = re.compile(r"[a-z]+")
RESULT = struct("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_spans long, has_pii boolean")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    left = 0
    for ch in s[4:] + s[:4]:
        v = int(ch, 36)
        left = (left * (100 if v > 9 else 10) + v) % 97
    return left == 1


def _emails(text: str):
    """Matches of local@domain in one walk over the @ signs, so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at  # no later match starts left of this @
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) of the base patterns' matches."""
    out = [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, a step up for each side word that supports it, down for one that speaks against it."""
    near = set(WORDS.findall(f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    up, down = any(w in near for w in CONTEXT[kind]), any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, SCORES[kind] + STEP * up - STEP * down)), 2)


class Taken:
    """Stretches of a text, in order and merged, so that one look tells whether a span meets any."""

    def __init__(self, spans):
        self.first: list[int] = []
        self.last: list[int] = []
        for a, b in sorted(spans):
            if self.last and a < self.last[-1]:
                self.last[-1] = max(self.last[-1], b)
            else:
                self.first.append(a)
                self.last.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.first, b)
        return i > 0 and self.last[i - 1] > a


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans, and all spans with scores; null is the empty text.

    Base spans always stay. IBANs need mod-97, and they, social security numbers and credentials
    need a score of 0.5 after context; those that overlap a base span are left out.
    """
    text = text or ""
    base = base_spans(text)
    spans = [(k, a, b, score(text, KINDS[k], a, b)) for k, a, b in base]
    more = [(4, m.start(), m.end()) for m in IBAN.finditer(text) if mod97(m[0])]
    more += [(5, m.start(), m.end()) for m in SSN.finditer(text)] if "-" in text else []
    more += [(6, m.start(), m.end()) for m in CREDENTIAL.finditer(text)]
    if more:
        taken = Taken((a, b) for _, a, b in base)
        for k, a, b in more:
            if not taken.meets(a, b) and (s := score(text, KINDS[k], a, b)) >= LEAST:
                spans.append((k, a, b, s))
    return sorted(base), sorted(spans)


@F.pandas_udf(RESULT)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans = scan(text)
        n = [0, 0, 0, 0]
        for k, _, _ in base:
            n[k] += 1
        digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        rows.append((*n, digest, ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans), ",".join(f"{s:g}" for *_, s in spans), len(spans), any(s >= LEAST for *_, s in spans)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_spans", "has_pii"])


def scan_pii(df: DataFrame, text: str | Column = "text", out: str = "pii") -> DataFrame:
    """Add a struct column ``out`` with counts, spans and scores of personal data in a text column.

    ``has_pii`` says whether a span of any kind has a score of 0.5 or more after context.

    Row by row, without a shuffle. Null and empty texts have no spans; whole texts are read. A
    column of the name ``out`` is replaced; all other columns stay. Equal rows get equal results.
    """
    text_batches(df.sparkSession)
    return df.withColumn(out, _scan(F.col(text) if isinstance(text, str) else text))
