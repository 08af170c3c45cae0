"""Secret scans: fixed patterns, and windows of high Shannon entropy for each character class."""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct, text_batches
from .pii import Taken

# The base patterns that results must follow.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Character class: runs to look at, window width, least bits per character in a window.
CLASSES = {
    "hex": (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}"), 20, 3.0),
    "alnum": (re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"), 20, 3.6),
    "base64": (re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}"), 24, 4.0),
}
#: Strings that look random and are no secrets, wherever they stand: UUIDs, dates with times, placeholders, alphabets in order.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:+Z-]*)?"
    r"|(?:example|placeholder|changeme|xxxx+|your[_-])|(?:0123456789|abcdefghij)[0-9a-z]*",
    re.I | re.A,
)
SWITCHES = 0.35  # share of steps between neighbouring letters that change case, and of letters of the rarer case; words, also in camel case, have fewer
RESULT = struct("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def window_entropy(s: str, width: int):
    """Bits per character of each window of ``width`` characters, by counts kept up to date.

    H = log2 w - (sum of c log2 c) / w, and a step changes the terms of two characters only.
    """
    if len(s) < width:
        return
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, top = 0.0, math.log2(width)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += terms[c + 1] - terms[c]
        if i >= width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += terms[c - 1] - terms[c]
        if i >= width - 1:
            yield top - total / width


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Merged windows of high entropy in any class.

    A window counts for nothing where it meets a stretch that the allow-list names, or where it
    has no digit (in hex: no letter) and its letters change case as seldom as words do. What else
    stands in the same run is looked at all the same.
    """
    allowed = None
    found = []
    for name, (pattern, width, least) in CLASSES.items():
        for m in pattern.finditer(text):
            if allowed is None:
                allowed = Taken((x.start(), x.end()) for x in ALLOW.finditer(text))
            run, first = m[0], m.start()
            digits, switches = _sums(c.isdigit() for c in run), _sums(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in itertools.pairwise(run))
            upper, lower = _sums(map(str.isupper, run)), _sums(map(str.islower, run))
            start = end = -1
            for i, bits in enumerate(window_entropy(run, width)):
                if bits < least or allowed.meets(first + i, first + i + width):
                    continue
                n = digits[i + width] - digits[i]
                if n == width:
                    continue
                rarer = min(upper[i + width] - upper[i], lower[i + width] - lower[i])
                if n == 0 and (name == "hex" or rarer < SWITCHES * width or switches[i + width - 1] - switches[i] < SWITCHES * (width - 1)):
                    continue
                if start < 0:
                    start = i
                elif i > end:
                    found.append((first + start, first + end))
                    start = i
                end = i + width
            if start >= 0:
                found.append((first + start, first + end))
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _sums(flags) -> list[int]:
    return [0, *itertools.accumulate(map(int, flags))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text; null is the empty text.

    An entropy span that a base span covers whole adds nothing and is left out.
    """
    text = text or ""
    base = base_spans(text)
    more, top, reach = [], 0, -1
    for a, b in entropy_spans(text):  # both in order; of the base spans that start by a, the one that reaches furthest
        while top < len(base) and base[top][0] <= a:
            reach = max(reach, base[top][2])
            top += 1
        if reach < b:
            more.append((a, 3, b))
    return base, sorted(base + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@F.pandas_udf(RESULT)
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans = scan(text)
        n = [0, 0, 0]
        for _, k, _ in base:
            n[k] += 1
        rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def scan_secrets(df: DataFrame, text: str | Column = "text", out: str = "secrets") -> DataFrame:
    """Add a struct column ``out`` with counts and spans of the secrets in a text column.

    Row by row, without a shuffle. Null and empty texts have no spans; whole texts are read. A
    column of the name ``out`` is replaced; all other columns stay. Equal rows get equal results.
    """
    text_batches(df.sparkSession)
    return df.withColumn(out, _scan(F.col(text) if isinstance(text, str) else text))
