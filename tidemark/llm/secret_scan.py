"""Secret scans: fixed patterns, and windows of high entropy inside candidate strings.

Fixed patterns find assignments, access keys and long hexadecimal runs. The entropy scan slides a window over
every candidate string (a run of characters of one class) and keeps the Shannon entropy of the
window by incremental counts: one character enters, one leaves. Windows above the threshold of their class merge to
spans. A span is suppressed when every window of it touches a placeholder or a named checksum; candidates of one kind of letter
are left out as a whole. Rows are scanned one by one; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Kinds of the fixed patterns in their order; entropy spans come after them.
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of one class, and the bits a window must reach."""

    name: str
    pattern: re.Pattern
    window: int
    bits: float


#: Random hexadecimal digits give 3.4 to 3.9 bits in 24 characters, random base64 digits 4.1 to 4.5;
#: letters of words and repeated patterns stay below.
CLASSES = (
    CharacterClass("hex", re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])"), 24, 3.1),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
)
#: Candidates that are no secret although they may look random: one kind of character only, a word list, an address or path of letters.
ALLOWED = (re.compile(r"[A-Za-z/_=+-]+"), re.compile(r"[0-9]+"))
#: Placeholders and alphabets, with up to eight letters and digits that they are glued to.
_PLACEHOLDER = re.compile(
    r"[A-Za-z0-9]{0,8}(?:(?:example|placeholder|dummy|xxxx|changeme|abcdefgh|01234567)[A-Za-z0-9]{0,8}|your[_-])", re.ASCII | re.IGNORECASE
)
#: Integrity checksums with their algorithm named, and the bytes of its digests.
_CHECKSUM = re.compile(r"(?<![A-Za-z0-9])(sha1|sha256|sha384|sha512|md5)[-_=]([A-Za-z0-9+/_-]+=*)", re.ASCII | re.IGNORECASE)
_DIGEST = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}
_XLOG = [0.0] + [n * log2(n) for n in range(1, 4097)]


def excused(candidate: str) -> list[tuple[int, int]]:
    """Stretches of placeholders, and of checksums no longer than a digest of their algorithm; by start, apart from each other."""
    found = [m.span() for m in _PLACEHOLDER.finditer(candidate)]
    for m in _CHECKSUM.finditer(candidate):
        size = _DIGEST[m[1].lower()]
        if len(m[2]) <= (2 * size if re.fullmatch("[0-9A-Fa-f]+", m[2]) else -(-size // 3) * 4):
            found.append(m.span())
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def high_entropy(candidate: str, window: int, bits: float, spared: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy is at least ``bits``, without spans whose windows all touch ``spared``.

    H = log2(w) - sum(c * log2(c)) / w; the sum changes by two terms when the window moves.
    """
    if len(candidate) < window:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    # The bound on the sum that belongs to `bits`, with room for rounding.
    most = window * (log2(window) - bits) + 1e-9
    spans: list[tuple[int, int]] = []
    counted: list[bool] = []  # has the span a window that touches nothing spared
    at = 0
    for end, entering in enumerate(candidate):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += _XLOG[c + 1] - _XLOG[c]
        start = end - window
        if start >= 0:
            c = counts[candidate[start]]
            counts[candidate[start]] = c - 1
            total += _XLOG[c - 1] - _XLOG[c]
        if end >= window - 1 and total <= most:
            while at < len(spared) and spared[at][1] <= start + 1:
                at += 1
            free = at == len(spared) or spared[at][0] > end
            if spans and spans[-1][1] >= start + 1:
                spans[-1] = (spans[-1][0], end + 1)
                counted[-1] |= free
            else:
                spans.append((start + 1, end + 1))
                counted.append(free)
    return [s for s, free in zip(spans, counted) if free]


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each pattern that do not overlap; those too short are dropped after matching."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind in CLASSES:
        for m in kind.pattern.finditer(text):
            if not any(a.fullmatch(m[0]) for a in ALLOWED):
                spans = high_entropy(m[0], kind.window, kind.bits, excused(m[0]))
                found += [(m.start() + a, m.start() + b, "entropy") for a, b in spans]
    return found


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; offsets count code points, end excluded.

    All spans of the fixed patterns stay. An entropy span is added where no other span covers it.
    """
    if not text:
        return []
    order = {k: n for n, k in enumerate((*KINDS, "entropy"))}
    found = fixed_spans(text)
    for span in sorted(set(entropy_spans(text)), key=lambda s: (s[0], -s[1])):
        if not any(a <= span[0] and span[1] <= b for a, b, _ in found):
            found.append(span)
    return [(k, a, b) for a, b, k in sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every stretch covered by spans replaced by the kind of the first of them."""
    if not text or not spans:
        return text
    out, at, shown = [], 0, -1
    for kind, start, end in spans:
        if start >= shown:
            out += [text[at:start], f"<{kind}>"]
        at = shown = max(shown, end)
    return "".join([*out, text[at:]])


_FOUND = "redacted string, spans array<struct<kind: string, start: int, end: int>>"


def _scan(texts: pd.Series) -> pd.DataFrame:
    spans = [secret_spans(t) for t in texts]
    return pd.DataFrame({
        "redacted": [redacted(t, s) for t, s in zip(texts, spans)],
        "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans],
    })


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, redacted (the text with its secrets replaced), spans, and the columns ``carry``.

    ``spans`` is an array of (kind, start, end) by start. Null and empty texts have none; a null text stays null.
    Repeated rows and ids are scanned each by itself; other columns are not looked at. Of carried columns, those
    named as one of the results are left out.
    """
    scan = F.pandas_udf(_scan, _FOUND)
    others = [F.col(f"`{c}`").alias(c) for c in carry if c not in (id_col, "redacted", "spans")]
    kept = [F.col(f"`{id_col}`").alias(id_col), *others]
    # A name that no column has.
    at = "_found" + "_" * max(map(len, docs.columns))
    found = docs.select(*kept, scan(F.col(f"`{text_col}`")).alias(at))
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != at], F.col(at)["redacted"].alias("redacted"), F.col(at)["spans"].alias("spans"))
