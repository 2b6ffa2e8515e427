"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col

Span = tuple[str, int, int]

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
RUN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")

#: Character classes with the entropy, in bits for each character, from which a window counts as random, and the kinds of
#: character that it must mix. A window of 20 hex digits or letters has at most 4 or 4.32 bits.
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]+"), 3.0, 2),
    "base64": (re.compile(r"[A-Za-z0-9+/_-]+"), 3.8, 3),
}
#: What looks random and is not: documentation keys, placeholder runs, alphabets, UUIDs, ISO times.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"(?i)example|sample|placeholder|x{6}|0{8}|(?:123456789)|abcdefgh|qwerty",
        r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
        r"^\d{4}-\d\d-\d\dT\d+",
    )
)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlap inside a kind. Lengths that fail drop the match and use
    up its characters, so ``assign`` is matched first and measured then."""
    out: list[Span] = []
    lowered = text.lower()
    if any(h in lowered for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidate_runs(text: str, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of key characters that are at least ``least`` long and hold a digit."""
    at = 0
    while (m := DIGIT.search(text, at)) is not None:
        start = m.start()
        while start > at and text[start - 1] in RUN_CHARACTERS:
            start -= 1
        at = RUN.match(text, m.start()).end()
        if at - start >= least:
            yield start, at


def window_entropies(text: str, window: int) -> Iterator[float]:
    """Shannon entropy of each window of ``window`` characters. A step changes two counts, so the sum of n*log2(n) is
    kept up to date and a window costs the same whatever its length."""
    counts: dict[str, int] = {}
    weight = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weight[n + 1] - weight[n]
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += weight[n - 1] - weight[n]
        if i >= window - 1:
            yield math.log2(window) - total / window


def _mixed(text: str) -> int:
    return any(c.islower() for c in text) + any(c.isupper() for c in text) + any(c.isdigit() for c in text)


def entropy_spans(text: str, window: int = 20, allowed: Sequence[re.Pattern] = ALLOWED) -> list[Span]:
    """Unions of overlapping random windows inside candidate runs. A span is dropped if it does not mix the kinds of
    character of its class, or if it overlaps a match of an allowed pattern in its run."""
    spans: set[tuple[int, int]] = set()
    for start, end in candidate_runs(text, window):
        run = text[start:end]
        # A pattern that is tied to the start of the run speaks for all of it.
        fine = [(start, end) if "^" in p.pattern else (start + m.start(), start + m.end()) for p in allowed for m in p.finditer(run)]
        found: set[tuple[int, int]] = set()
        for pattern, least, kinds in CLASSES.values():
            for piece in pattern.finditer(run):
                if len(piece.group()) < window:
                    continue
                opened = closed = -1
                for i, h in enumerate(window_entropies(piece.group(), window)):
                    if h >= least:
                        if i > closed:
                            if opened >= 0:
                                found.add(_checked(piece, opened, closed, kinds, start))
                            opened = i
                        closed = i + window
                if opened >= 0:
                    found.add(_checked(piece, opened, closed, kinds, start))
        spans |= {f for f in found if not any(f[0] < e and a < f[1] for a, e in fine)}
    spans.discard((-1, -1))
    inside = {s for s in spans if any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)}
    return [("entropy", a, b) for a, b in sorted(spans - inside)]


def _checked(piece: re.Match, opened: int, closed: int, kinds: int, start: int) -> tuple[int, int]:
    found = piece.group()[opened:closed]
    return (start + piece.start() + opened, start + piece.start() + closed) if _mixed(found) >= kinds else (-1, -1)


def scan(text: str | None, window: int = 20) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each ordered by start and then by kind. Entropy spans inside a base span are left out."""
    text = text or ""
    base = base_spans(text)
    found = [s for s in entropy_spans(text, window) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(base, key=order), sorted(base + found, key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(text: Column, window: int = 20) -> Column:
    """array<struct<kind, start, end, base>> of a text in code points, end exclusive; null counts as empty."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long, base: boolean>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "base": k != "entropy"} for k, a, b in scan(t, window)[1]] for t in texts])

    return of(text)


def summary(text: Column, window: int = 20) -> Column:
    """struct(n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of a text; null counts as empty."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = scan(text, window)
            kinds = [k for k, _, _ in every]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in KINDS), digest, listed(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return of(text)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", window: int = 20) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans become one. Null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at, parts = 0, []
            for _, a, b in scan(t, window)[1]:
                if b > at:
                    if a >= at:
                        parts += [t[at:a], mask]
                    at = b
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.select(*[of(col(c)).alias(c) if c == text else col(c) for c in docs.columns])
