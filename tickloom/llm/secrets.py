"""Secret scans: three exact patterns, and sliding-window Shannon entropy per character class over candidate strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha256_hex, span_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is too short fails at every later start inside it too, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Windows of a string that slide as one piece.
STRETCH = 1024


@dataclass(frozen=True)
class CharClass:
    """Strings of these characters with a digit are candidates from a window's length on; a window over the threshold is a finding."""

    name: str
    pattern: str
    window: int
    bits: float


#: Of 20 random hex digits 4 % are under 3.0 bits, of 20 random letters and digits 1 % under 3.7.
CLASSES = (CharClass("hex", "0-9a-fA-F", 20, 3.0), CharClass("base64", r"A-Za-z0-9+/=_-", 20, 3.7))
#: A window inside a match of these forms, or that touches a match of these words, is known not to be of a secret.
ALLOWED_FORMS = (r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",)
ALLOWED_WORDS = (r"(?i:example|sample|placeholder|changeme|xxxx)", "0123456789", r"(?i:abcdefgh)")
#: Pieces between the marks of a string; a window of nothing but plain ones, words of one case with up to four digits or whole numbers, is an identifier.
_PIECE, _PLAIN = re.compile(r"[^-_/+=]+"), re.compile(r"(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})?[0-9]{0,4}|[0-9]+")


def window_entropies(strings: list[str], window: int) -> list[np.ndarray]:
    """Bits of each window of each string. All slide together, long ones in overlapping pieces: counts change by the character that leaves and the one that enters."""
    pieces = [(i, s[k : k + STRETCH + window - 1]) for i, s in enumerate(strings) for k in range(0, max(1, len(s) - window + 1), STRETCH)]
    out: list[list[np.ndarray]] = [[] for _ in strings]
    for k in range(0, len(pieces), 512):
        part = pieces[k : k + 512]
        n = np.array([len(s) for _, s in part])
        codes = np.zeros((len(part), int(n.max())), np.uint8)
        for row, (_, s) in enumerate(part):
            codes[row, : len(s)] = np.frombuffer(s.encode("latin-1"), np.uint8)
        order = np.argsort(-n, kind="stable")
        codes, longest = codes[order], n[order]
        rows = np.arange(len(part))
        counts = np.zeros((len(part), 256), np.int32)
        for at in range(window):
            counts[rows, codes[:, at]] += 1
        term = np.zeros(window + 1)
        term[1:] = np.arange(1, window + 1) * np.log2(np.arange(1, window + 1))
        totals = np.zeros((len(part), codes.shape[1] - window + 1))
        totals[:, 0] = total = term[counts].sum(1)
        for at in range(window, codes.shape[1]):
            live = rows[: int(np.searchsorted(-longest, -at, side="left"))]  # the longest come first
            for column, change in ((codes[live, at - window], -1), (codes[live, at], 1)):
                before = counts[live, column]
                total[live] += term[before + change] - term[before]
                counts[live, column] += change
            totals[live, at - window + 1] = total[live]
        bits = np.log2(window) - totals / window
        for place in np.argsort(order, kind="stable"):
            i, s = part[order[place]]
            out[i].append(bits[place, : len(s) - window + 1])
    return [np.concatenate(x) for x in out]


def candidates(text: str, cls: CharClass) -> Iterator[tuple[int, int]]:
    """Whole runs of the class that hold a digit and reach the window's length."""
    run, digit, at = re.compile(f"[{cls.pattern}]*"), re.compile("[0-9]"), 0
    inside = re.compile(f"[{cls.pattern}]")
    while m := digit.search(text, at):
        start = m.start()
        while start > at and inside.match(text, start - 1):
            start -= 1
        at = run.match(text, m.end()).end()
        if at - start >= cls.window:
            yield start, at


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def suppressed(run: str, window: int, forms: tuple[re.Pattern, ...], words: tuple[re.Pattern, ...]) -> np.ndarray:
    """Whether each window of a run is on the allow-list. Every pass is linear in the run."""
    n = len(run) - window + 1
    odd = np.zeros(len(run) + 1, np.int64)
    for m in _PIECE.finditer(run):
        if not _PLAIN.fullmatch(run, *m.span()):
            odd[m.start() + 1 : m.end() + 1] = 1
    odd = odd.cumsum()
    out = odd[window:] == odd[:n]
    steps = np.zeros(n + 1, np.int64)
    for p in forms:
        for m in p.finditer(run):
            if m.end() - m.start() >= window:  # first and last window inside
                steps[m.start()] += 1
                steps[m.end() - window + 1] -= 1
    for p in words:
        for m in p.finditer(run):
            first, last = max(0, m.start() - window + 1), min(m.end(), n) - 1
            if first <= last:
                steps[first] += 1
                steps[last + 1] -= 1
    return out | (steps[:n].cumsum() > 0)


def entropy_spans(texts: list[str], classes: tuple[CharClass, ...] = CLASSES, forms: tuple[str, ...] = ALLOWED_FORMS, words: tuple[str, ...] = ALLOWED_WORDS) -> list[list[tuple[str, int, int]]]:
    """For each text the windows over their class's threshold that are not allowed, those of all classes that overlap or touch joined."""
    calm, known = tuple(map(re.compile, forms)), tuple(map(re.compile, words))
    hot: list[list[tuple[int, int]]] = [[] for _ in texts]
    for cls in classes:
        where = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, cls)]
        for (i, a, b), bits in zip(where, window_entropies([texts[i][a:b] for i, a, b in where], cls.window), strict=True):
            at = np.flatnonzero((bits >= cls.bits) & ~suppressed(texts[i][a:b], cls.window, calm, known))
            if len(at):
                cuts = np.flatnonzero(np.diff(at) > cls.window) + 1
                hot[i] += [(a + int(g[0]), a + int(g[-1]) + cls.window) for g in np.split(at, cuts)]
    return [[("entropy", a, b) for a, b in joined(spans)] for spans in hot]


def joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Unions of spans that overlap or touch, in order."""
    start = end = -1
    for a, b in sorted(spans):
        if a > end:
            if end >= 0:
                yield start, end
            start, end = a, b
        end = max(end, b)
    if end >= 0:
        yield start, end


def secret_scan(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, forms: tuple[str, ...] = ALLOWED_FORMS, words: tuple[str, ...] = ALLOWED_WORDS) -> DataFrame:
    """One row for every row of docs: doc_id, the counts of the three patterns, base_sha256 over their spans, and all spans as text.

    Offsets are code points, ends exclusive. A null text counts as empty: no spans, the digest of nothing. Repeated rows and null
    ids stay; extra columns are ignored; an empty table gives an empty result. Every candidate is scored, also inside spans of the
    patterns; entropy spans have their own offsets and never change those. Texts are scanned whole, in linear time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [ordered(base_spans(t)) for t in texts]
                more = entropy_spans(texts, classes, forms, words)
                count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), count("assign"), count("access"), count("hex"), pa.array([sha256_hex(span_text(b).encode()) for b in base], pa.string()), pa.array([span_text(ordered(b + m)) for b, m in zip(base, more, strict=True)], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.selectExpr("cast(doc_id as long)", "cast(text as string)").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
