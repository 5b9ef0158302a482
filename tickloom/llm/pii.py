"""Personal data: four exact patterns, and a linear-chain conditional random field over word-shape features.

The field is trained here from a small labelled table and decoded by Viterbi, all chains of a batch at once in numpy.
Every kind that it knows needs a digit or an @, so chains are the stretches of tokens near those characters; tokens
outside chains have no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha256_hex, span_text

KINDS = ("email", "ip", "card", "phone", "crf_email", "crf_ip", "crf_card", "crf_phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match always begins where its digits begin, and gives back none of them.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost, non-overlapping: at each @ the local part is all that the pattern takes to its left, back to the last match."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        else:
            last = at + 1 if start < at else last
        at = m.end() if m else at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = list(emails(text))
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# Conditional random field

LABELS = ("O", *(f"{p}-{k}" for k in ("email", "ip", "card", "phone") for p in "BI"))
#: Labelled table: text with each entity as {kind|text}. Values are invented or reserved for examples; no row is taken from a corpus.
LABELLED = (
    "write to {email|anna.b@mail.example.org} or call {phone|+1 (202) 555-0143} today",
    "mail {email|j_doe99@post.example.com}, thanks",
    "reach {email|x@y.example.net} and {email|info@shop4.example.com} soon.",
    "contact: {email|first-last@sub.mail.example.co}",
    "old: {email|kim.7@example.com}; new: {email|lee@example.org}",
    "my address {email|7@box.example.com} is open",
    "call {phone|+44 20 7946 0958} at 9 or {phone|+1 202-555-0199} at 10",
    "phone {phone|+49 (30) 5550-1234}, room 12",
    "tel {phone|(202) 555-0187} or {phone|202-555-0134}",
    "ring {phone|+1.415.555.0100} now",
    "dial {phone|+1 (303) 555-0172} please",
    "seen: {phone|+1 (404) 555-0121} {card|4000056655665556} and more",
    "{phone|(505) 555-0110} {phone|(606) 555-0119} both ring",
    "from {ip|192.168.10.4} to {ip|10.0.0.1} in 5 hops",
    "host {ip|203.0.113.77} answered, {ip|198.51.100.2} did not",
    "server {ip|192.0.2.145} is down",
    "paid with {card|4111 1111 1111 1111} on 3 May",
    "cards {card|4111111111111111} {card|5500005555555559} on file",
    "card {card|4012-8888-8888-1881}, valid to 12/27",
    "visa {card|4242424242424242} was used",
    "number {card|6011000990139424} {card|6011000990139424} twice",
    "then {card|5105105105105100} {phone|+1 (707) 555-0163} follow",
    "version 1.2.3 of 2024 has 17 parts",
    "chapter 4.1 and 4.2, pages 100-120",
    "on 2024-03-15 at 10:45 we met 3 people",
    "price 1,299.00 for 12 pieces, 3 for 2",
    "commit 5d41402abc4b2a76b9719d911017c592a7e63c01 is old",
    "token = 9f86d081884c7d659a2feaa0c55ad015 expires 2030",
    "item 12 | 13 | 14 | 15",
    "the year 1999 had 365 days, 2000 had 366",
    "call me @ noon, see @ten",
    "license version 2.0. section 3.1.4.1",
    "order 123456 of 7890123 came in 2 boxes",
    "room 5551234 and code 8842",
    "isbn 978-3-16-148410-0 has 13 digits",
)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[\W_]|\d")
_TAG = re.compile(r"\{(email|ip|card|phone)\|([^}]*)\}")
#: Characters of a chain on either side of a digit or @, then on to white space; tokens that one step of the decoder holds, unless one chain has more.
REACH, CELLS = 40, 200_000


@dataclass(frozen=True)
class Field:
    """Weights: feature name to row, emissions of each row and label, transitions between labels."""

    rows: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray


def shape(token: str) -> str:
    """Word shape: what kind of characters, how many of them; a mark stands for itself."""
    if token.isspace():
        return "s" if token == " " else "ss"
    if token[0].isdecimal():
        return f"d{min(len(token), 5) if len(token) < 16 else 16 if len(token) <= 19 else 20}"
    if token[0].isalpha():
        return ("x" if token.islower() else "X") + ("1" if len(token) == 1 else "2" if len(token) <= 3 else "4")
    return token if token.isascii() else "?"


def features(shapes: Sequence[str]) -> list[list[str]]:
    """Of each token: its shape, those two before and after, the pairs with its neighbours, and the marks on its word."""
    padded = ["^", "^", *shapes, "$", "$"]
    words, at = [], 0  # marks of the stretch without spaces that the token is in
    word_of = [0] * len(shapes)
    for i, s in enumerate(shapes):
        if s in ("s", "ss"):
            at = len(words) + 1
        if at >= len(words):
            words.extend([""] * (at - len(words) + 1))
        word_of[i] = at
        if s in ("@", "+", "(", "-", ".") and s not in words[at]:
            words[at] += s
    dots = [0] * len(words)
    for i, s in enumerate(shapes):
        dots[word_of[i]] += s == "."
    return [[f"0{padded[i + 2]}", f"-{padded[i + 1]}", f"+{padded[i + 3]}", f"<{padded[i]}", f">{padded[i + 4]}", f"-{padded[i + 1]}0{padded[i + 2]}", f"0{padded[i + 2]}+{padded[i + 3]}", f"-{padded[i + 1]}0{padded[i + 2]}+{padded[i + 3]}", f"w{words[word_of[i]]}{min(dots[word_of[i]], 4)}"] for i in range(len(shapes))]


def _parsed(line: str) -> tuple[list[str], list[int]]:
    plain, marks, at = "", [], 0
    for m in _TAG.finditer(line):
        plain += line[at : m.start()]
        marks.append((len(plain), len(plain) + len(m[2]), m[1]))
        plain, at = plain + m[2], m.end()
    plain += line[at:]
    shapes, labels = [], []
    for m in _TOKEN.finditer(plain):
        kind = next(((k, m.start() == a) for a, b, k in marks if a <= m.start() < b), None)
        shapes.append(shape(m[0]))
        labels.append(LABELS.index(f"{'B' if kind[1] else 'I'}-{kind[0]}") if kind else 0)
    return shapes, labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def slopes(data: list[tuple[list[list[int]], np.ndarray]], emission: np.ndarray, transition: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labelled chains and its gradients, by forward and backward sums."""
    gain, up_e, up_t = 0.0, np.zeros_like(emission), np.zeros_like(transition)
    for fs, y in data:
        idx = np.array(fs)
        score = emission[idx].sum(1)
        n = len(y)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = score[0]
        for i in range(1, n):
            ahead[i] = score[i] + _log_sum(ahead[i - 1][:, None] + transition, 0)
        for i in range(n - 2, -1, -1):
            back[i] = _log_sum(transition + (score[i + 1] + back[i + 1])[None], 1)
        total = _log_sum(ahead[-1], 0)
        gain += score[np.arange(n), y].sum() + transition[y[:-1], y[1:]].sum() - total
        error = -np.exp(ahead + back - total)
        error[np.arange(n), y] += 1
        np.add.at(up_e, idx.ravel(), np.repeat(error, idx.shape[1], axis=0))
        pair = ahead[:-1, :, None] + transition[None] + (score + back)[1:, None, :] - total
        up_t -= np.exp(pair).sum(0)
        np.add.at(up_t, (y[:-1], y[1:]), 1)
    return float(gain), up_e, up_t


def train(lines: Sequence[str] = LABELLED, rounds: int = 150, rate: float = 0.3, penalty: float = 0.01) -> Field:
    """Gradient ascent on the penalised likelihood; Adagrad steps, the same result each time."""
    data = []
    rows: dict[str, int] = {}
    for line in lines:
        shapes, labels = _parsed(line)
        data.append(([[rows.setdefault(f, len(rows)) for f in fs] for fs in features(shapes)], np.array(labels)))
    emission, transition = np.zeros((len(rows), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    grown_e, grown_t = np.full_like(emission, 1e-6), np.full_like(transition, 1e-6)
    for _ in range(rounds):
        _, up_e, up_t = slopes(data, emission, transition)
        up_e, up_t = up_e - penalty * emission, up_t - penalty * transition
        grown_e += up_e**2
        grown_t += up_t**2
        emission += rate * up_e / np.sqrt(grown_e)
        transition += rate * up_t / np.sqrt(grown_t)
    return Field(rows, emission, transition)


def viterbi(scores: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """Best labels of each chain; all chains step together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    k = 0
    while k < len(order):
        part = order[k : k + max(1, min(256, CELLS // max(1, len(scores[order[k]]))))]
        k += len(part)
        n = np.array([len(scores[i]) for i in part])
        padded = np.zeros((len(part), int(n[0]), len(LABELS)))
        for row, i in enumerate(part):
            padded[row, : n[row]] = scores[i]
        best, came = padded[:, 0].copy(), np.zeros(padded.shape, np.int8)
        for t in range(1, int(n[0])):
            live = int((n > t).sum())
            paths = best[:live, :, None] + transition[None]
            came[:live, t] = paths.argmax(1)
            best[:live] = paths.max(1) + padded[:live, t]
        for row, i in enumerate(part):
            at, labels = int(best[row].argmax()), np.zeros(n[row], int)
            for t in range(n[row] - 1, -1, -1):
                labels[t] = at
                at = int(came[row, t, at])
            out[i] = labels
    return out


_TRIGGER, _GAP = re.compile("[0-9@]"), re.compile(r"\s")


def chains(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text within REACH characters of a digit or @, and on to white space, so that no word is cut; they don't overlap."""
    at, n = 0, len(text)
    while m := _TRIGGER.search(text, at):
        start = max(at, m.start() - REACH)
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while True:
            while (m2 := _TRIGGER.search(text, end, min(n, end + 2 * REACH))) is not None:
                end = m2.end()
            gap = _GAP.search(text, min(n, end + REACH))
            at = gap.start() if gap else n
            far = _TRIGGER.search(text, end, at)  # in a long word's rest
            if far is None:
                break
            end = far.end()
        yield start, at


def free(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans, in order and apart, that overlap none of taken; one pass over both."""
    places, k, out = sorted((a, b) for _, a, b in taken), 0, []
    reach = list(accumulate((b for _, b in places), max))  # furthest end of those that begin up to here
    for s in spans:
        while k < len(places) and places[k][0] < s[2]:
            k += 1
        if k == 0 or reach[k - 1] <= s[1]:
            out.append(s)
    return out


def crf_spans(texts: list[str], taken: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Decoded entities of each text that touch no span already taken."""
    places, tokens, scores = [], [], []
    width = len(LABELS)
    known: dict[str, np.ndarray] = {}
    none = np.zeros(width)
    for i, text in enumerate(texts):
        for a, b in chains(text):
            found = [(m.start(), m.end(), shape(m[0])) for m in _TOKEN.finditer(text, a, b)]
            if not found:
                continue
            rows = []
            for fs in features([s for _, _, s in found]):
                total = none
                for f in fs:
                    if f not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[f] = field.emission[field.rows[f]] if f in field.rows else none
                    total = total + known[f]
                rows.append(total)
            places.append(i)
            tokens.append(found)
            scores.append(np.array(rows))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, found, labels in zip(places, tokens, viterbi(scores, field.transition), strict=True):
        start = None
        for (a, b, _), y in zip([*found, (0, 0, "")], [*labels.tolist(), 0], strict=True):
            name = LABELS[y]
            if start is not None and (name[0] != "I" or name[2:] != start[0][4:]):
                if _plausible(start[0], texts[i][start[1] : start[2]]):
                    out[i].append(tuple(start))
                start = None
            if name[0] == "B":
                start = [f"crf_{name[2:]}", a, b]
            elif name[0] == "I" and start is not None:
                start[2] = b
    return [free(s, t) for s, t in zip(out, taken, strict=True)]


def _plausible(kind: str, text: str) -> bool:
    """What any entity of the kind must hold, however it is written."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "crf_email":
        return "@" in text[1:-1]
    if kind == "crf_card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "crf_phone" else text.count(".") == 3


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, the counts of the four patterns, base_sha256 over their spans, and all spans as text.

    Offsets are code points, ends exclusive. A null text counts as empty. Repeated rows and null ids stay; extra columns are
    ignored; an empty table gives an empty result. Texts are read whole in linear time.
    """
    field = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [ordered(base_spans(t)) for t in texts]
                more = crf_spans(texts, base, field)
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS[:4]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([sha256_hex(span_text(b).encode()) for b in base], pa.string()), pa.array([span_text(ordered(b + m)) for b, m in zip(base, more, strict=True)], pa.string())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return docs.selectExpr("cast(doc_id as long)", "cast(text as string)").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
