"""Personal data: plain patterns, and disguised identifiers found in a normalised text.

Transducers rewrite a text and keep, for every character they emit, the source
span it came from: look-alike letters and digits become ASCII, spelled digits
(English, German, French and Spanish) become digits, and at/dot disguises become @
and '.'.  The same detectors run over the rewritten text, and their spans are mapped
back to source characters.  All steps take time in proportion to the text, or to it
and the logarithm of the number of spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .domains import TOP

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Look-alikes of ASCII letters and digits, beyond the compatibility forms of Unicode.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ո": "n", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without width, which are dropped.
INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits in English, German, French and Spanish; a word of several languages has one value.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled signs in the same languages.
SIGNS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
#: Spelled at signs.
ATS = ("at", "arobase", "arroba")

def _table() -> dict[str, str]:
    """Compatibility forms (full width, mathematical, other digits) of printable ASCII, and the look-alikes."""
    out = {c: "" for c in INVISIBLE} | LOOKALIKES
    for span in ((0x0660, 0x066A), (0x06F0, 0x06FA), (0x0966, 0x0970), (0x2460, 0x2474), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0xFE50, 0xFE70)):
        for c in map(chr, range(*span)):
            d = unicodedata.digit(c, None)
            form = unicodedata.normalize("NFKC", c) if d is None else str(d)
            if len(form) == 1 and "!" <= form <= "~":
                out.setdefault(c, form)
    return out


TABLE = _table()
_ODD = re.compile("[" + "".join(map(re.escape, TABLE)) + "]")
_DOTS = "|".join(w for w, c in SIGNS.items() if c == ".")
_SAID = "|".join([*SPELLED, *SIGNS])
_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s?(?:{'|'.join(ATS)}|@)\s?[\])}}>]\s{{0,3}}", re.I)
_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s?(?:{_DOTS}|\.)\s?[\])}}>]\s{{0,3}}", re.I)
_SPACED = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}(?:({'|'.join(ATS)})|({_DOTS}))\s{{1,3}}(?=[A-Za-z0-9])", re.I)
_SIGN_SAID = re.compile(rf"{_DOTS}|[\[({{<]\s?(?:{'|'.join(ATS)}|@|\.)\s?[\])}}>]", re.I)
_SPOKEN = re.compile(rf"(?<![^\W\d_])(?:{_SAID})(?![^\W\d_])", re.I)
_WORDS = re.compile(rf"(?<![^\W\d_])(?:(?:{_SAID}|[0-9]++|\+|\.)(?![^\W\d_])[\s,-]{{0,3}}){{2,}}", re.I)
_LABELS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
_LABEL = re.compile(r"[A-Za-z0-9.-]+")
_LAST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]")
#: Words that are no domain.
_FILLERS = frozenset(("the", "a", "an", "this", "that", "my", "your", "our", "his", "her", "its", "their", "each", "every", "one"))
_WORD = re.compile(r"[^\W\d_]+|[0-9]+|[+.]")
_FAR = re.compile("[\xa0\xad\u0250-\U0010ffff]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base(text: str) -> list[Span]:
    """Spans of the plain patterns, by kind as listed, then start; non-overlapping within a kind."""
    out: list[Span] = []
    last, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append(("email", s, last := m.end()))
        else:
            last = max(last, p)  # a local part never reaches back over a sign
        p = text.find("@", max(p + 1, last))
    if not _DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x or "0") < 256 for x in (y.lstrip("0") for y in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


class Tape:
    """A text with the source span of each character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)
        self.changed: list[tuple[int, int]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [a, b) by a new string for each edit, in order; new characters stand for the whole of [a, b)."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += self.text[at:a], new
            start += self.start[at:a]
            end += self.end[at:a]
            lo, hi = self.start[a], self.end[b - 1]
            self.changed.append((lo, hi))
            if len(new) == b - a:
                start += self.start[a:b]
                end += self.end[a:b]
            else:
                start += [lo] * len(new)
                end += [hi] * len(new)
            at = b
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(text), start, end


def _spelled(run: re.Match, begins: set[int], ends: set[int]) -> list[tuple[int, int, str]]:
    """Edits that turn the spelled digits of a run into digits and close the gaps beside them; in a run of four or more, all gaps.

    begins, ends: where plain identifiers of the text begin and end.
    """
    parts = [(m.start() + run.start(), m.end() + run.start(), m[0].lower()) for m in _WORD.finditer(run[0])]

    def trim() -> None:
        while parts and (parts[-1][2] in SIGNS or parts[-1][2] in ".+"):
            parts.pop()
        first = 0
        while first < len(parts) and SIGNS.get(parts[first][2], parts[first][2]) == ".":
            first += 1
        del parts[:first]

    trim()
    spelled = sum(w in SPELLED for *_, w in parts)
    if spelled < 4:
        # A lone number word beside an identifier that is plain without it is prose.
        if len(parts) > 1 and parts[-1][2] in SPELLED and parts[-2][2] not in SPELLED and parts[-2][1] in ends:
            parts.pop()
        if len(parts) > 1 and parts[0][2] in SPELLED and parts[1][2] not in SPELLED and parts[1][0] in begins:
            parts.pop(0)
        trim()
    if not any(w.isalpha() for *_, w in parts):
        return []
    edits: list[tuple[int, int, str]] = []
    for k, (a, b, w) in enumerate(parts):
        if k and a > parts[k - 1][1] and (spelled > 3 or w.isalpha() or w == "." or not parts[k - 1][2].isdigit()):
            edits.append((parts[k - 1][1], a, ""))
        if w.isalpha():
            edits.append((a, b, SPELLED.get(w) or SIGNS[w]))
    return edits


def _top(text: str, at: int) -> bool:
    """Whether the label at this place, with what plain dots add to it, begins or ends with a top-level domain."""
    m = _LAST.match(text, at)
    labels = m[0].lower().split(".") if m else [""]
    return labels[0] in TOP or labels[-1] in TOP


def _signed(text: str, end: int) -> bool:
    """Whether a sign and labels end at this place."""
    at = end
    while at and text[at - 1] in _LABELS:
        at -= 1
    return 0 < at < end and text[at - 1] == "@"


def _spaced(text: str) -> list[tuple[int, int, str]]:
    """Edits for bare words: name (dot name)* at label (dot label)+, or the same with a sign, that ends in a top-level domain."""
    seen, edits, done = list(_SPACED.finditer(text)), [], 0
    for k, m in enumerate(seen):
        if k < done:
            continue
        j, end, ends = k + bool(m[1]), m.end() if m[1] else m.start(), []
        signed = m[1] or _signed(text, m.start())
        while signed and j < len(seen) and seen[j][2] and (j == k or _LABEL.fullmatch(text, end, seen[j].start())):
            end, j = seen[j].end(), j + 1
            if _top(text, end):
                ends.append(j)
        first, last = k, k
        if ends and not (m[1] and text[m.end() : seen[k + 1].start()].lower() in _FILLERS):
            last = ends[-1]
            edits += [(x.start(), x.end(), "." if x[2] else "@") for x in seen[k:last]]
        elif m[2] and m[2].lower() == "dot" and _ADDRESS.match(text, m.end()):
            last = k + 1
            edits.append((m.start(), m.end(), "."))
        if last > k:
            while first > done and seen[first - 1][2] and (m[1] or m[2] and not signed) and _NAME.fullmatch(text, seen[first - 1].end(), seen[first].start()):
                first -= 1
                edits.append((seen[first].start(), seen[first].end(), "."))
            done = last
    return sorted(edits)


def _touching(tape: Tape, kinds: tuple[str, ...]) -> list[Span]:
    """Source spans of what the detectors find in the tape's text, where a change lies in them."""
    changed = sorted(tape.changed)
    starts, ends = [a for a, _ in changed], list(accumulate((b for _, b in changed), max))
    out = []
    for k, s, e in base(tape.text) if changed else ():
        lo, hi = tape.start[s], tape.end[e - 1]
        before = bisect_right(starts, hi - 1)  # changes that begin before the span ends
        if k in kinds and before and ends[before - 1] > lo:
            out.append((k, lo, hi))
    return out


def disguised(text: str) -> list[Span]:
    """Spans, in source characters, of identifiers that only the rewritten text shows."""
    odd = not text.isascii() and _FAR.search(text) and _ODD.search(text)
    signs = _SIGN_SAID.search(text)
    words = _SPOKEN.search(text)
    if not (odd or signs or words):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite([(m.start(), m.end(), TABLE[m[0]]) for m in _ODD.finditer(text)])
    found: list[Span] = []
    runs = list(_WORDS.finditer(tape.text)) if words or odd else []
    if runs:
        aside, known = Tape(tape.text), base(tape.text)
        aside.start, aside.end = tape.start, tape.end
        begins, ends = {s for _, s, _ in known}, {e for *_, e in known}
        aside.rewrite([e for m in runs for e in _spelled(m, begins, ends)])
        found = _touching(aside, KINDS[1:])
    if signs or odd:
        tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
        tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
        tape.rewrite(_spaced(tape.text))
    return found + _touching(tape, KINDS)


def detect(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans); a disguised span is added unless one of its kind contains it."""
    text = text or ""
    plain = base(text)
    hidden = disguised(text)
    if not hidden:
        return plain, list(plain)
    every, furthest = [], dict.fromkeys(KINDS, -1)
    for k, s, e, new in sorted([(k, s, e, False) for k, s, e in plain] + [(k, s, e, True) for k, s, e in hidden], key=lambda x: (KINDS.index(x[0]), x[1], -x[2], x[3])):
        if not new or e > furthest[k]:
            every.append((k, s, e))
        furthest[k] = max(furthest[k], e)
    return plain, every


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None) -> str | None:
    """text with every span replaced by its kind in brackets; of overlapping spans the union goes."""
    spans = detect(text)[1]
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= end:
            out += text[at:s], f"[{k.upper()}]"
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: a row for each row of docs; null text is empty.

    Counts and base_sha256 cover the plain spans; spans holds the n_added disguised ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [detect(t) for t in b["text"].to_pylist()]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in plain) for plain, _ in found], pa.int64()) for k in KINDS}
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], **counts, "base_sha256": pa.array([hashlib.sha256(joined(p).encode()).hexdigest() for p, _ in found], pa.string()), "spans": pa.array([joined(e) for _, e in found], pa.string()), "n_added": pa.array([len(e) - len(p) for p, e in found], pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(W.lean(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def clean(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind; n_chars, where there is one, follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b["text"].to_pylist()
            new = [redact(t) for t in old]
            columns = {c: b[c] for c in names} | {"text": pa.array(new, b["text"].type)}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([n if t == o else len(t) for n, t, o in zip(b["n_chars"].to_pylist(), new, old)], b["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(W.lean(run), docs.schema)
