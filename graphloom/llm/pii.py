"""Personal data with deobfuscation that keeps source offsets (operator 2).

Two layers of spans, all in code points of the source text, end exclusive:

* base spans: four plain patterns over the text as it stands;
* added spans: a chain of transducers rewrites the text (look-alike characters
  and foreign digits, invisible characters, ``at``/``dot`` disguises, spelled
  digits), each step carrying for every output character the source range it
  came from; the same patterns then run over the rewritten text, and what they
  find is mapped back. A mapped span is added unless a base span of its kind says
  the same or is cut by it. A disguise counts only where it completes a whole identifier, so
  ordinary prose keeps its words.

The rewriting runs only on stretches around something to rewrite, so clean text
costs a few searches. All patterns are linear: they are anchored on runs.

Cases: a null text counts as empty; an empty text has no spans and the digest of
the empty string; repeated rows each give a row; an empty table gives no rows;
texts of any length are read whole; unknown columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .decontaminate import TERMS, Words, term_ids, together
from .folding import SHAPES

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_RUN = re.compile(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, last = [], 0
    if "@" not in text:
        return found
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            last = m.end()
    return found


def _ips(text: str) -> list[Span]:
    if "." not in text:
        return []
    return [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split("."))]


def _cards(text: str) -> list[Span]:
    if not _LONG_RUN.search(text):
        return []
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def plain_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind, leftmost and not overlapping."""
    return {"email": _emails(text), "ip": _ips(text), "card": _cards(text), "phone": _phones(text)}


# Spelled digits, and signs spelled out, in the languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2",
    "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "­​‌‍⁠﻿"

_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_DIGIT = rf"(?:(?:{_WORDS})\b|[0-9])"
#: At least four digits, some of them or the signs between them spelled, with an optional spelled plus.
_SPELLED_RUN = re.compile(rf"(?:\bplus[ -]+|\+ ?)?\b{_DIGIT}(?:(?:[ ,.()-]{{0,3}}|[ ]+(?:dot|point)[ ]+){_DIGIT}){{3,}}", re.I)
#: Every run that a spelled digit could be in has one beside another digit, on one side or the other.
_GAP = r"(?:[ ,.()-]{0,3}|[ ]+(?:dot|point)[ ]+)"
_ANY_SPELLED = re.compile(rf"(?:{_WORDS})\b{_GAP}(?:(?:{_WORDS})\b|[0-9])|[0-9]{_GAP}(?:{_WORDS})\b", re.I)
_SPELLED_WORD = re.compile(rf"\b(?:{_WORDS})\b|\b(?:plus|dot|point)\b[ ]*", re.I)
_AT = r"(?:[ ]?[\[({<][ ]?(?:at|@|à|arroba)[ ]?[\])}>][ ]?|[ ]++(?:at|arroba)[ ]++|[ ]++@[ ]*+|@[ ]++)"
_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|punkt|point|punto|\.)[ ]?[\])}>][ ]?|[ ]++(?:dot|punkt|punto)[ ]++|\.)"
_PART = r"[A-Za-z0-9_%+-]++"
#: Names joined by signs, plain or spelled out. Each stands once: runs don't overlap, and none starts within a name.
_RUN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_PART}(?:(?:{_AT}|@|{_DOT}){_PART})++", re.I)
_SIGN = re.compile(rf"(?P<at>{_AT}|@)|{_DOT}", re.I)
_LABEL, _TOP = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[A-Za-z]{2,}")
_ANY_DISGUISE = re.compile(
    r"[\[({<][ ]?(?:at|@|dot|à|arroba|punkt|point|punto|\.)[ ]?[\])}>]|[ ](?:dot|punkt|punto)[ ]|[ ]point[ ]++[0-9]|[ ]@|@[ ]"
    rf"|[ ](?:at|arroba)[ ]++[A-Za-z0-9_%+-]++{_DOT}[A-Za-z0-9_%+-]",
    re.I,
)
_DOTTED_IP = re.compile(rf"(?<![0-9.])[0-9]++(?:{_DOT}[0-9]++){{3}}(?![0-9])", re.I)
_DOT_PART = re.compile(_DOT, re.I)


class Mapped:
    """A rewritten text that knows the source range of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Mapped:
        """Replace ranges (in order, apart); each new character stands for the whole range replaced."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _shapes(m: Mapped) -> Mapped:
    """Look-alikes and foreign digits (one for one), then invisible characters dropped."""
    m = Mapped(m.text.translate(SHAPES), m.starts, m.ends)
    hidden = [(k, k + 1, "") for k, c in enumerate(m.text) if c in INVISIBLE]
    return m.rewrite(hidden) if hidden else m


def _written_out(run: str) -> list[tuple[int, int, str]]:
    """The signs of a run of names that make addresses of it, leftmost first: (start, end, character)."""
    signs = list(_SIGN.finditer(run))
    edges = [0, *(x.end() for x in signs)], [*(x.start() for x in signs), len(run)]
    names = [run[a:b] for a, b in zip(*edges, strict=True)]
    changes, free = [], 0
    for k, sign in enumerate(signs):
        if not sign["at"]:
            continue
        # names up to the sign, back to the one before or to what an address has taken
        first = k
        while first > free and not signs[first - 1]["at"]:
            first -= 1
        last = k + 1
        while last < len(names) and _LABEL.fullmatch(names[last]) and (last == k + 1 or not signs[last - 1]["at"]):
            last += 1
        while last > k + 2 and not _TOP.fullmatch(names[last - 1]):
            last -= 1
        if first < free or last < k + 3:
            continue
        changes += [(x.start(), x.end(), "@" if x is sign else ".") for x in signs[first : last - 1]]
        free = last
    return changes


def _signs(m: Mapped) -> Mapped:
    """``name (at) host dot tld`` and dotted quads written out."""
    changes = [(run.start() + a, run.start() + b, new) for run in _RUN.finditer(m.text) for a, b, new in _written_out(run.group())]
    done = m.rewrite(changes) if changes else m
    quads = [(x.start(), x.end(), ".") for run in _DOTTED_IP.finditer(done.text) for x in _DOT_PART.finditer(done.text, run.start(), run.end())]
    return done.rewrite(quads) if quads else done


def _digits(m: Mapped) -> Mapped:
    """Runs of digits of which some are spelled."""
    changes = []
    for run in _SPELLED_RUN.finditer(m.text):
        for word in _SPELLED_WORD.finditer(m.text, run.start(), run.end()):
            name = word.group().strip().lower()
            start, end = word.span()
            if name in SPELLED:
                changes.append((start, end, SPELLED[name]))
            elif name == "plus":
                changes.append((start, end, "+"))
            else:
                before = start - 1 if start and m.text[start - 1] == " " else start
                changes.append((before, end, "."))
    return m.rewrite(changes) if changes else m


#: What the transducers could change: worth a second look.
_SUSPECT = re.compile("[" + "".join(map(re.escape, sorted(map(chr, SHAPES)))) + INVISIBLE + "]")
#: Characters of prose kept on either side of something to rewrite, before what stands there is completed.
MARGIN = 160
#: What an identifier may go on with beyond a blank: digits and their signs.
_NUMBER = frozenset("0123456789+(),.-")
#: Letters that only re.IGNORECASE takes for those of a spelled digit.
_ODD_CASE = re.compile("[\u017f\u212a\u0130\u0131]")
_DIGIT_LETTER = re.compile(r"[0-9][A-Za-z]")


def _goes_on(word: str) -> bool:
    """Whether a number could go on with this word."""
    return bool(word) and (_NUMBER.issuperset(word) or word.lower() in ("dot", "point"))


def _left(text: str, at: int, floor: int) -> int:
    """The start of the name, or of the run of numbers, that ``at`` is in, not before ``floor``."""
    while at > floor:
        while at > floor and not text[at - 1].isspace():
            at -= 1
        blank = at
        while blank > floor and text[blank - 1].isspace():
            blank -= 1
        word = blank
        while word > floor and not text[word - 1].isspace():
            word -= 1
        if not _goes_on(text[word:blank]):
            break
        at = word
    return at


def _right(text: str, at: int) -> int:
    """The end of the name, or of the run of numbers, that ``at`` is in."""
    size = len(text)
    while at < size:
        while at < size and not text[at].isspace():
            at += 1
        blank = at
        while blank < size and text[blank].isspace():
            blank += 1
        word = blank
        while word < size and not text[word].isspace():
            word += 1
        if not _goes_on(text[blank:word]):
            break
        at = word
    return at


def _stretches(text: str, spelled: bool = True) -> list[Span]:
    """Parts of a text that the transducers could change, with margins, merged where they meet.

    No part ends within a name or a run of numbers, so what is found doesn't depend on the margin.
    """
    marks = [m.span() for pattern in (_ANY_DISGUISE, *([_ANY_SPELLED] if spelled else [])) for m in pattern.finditer(text)]
    if not text.isascii():
        marks += [m.span() for m in _SUSPECT.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(marks):
        done = merged[-1][1] if merged else 0
        if merged and b + MARGIN <= done:
            continue
        a = a - MARGIN if a - MARGIN <= done else _left(text, a - MARGIN, done)
        b = _right(text, max(done, min(len(text), b + MARGIN)))
        if merged and a <= done:
            merged[-1][1] = b
        else:
            merged.append([max(0, a), b])
    return [(a, b) for a, b in merged]


def _spelled_table() -> np.ndarray:
    known = np.zeros(TERMS, bool)
    known[[i for word in SPELLED for i in term_ids(word).tolist()]] = True
    return known


_SPELLED_TERMS = _spelled_table()


def may_spell(texts: list[str]) -> list[bool]:
    """Which texts may have a spelled digit beside another digit: hashed words of all texts at once, errors only by excess."""
    out = [False] * len(texts)
    first = 0
    for group in together(texts):
        words, text_of = Words.of_many(group)
        if len(words):
            spelled = _SPELLED_TERMS[words.terms]
            heads = np.frombuffer(words.data, np.uint8)
            numbers = spelled | ((heads[words.starts] >= 48) & (heads[words.starts] <= 57)) | ((heads[words.ends - 1] >= 48) & (heads[words.ends - 1] <= 57))
            beside = (spelled[:-1] & numbers[1:] | numbers[:-1] & spelled[1:]) & (text_of[:-1] == text_of[1:])
            for k in np.unique(text_of[:-1][beside]).tolist():
                out[first + k] = True
        first += len(group)
    return [
        o or bool(_DIGIT_LETTER.search(t)) or (not t.isascii() and bool(_ODD_CASE.search(t))) for o, t in zip(out, texts, strict=True)
    ]


def added_spans(text: str, base: dict[str, list[Span]], spelled: bool = True) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows, mapped to the source; ``spelled`` tells if it may have spelled digits."""
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    for a, b in _stretches(text) if spelled else _stretches(text, False):
        m = _shapes(Mapped(text[a:b], list(range(a, b)), list(range(a + 1, b + 1))))
        m = _digits(_signs(m))
        for kind, spans in plain_spans(m.text).items():
            for span in spans:
                s, e = m.source(span)
                # a longer reading may cover base spans; it may not cut or repeat one
                met = [(x, y) for x, y in base[kind] if s < y and x < e]
                if text[s:e] != m.text[span[0] : span[1]] and all(s <= x and y <= e and (s, e) != (x, y) for x, y in met):
                    added[kind].append((s, e))
    return added


def find(text: str | None, spelled: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base and added spans together, by kind."""
    text = text or ""
    base = plain_spans(text)
    more = added_spans(text, base, spelled)
    return base, {kind: sorted(set(base[kind]) | set(more[kind])) for kind in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join([f"{kind}:{s}:{e}" for kind in KINDS for s, e in spans[kind]])


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans, n_added = [], [], [], []
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for value, spelled in zip(texts, may_spell(texts), strict=True):
                base, all_of = find(value, spelled)
                counts.append([len(base[k]) for k in KINDS])
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_of))
                n_added.append(sum(map(len, all_of.values())) - sum(counts[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))),
                    pa.array(hashes, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(n_added, pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    small_batches(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): each span with the source characters it covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(k, s, e, value[s:e]) for k, spans in find(value)[1].items() for s, e in spans]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc_id] * len(found), pa.int64()),
                        "kind": pa.array([f[0] for f in found], pa.string()),
                        "start": pa.array([f[1] for f in found], pa.int64()),
                        "end": pa.array([f[2] for f in found], pa.int64()),
                        "value": pa.array([f[3] for f in found], pa.string()),
                    }
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, kind string, start long, end long, value string"
    )
