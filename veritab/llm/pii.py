"""Operator 10: personal data, also where it is disguised, with spans of the source text.

Base spans come from the text as it is: emails, addresses of machines, card numbers
and telephone numbers by fixed patterns, leftmost and non-overlapping per kind.

Disguised ones come from a chain of transducers that every text passes.  The first works on characters:
look-alike letters, digits of other scripts and full-width forms become ASCII, and
invisible characters vanish.  The others work on words: bracketed or spelled at and
dot signs, spelled digits, and letters that stand for digits inside numbers.  Every
character of the output carries the source span it came from, so what the same
patterns find in the output is mapped back to the source.  A found span is added
unless a base span of its kind already covers it; base spans always stay.

Defined results: NULL and empty text have no spans; repeated rows and ids give one
row each; a NULL id is kept; other columns pass through `redact` and are ignored by
`find`; an empty table gives an empty result.  All patterns take time linear in the
length of the text.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritab.llm.common import map_batches, ready, release, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never ends before a digit, so asking for the start of a run of digits changes no match and keeps time linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield "ip", match.start(), match.end()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        if 14 <= match.end() - match.start() <= 37:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", match.start(), match.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= sum(map(match[0].count, "0123456789")) <= 15:
                yield "phone", match.start(), match.end()


def base_spans(text: str) -> list[Span]:
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


# ---------------------------------------------------------------- characters

#: Letters that look like Latin ones (fixed values, one look-alike each).
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i",
    "ɡ": "g", "ɑ": "a", "ո": "n", "օ": "o", "ѡ": "w",
}
#: Signs with an ASCII meaning here (fixed values).
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "∙": ".", "•": ".", "\xa0": " "}
INVISIBLE = "\xad​‌‍⁠﻿᠎"


def _characters() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0x100, 0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F150)]:
        char = chr(code)
        digit = unicodedata.decimal(char, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and "!" <= plain <= "~":
            table[code] = plain
    table |= {ord(k): v for k, v in (LOOK_ALIKES | SIGNS).items()}
    return table | dict.fromkeys(map(ord, INVISIBLE))


CHARACTERS = _characters()
_ODD = frozenset(map(chr, CHARACTERS))
_ODD_LATIN = tuple(c for c in _ODD if c <= "\xff")


def _odd(text: str) -> bool:
    """Whether a character of the table is in the text; texts in Latin-1 need no set of their characters."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.isdisjoint(set(text))
    return any(c in text for c in _ODD_LATIN)



# ---------------------------------------------------------------- words

#: Spelled digits of the four languages (fixed values); words that are also articles are left out.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_D = "|".join(sorted(DIGITS, key=lambda w: (-len(w), w)))
_DOT, _AT, _DASH = "dot|period|point|punkt|punto", "at|arroba|chez", "dash|hyphen|minus"
_BRACKETED = re.compile(rf"[ \t]{{0,2}}[\[({{<]\s{{0,2}}(?:({_AT}|@|a)|({_DOT}|\.))\s{{0,2}}[\])}}>][ \t]{{0,2}}", re.I)
_FRAMED = re.compile(rf"(?<=[A-Za-z0-9])(?:_|--?)(?:({_AT})|({_DOT}))(?:_|--?)(?=[A-Za-z0-9])", re.I)
_ELEMENT = rf"(?:{_D}|{_DOT}|{_DASH}|[0-9]++|[+().-])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -]{{1,2}})?(?:{_D}|[0-9]++)(?:[ ,/-]{{0,2}}{_ELEMENT})+(?![^\W_])", re.I)
_PARTS = re.compile(rf"plus|{_D}|{_DOT}|{_DASH}|[0-9]+|[+().-]| ", re.I)
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus[ -]{1,2}(?=[0-9])", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])[ \t]{{1,2}}(?:{_DOT}|\.)[ \t]{{1,2}}(?=[0-9])", re.I)
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[ .-]?[0-9OolI])++(?![A-Za-z])")
_AT_SIGN = re.compile(rf"[ \t]{{1,2}}(?:{_AT})(?=[ \t])|[ \t]{{0,2}}@", re.I)
_ADDRESS_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_DOT_WORD = re.compile(_DOT, re.I)
_SPELLED_DOMAIN = re.compile(rf"[ \t]{{0,2}}[A-Za-z0-9-]++(?:(?:[ \t]{{1,2}}(?:{_DOT})[ \t]{{1,2}}|[ \t]\.[ \t]|\.)[A-Za-z0-9-]++)+", re.I)
_ADDRESS_PARTS = re.compile(rf"[ \t]+(?:({_AT})|({_DOT}))[ \t]+|[ \t]*@[ \t]*|[ \t]\.[ \t]|[A-Za-z0-9_%+-]+|\.", re.I)


class Mapped:
    """A text whose every character knows the source span it came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1

    def characters(self) -> None:
        """The character transducer: one to one, or one to nothing."""
        if not _odd(self.text):
            return
        gone = np.array([CHARACTERS.get(ord(c), c) is None for c in self.text])
        self.text = self.text.translate(CHARACTERS)
        self.starts, self.ends = self.starts[~gone], self.ends[~gone]

    def rewrite(self, pattern: re.Pattern, output: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> None:
        """Replace matches by pieces, each with the part of the match that it came from."""
        self.replace((match.start(), match.end(), output(match)) for match in pattern.finditer(self.text))

    def replace(self, found: Iterable[tuple[int, int, list[tuple[str, int, int]] | None]]) -> None:
        """Replace stretches (start, end), in order and apart from each other, by their pieces; None leaves one as it is."""
        pieces, starts, ends, last = [], [], [], 0
        for start, end, made in found:
            if made is None:
                continue
            pieces.append(self.text[last:start])
            starts.append(self.starts[last:start])
            ends.append(self.ends[last:start])
            for piece, a, b in made:
                pieces.append(piece)
                starts.append(np.full(len(piece), self.starts[a]))
                ends.append(np.full(len(piece), self.ends[b - 1]))
            last = end
        if last:
            self.starts = np.concatenate([*starts, self.starts[last:]])
            self.ends = np.concatenate([*ends, self.ends[last:]])
            self.text = "".join(pieces) + self.text[last:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def _sign(match: re.Match) -> list[tuple[str, int, int]]:
    return [("@" if match[1] else ".", match.start(), match.end())]


def _spelled(match: re.Match) -> list[tuple[str, int, int]] | None:
    """Digits of a run with at least three spelled ones; blanks and hyphens after spelled digits go, other signs stay."""
    made, words, last = [], 0, ""
    for part in _PARTS.finditer(match[0]):
        before, last = last, (word := part[0].lower())
        at, to = match.start() + part.start(), match.start() + part.end()
        if word in DIGITS:
            words += 1
            made.append((DIGITS[word], at, to))
        elif word == "plus":
            made.append(("+", at, to))
        elif re.fullmatch(_DOT, word):
            made.append((".", at, to))
        elif re.fullmatch(_DASH, word):
            made.append(("-", at, to))
        elif word != " " and not (word == "-" and before in DIGITS):
            made += [(c, at + i, at + i + 1) for i, c in enumerate(word)]
    return made if words >= 3 else None


def _letter_digits(match: re.Match) -> list[tuple[str, int, int]] | None:
    """O, l and I as digits inside a number that has seven digits and twice as many digits as letters."""
    text = match[0]
    letters = sum(map(text.count, "OolI"))
    if not letters or sum(map(str.isdigit, text)) < max(7, 2 * letters):
        return None
    return [({"O": "0", "o": "0", "l": "1", "I": "1"}.get(c, c), i, i + 1) for i, c in enumerate(text, match.start())]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of spelled addresses, found from their at signs outwards.

    One pass over the words gives every word the start of the chain `word dot word ...`
    that it ends, so an at sign knows its local part without looking back.
    """
    signs = _AT_SIGN.finditer(text)
    sign = next(signs, None)
    last: list[tuple[int, int, int]] = []  # start, end and start of the chain, of the two words before
    done = 0
    for word in _ADDRESS_WORD.finditer(text):
        if sign is None:
            return
        start, end = word.span()
        first = start
        if len(last) == 2 and "." not in word[0]:
            (_, before, chain), (dot, dot_end, _) = last
            joined = all(0 < b - a <= 2 and not text[a:b].strip(" \t") for a, b in ((before, dot), (dot_end, start)))
            if joined and _DOT_WORD.fullmatch(text, dot, dot_end):
                first = chain
        last = [*last[-1:], (start, end, first)]
        while sign is not None and sign.start() < end:
            sign = next(signs, None)
        if sign is not None and sign.start() == end and start >= done:
            domain = _SPELLED_DOMAIN.match(text, sign.end())
            if domain:
                first, done = first if first >= done else start, domain.end()
                yield first, done


def _address(found: str, start: int) -> list[tuple[str, int, int]] | None:
    """Joins a spelled address that stands at `start`.  A bare word for the at sign needs a disguised dot after it, or a local part that is no plain word."""
    made, at_word, dots_after, local = [], False, False, ""
    seen_at = False
    for part in _ADDRESS_PARTS.finditer(found):
        text, at, to = part[0], start + part.start(), start + part.end()
        if "@" in text or part[1]:
            seen_at, at_word = True, bool(part[1])
            made.append(("@", at, to))
        elif part[2] or text.strip() == ".":
            dots_after |= seen_at and text != "."
            made.append((".", at, to))
            local += "" if seen_at else "."
        else:
            made += [(c, at + i, at + i + 1) for i, c in enumerate(text)]
            local += "" if seen_at else text
    return None if at_word and not dots_after and local.isalpha() else made


def normalise(text: str) -> Mapped | None:
    """The undisguised text with its source spans; None when there is no disguise."""
    mapped = Mapped(text)
    mapped.characters()
    mapped.rewrite(_BRACKETED, _sign)
    mapped.rewrite(_FRAMED, _sign)
    mapped.rewrite(_SPELLED, _spelled)
    mapped.rewrite(_PLUS, lambda m: [("+", m.start(), m.end())])
    mapped.rewrite(_NUMBER_DOT, lambda m: [(".", m.start(), m.end())])
    mapped.rewrite(_LETTER_DIGITS, _letter_digits)
    mapped.replace([(a, b, _address(mapped.text[a:b], a)) for a, b in _addresses(mapped.text)])
    return None if mapped.text == text else mapped


def added_spans(text: str, base: list[Span]) -> list[Span]:
    mapped = normalise(text)
    if mapped is None:
        return []
    found = {(kind, *mapped.source(start, end)) for kind, start, end in base_spans(mapped.text)}
    # base spans of a kind do not overlap: only the last one that starts before a span can cover it
    known = {kind: sorted((start, end) for k, start, end in base if k == kind) for kind in KINDS}

    def covered(kind: str, start: int, end: int) -> bool:
        at = bisect.bisect_right(known[kind], (start, math.inf)) - 1
        return at >= 0 and known[kind][at][1] >= end

    return [s for s in found if not covered(*s)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _arrow(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in spans], _SPANS_ARROW)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): spans in code points of every whole text, each list by start, kind and end."""

    def work(batch: pa.RecordBatch):
        data = texts(batch.column(1))
        base = [ordered(base_spans(text)) for text in data]
        added = [ordered(added_spans(text, found)) for text, found in zip(data, base, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), _arrow(base), _arrow(added)], names=[id_col, "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, base {_SPANS}, added {_SPANS}")


def masked(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    base = base_spans(text)
    pieces, last = [], 0
    for kind, start, end in ordered([*base, *added_spans(text, base)]):
        if start >= last:
            pieces += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(pieces) + text[last:] if pieces else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all spans masked; NULL text stays NULL."""
    ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        for batch in batches:
            data = batch.column(at).to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([x and masked(x) for x in data], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
