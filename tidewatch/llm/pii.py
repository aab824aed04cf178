"""Personal data by offset-preserving deobfuscation.

Two transducers rewrite a text and remember where every character came from: one
undoes look-alike characters, the other spelled digits and at/dot disguises. The
same detectors read the text as it stands and as it was rewritten; spans found
only after rewriting are mapped back to the characters of the source.

Every detector takes time in proportion to the text: no pattern can start over
inside a stretch that it has already walked through.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, source, table

KINDS = ("email", "ip", "card", "phone")

# -- detectors ----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    """A shorter chain of digits cannot qualify, so the pattern leaves it out."""
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, leftmost and not overlapping within a kind."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# -- transducers ---------------------------------------------------------------------


class Rewritten:
    """A text with replaced pieces, and the way back to the text before."""

    def __init__(self, before: str, edits: list[tuple[int, int, str]]):
        parts, self.starts, self.origins, self.ends, done, size = [], [], [], [], 0, 0
        for start, end, new in sorted(edits):
            if start < done:
                continue
            for piece, a, b in ((before[done:start], done, None), (new, start, end)):
                if piece:
                    self.starts.append(size)
                    self.origins.append(a)
                    self.ends.append(b)  # None: character by character
                    parts.append(piece)
                    size += len(piece)
            done = end
        self.starts.append(size)
        self.origins.append(done)
        self.ends.append(None)
        self.text = "".join([*parts, before[done:]])

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source characters of ``text[start:end]``; a replaced piece counts as a whole."""
        i = bisect.bisect_right(self.starts, start) - 1
        j = bisect.bisect_right(self.starts, end - 1) - 1
        first = self.origins[i] if self.ends[i] is not None else self.origins[i] + start - self.starts[i]
        last = self.ends[j] if self.ends[j] is not None else self.origins[j] + end - self.starts[j]
        return first, last

    def touched(self, start: int, end: int) -> bool:
        """Whether ``text[start:end]`` holds a replaced piece, or had something cut out of it."""
        i = bisect.bisect_right(self.starts, start) - 1
        j = bisect.bisect_right(self.starts, end - 1) - 1
        return i != j or self.ends[i] is not None


# Letters of other scripts that look like Latin ones, and marks without width.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ",
        "ABESIJKMHOPCTYXaesijopcyxdhqwABEZHIKMNOPTYXoc",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
HYPHENS = "‐‑‒–−"
DOTS = "․。｡"
BLANKS = "    "


def plain_character(c: str) -> str:
    """The ASCII character (or nothing) that ``c`` stands for; ``c`` where there is none."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in HYPHENS:
        return "-"
    if c in DOTS:
        return "."
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


_TOKEN = re.compile(r"\S+")
_BLANK_IN_NUMBER = re.compile(f"(?<=[0-9])[{BLANKS}](?=[0-9])")


def undo_look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Edits for tokens that become ASCII as a whole; words of another script stay."""
    edits = [(m.start(), m.end(), " ") for m in _BLANK_IN_NUMBER.finditer(text)]
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token.isascii():
            continue
        new = [c if c.isascii() else plain_character(c) for c in token]
        # Accented letters and other scripts stay; a stretch that touches their letters stays too.
        for part in re.finditer("a+", "".join("a" if n.isascii() else "-" for n in new)):
            before, after = token[: part.start()][-1:], token[part.end() :][:1]
            if not before.isalpha() and not after.isalpha():
                edits += [(m.start() + i, m.start() + i + 1, new[i]) for i in range(*part.span()) if not token[i].isascii()]
    return edits


# Spoken digits, and words for the signs of an address.
SPOKEN = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_AT = "at|@|arroba|arobase"
_DOT = r"dot|\.|punkt|punto|point"

_SPOKEN = "(?:" + "|".join(SPOKEN) + ")"
_WORD = re.compile(_SPOKEN + r"(?![^\W\d]|@|[._%+][^\W_])")
_GAP = re.compile(r"\s*+(?:[,-]\s*+){0,2}")  # between two spelled digits
_MIXED = re.compile(r"[^\S\n]*+(?:-[^\S\n]*+)?")  # between a spelled and a numeric one, also backwards
_NUMERALS = frozenset("0123456789")
_PLUS = re.compile(r"\bplus[^\S\n]*+(?=[0-9])")
_PART = rf"(?:(?:[0-9]{{1,2}}[ -]?)?{_SPOKEN}(?:[ -]?(?:{_SPOKEN}|[0-9]{{1,2}})){{0,2}}|[0-9]{{1,3}})"
_SPOKEN_IP = re.compile(rf"\b{_PART}(?:\s*+(?:\bdot\b|\bpoint\b|[\[(]dot[\])])\s*+{_PART}){{3}}\b")
_IN_IP = re.compile(rf"{_SPOKEN}|\s*+[\[(]?(?:dot|point)[\])]?\s*+|[ -]")
_BRACKETED = re.compile(rf"(?<=[a-z0-9_])\s*+[(\[{{<]\s*+(?:({_AT})|(?:{_DOT}))\s*+[)\]}}>]\s*+(?=[a-z0-9])")
_SAID_AT = re.compile(r"(?<=[a-z0-9._%+-])\s++(at|@)(?=(\s++)[a-z0-9-])")
_SAID_DOMAIN = re.compile(r"[a-z0-9-]++(?:(?:\s++dot\s++|[^\S\n]++\.[^\S\n]++|\.)[a-z0-9-]++)++")
_SAID_DOT = re.compile(r"(?<!\s)\s++(dot|\.)\s++")
_SAID_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _back(text: str, at: int, floor: int, over) -> int:
    """Where the stretch of characters that are ``over`` and end before ``at`` begins."""
    while at > floor and over(text[at - 1]):
        at -= 1
    return at


def said_addresses(low: str) -> list[tuple[int, int, str]]:
    """Edits for "x dot y at z dot w": a sign first, then its domain, then its local part, so nothing is walked again and again."""
    edits: list[tuple[int, int, str]] = []
    floor = 0
    for m in _SAID_AT.finditer(low):
        domain = _SAID_DOMAIN.match(low, m.end(2)) if m.start() > floor else None
        if not domain:
            continue
        dots = list(_SAID_DOT.finditer(low, *domain.span()))
        changed = [(d.start(), d.end(), ".") for d in dots]
        said = any(d.group(1) == "dot" for d in dots)
        start = _back(low, m.start(), floor, _SAID_LOCAL.__contains__)
        while True:  # words of the local part, from the last to the first
            end = _back(low, start, floor, str.isspace)
            if end == start or end - 4 <= floor or low[end - 3 : end] != "dot":
                break
            word = _back(low, end - 3, floor, str.isspace)
            if word == end - 3 or word == floor or low[word - 1] not in _SAID_LOCAL:
                break
            changed.append((word, start, "."))
            said, start = True, _back(low, word, floor, _SAID_LOCAL.__contains__)
        if said or m.group(1) == "@":  # "look at it.then" is prose
            edits += [(m.start(), m.end(2), "@"), *changed]
            floor = domain.end()
    return edits


def spelled_digits(low: str) -> list[tuple[int, int, str]]:
    """Edits for every spelled digit that adjoins another digit, spelled or numeric.

    What lies between two spelled ones goes; beside a numeric one a single blank or
    hyphen stays, as between two numeric ones, and a longer gap becomes one blank.
    Words that belong to an address as it stands are left alone.
    """
    edits: list[tuple[int, int, str]] = []

    def free(c: str) -> bool:
        return c not in "_@.%" and (not c.isalnum() or c.isdecimal())

    words = [m.span() for m in _WORD.finditer(low) if m.start() == 0 or free(low[m.start() - 1])]
    joined = False  # to the word before
    for (start, end), (following, _) in zip(words, [*words[1:], (-1, 0)], strict=False):
        joins = _GAP.match(low, end).end() == following
        gaps = [(end, following, "")] if joins else []
        left = 0
        if not joined:
            left = _back(low, start, 0, lambda c: c == "-" or c != "\n" and c.isspace())
            if left and low[left - 1] in _NUMERALS and _MIXED.fullmatch(low, left, start):
                gaps.append((left, start, " "))
            else:
                left = 0
        right = 0 if joins else _MIXED.match(low, end).end()
        if right and low[right : right + 1] in _NUMERALS:
            gaps.append((end, right, " "))
        if joined or gaps:
            edits.append((start, end, SPOKEN[low[start:end]]))
            edits += [(a, b, new) for a, b, new in gaps if a < b and (not new or low[a:b] not in (" ", "-"))]
            if not joined and not left:
                sign = _back(low, start, 0, lambda c: c == "-" or c.isspace())
                if sign < start and low[max(sign - 4, 0) : sign] == "plus" and (sign == 4 or free(low[sign - 5])):
                    edits.append((sign - 4, start, "+"))
        joined = joins
    return edits


def undo_disguises(text: str) -> list[tuple[int, int, str]]:
    """Edits for spelled digits, spoken addresses and bracketed signs."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    edits: list[tuple[int, int, str]] = []
    if "dot" in low or "point" in low:
        for m in _SPOKEN_IP.finditer(low):
            for w in _IN_IP.finditer(m.group()):
                edits.append((m.start() + w.start(), m.start() + w.end(), SPOKEN.get(w.group(), "." if "o" in w.group() else "")))
    if any(c in low for c in "([{<"):
        edits += [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _BRACKETED.finditer(low)]
    if "dot" in low or "@" in low:
        edits += said_addresses(low)
    edits += spelled_digits(low)
    if "plus" in low:
        edits += [(m.start(), m.end(), "+") for m in _PLUS.finditer(low)]
    return edits


def find_whole(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Spans of the text as it stands, further spans that only deobfuscation shows, and wider ones.

    A further span never overlaps one of the same kind. A wider span overlaps plain
    spans of its kind and reaches beyond them: a disguise in a part of an identifier
    leaves a plain fragment. Null is the empty text.
    """
    text = text or ""
    base = detect(text)
    layers: list[Rewritten] = []
    now = text
    for undo in (undo_look_alikes, undo_disguises):
        if undo is undo_look_alikes and now.isascii():
            continue
        edits = undo(now)
        if edits:
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    wider: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, spans in (detect(now) if layers else {}).items():
        plain, done = base[kind], 0  # mapped spans come in order and without overlap, as plain ones do
        for start, end in spans:
            changed = False
            for layer in reversed(layers):
                changed |= layer.touched(start, end)
                start, end = layer.span(start, end)
            start = max(start, done)  # a replaced piece may be the end of one span and the start of the next
            if not changed or start >= end:
                continue
            done = end
            i = bisect.bisect_left(plain, (end, -1))
            if i == 0 or plain[i - 1][1] <= start:
                more[kind].append((start, end))
            elif plain[i - 1][0] > start or plain[i - 1][1] < end:
                wider[kind].append((start, end))
    return base, more, wider


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The first two of :func:`find_whole`: spans that never overlap within a kind."""
    return find_whole(text)[:2]


def listed(*found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(s for f in found for s in f[k]))


# -- on documents ------------------------------------------------------------------


def find_in_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans (array of kind, start, end) and added spans of every row, whole texts.

    Added spans are the further and the wider ones of :func:`find_whole`.
    """
    small_batches(docs.sparkSession)
    rows = source(docs, doc_id=doc_id, text=text)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def read(batches):
        for b in batches:
            columns: list[list] = [[], [], [], []]
            for t in b["text"].to_pylist():
                base, more, wider = find_whole(t)
                more = {k: sorted(more[k] + wider[k]) for k in KINDS}
                for c, f in zip(columns, (base, more), strict=False):
                    c.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in f[k]])
                columns[2].append(hashlib.sha256(listed(base).encode()).hexdigest())
                columns[3].append(listed(base, more))
            types = (span, span, pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *arrays], ["doc_id", "base", "added", "base_sha256", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(read, f"doc_id {id_type}, base {spans}, added {spans}, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with a mark in place of every span; overlapping spans get one mark, of the first and longest."""
    if not text:
        return text
    spans = sorted(((s, e, k) for f in find_whole(text) for k in KINDS for s, e in f[k]), key=lambda x: (x[0], -x[1]))
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data of ``text`` replaced by marks; every row and column stays."""
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text), docs.schema

    def mask(batches):
        for b in batches:
            new = pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(mask, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the plain spans, their digest, and all spans."""
    found = find_in_documents(table(spark, sf_dir, "documents"))

    def count(column: str, kind: str):
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count("base", k).alias(f"n_{k}") for k in KINDS],
        "base_sha256",
        "spans",
        *[count("added", k).alias(f"n_{k}_added") for k in KINDS],
    )
