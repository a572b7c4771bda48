"""Personal data: e-mail and IP addresses, card and phone numbers, disguised ones too.

Base spans follow fixed patterns on the text as it is. For disguises, small
transducers rewrite the text step by step: letters that look like others and
full-width forms become ASCII and invisible characters go; spelled digits, and letters
that pose as digits among digits, become digits; "at" and "dot" in brackets, or spelled out between words, become signs, and
blanks around an @ before a domain go. "x at y.z" with ordinary dots is an address if
x looks like an account, a word such as "mail" leads to it, or it stands by itself.
Every rewritten character keeps the place of its source, so that what the same
patterns find in the normalised text maps back to spans of source characters. A
span found this way is added if it overlaps no span found before.

Places are code points, ends exclusive. Null and empty texts have no spans;
repeated rows have equal spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.arrow import chunks, keep_only, replaced

KINDS = ("email", "ip", "card", "phone")

# The fixed patterns. A digit run is only tried from its start: from any later
# digit the same rest would fail.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, char in enumerate(reversed(digits)):
        value = int(char) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping e-mail addresses, found from their @ signs."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind as listed, by start."""
    mails = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return [mails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))] if "." in text else []
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 12 and 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15] if "+" in text else []
    return [mails, ips, cards, phones]


# Look-alikes of Latin letters in Greek and Cyrillic, and signs; fixed values.
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = frozenset("​‌‍⁠﻿­")
# Spelled digits in English, French, German and Spanish; fixed values.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED_RUN = re.compile(r"(?<![^\W_])(?:(?:{0}|[0-9]+)(?:[ \-.,]+|$|(?=\W))){{4,}}".format("|".join(sorted(_SPELLED, key=len, reverse=True))), re.IGNORECASE)
_SPELLED_DOT = re.compile(r"(?<![^\W_])({0}|[0-9]++)\x20++dot\x20++(?=(?:{0}|[0-9]++)(?![^\W_]))".format("|".join(sorted(_SPELLED, key=len, reverse=True))), re.IGNORECASE)
# Signs that pose as digits; fixed values.
_POSING = {"l": "1", "I": "1", "|": "1", "O": "0", "o": "0"}
_POSED = re.compile(r"[0-9][lI|Oo]|[lI|Oo][0-9]")
_POSED_RUN = re.compile(r"(?<![\w|])[0-9lI|Oo]++(?![\w|])(?:[ .()-]{1,3}+[0-9lI|Oo]++(?![\w|]))*+")
_POSED_WORD = re.compile(r"[0-9lI|Oo]+")
_SPELLED_WORD = re.compile(r"[^\W\d_]+|[0-9]+", re.UNICODE)
_PLUS = re.compile(r"(?<!\w)(?:plus|más)\s+(?=\+?[0-9])", re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|@|dot|punto|point|punkt|\.)\s*[\])}>]", re.IGNORECASE)
_BRACKET_AT = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*(?:at|arroba|arobase|@)\s*[\])}>]\s*", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*(?:dot|punto|point|punkt|\.)\s*[\])}>]\s*", re.IGNORECASE)
# Endings that make an address even of words like "the dot com"; fixed values.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz io dev app ai me tv co uk us ca au nz ie de at ch fr be nl es pt it eu pl se no fi dk in jp cn br mx ru example test".split()
)
# Words that are neither a domain's first nor its last part, nor whom one writes to; fixed values.
_ORDINARY = frozenset(
    "the a an this that these those each every any some no one my your his her its our their it he she they we you i me us him them who which what "
    "on in of at to by for from with and or but nor is are was were be been as if so than then there here now not out up off over more again "
    "look looking see seen visit find found read view watch join buy live available online posted published hosted located born".split()
)
_SIGN = re.compile(r"@[ \t]*|[aA][tT](?<=[ \t]..)[ \t]+")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_BETWEEN = re.compile(r"(?P<plain>\.)(?=[A-Za-z0-9-])|(?P<word>[ \t]++dot[ \t]++)(?=[A-Za-z0-9-])|(?P<wide>[ \t]*+\.[ \t]*+)(?=[A-Za-z0-9-])", re.IGNORECASE)
_LAST = re.compile(r"(?:[A-Za-z]{2,}|xn--[A-Za-z0-9-]+)\Z", re.IGNORECASE)
# What announces an address before its local part.
_CUE = re.compile(
    r"(?<!\w)(?:e-?mails?|e-?mail(?:ed|ing)|mail|mailto|contact|contacting|write|writing|wrote|reach|address|send|reply|message|cc|correo|courriel|adresse)"
    r"(?:\s+(?:to|is|me|us|him|her|them|address|via|by|under|it))*[\s:]+\Z",
    re.IGNORECASE,
)
_ALONE_END = re.compile(r"[ \t]*+(?:\Z|[\n>)\]}\"”»]|[.,;!?]+(?:\s|\Z))")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_DIGIT_DOT = re.compile(r"(?<=[0-9]) +dot +(?=[0-9])", re.IGNORECASE)


class Tracked:
    """A text being rewritten; ``start`` and ``end`` give each character's source span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace spans, ascending and apart; each new character stands for its whole span."""
        if not changes:
            return
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in changes:
            texts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a] if a < len(self.start) else 0)]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1] if b else 0)]
            done = b
        self.text = "".join([*texts, self.text[done:]])
        self.start = np.concatenate([*starts, self.start[done:]])
        self.end = np.concatenate([*ends, self.end[done:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


@lru_cache(1 << 14)
def plain_form(char: str) -> str | None:
    """What a character becomes, or None if it stays."""
    if char <= "\x7f":
        return None
    if char in _INVISIBLE:
        return ""
    if char in _ALIKE:
        return _ALIKE[char]
    if (plain := unicodedata.normalize("NFKC", char)) != char and plain.isascii() and plain:
        return plain
    return str(unicodedata.decimal(char)) if char.isdecimal() else None


def normalise(text: str) -> Tracked:
    """The text with its disguises undone."""
    own = Tracked(text)
    if not text.isascii() and any(plain_form(char) is not None for char in set(text)):
        own.rewrite([(m.start(), m.end(), plain) for m in _NOT_ASCII.finditer(text) if (plain := plain_form(m[0])) is not None])
    # Each step is left out only where its own pattern can't match.
    if _BRACKETED.search(own.text):
        own.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(own.text)])
        own.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(own.text)])
    lower = own.text.lower()
    if "@" in lower or " at " in lower or "\tat" in lower or "at\t" in lower:
        own.rewrite(_spelled_addresses(own.text))
    if "dot" in lower:
        own.rewrite([(*m.span(), ".") for m in _DIGIT_DOT.finditer(own.text)])
        own.rewrite([(m.end(1), m.end(), ".") for m in _SPELLED_DOT.finditer(own.text)])
    if not _SPELLED.keys().isdisjoint(_SPELLED_WORD.findall(lower)):
        own.rewrite(_spelled_digits(own.text))
    if _POSED.search(own.text):
        own.rewrite(_posed_digits(own.text))
    if "plus" in lower or "más" in lower:
        own.rewrite([(*m.span(), "" if own.text[m.end() : m.end() + 1] == "+" else "+") for m in _PLUS.finditer(own.text)])
    return own


def _spelled_addresses(text: str) -> list[tuple[int, int, str]]:
    """Changes that turn addresses with blanks around the sign, "at" or "dot" into plain ones."""
    changes: list[tuple[int, int, str]] = []
    done = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        at, real = sign.start(), sign[0][0] == "@"
        while at > done and text[at - 1] in " \t":
            at -= 1
        if at <= done or text[at - 1] not in _LOCAL:
            continue
        end, dots = _domain_end(text, sign.end(), real)
        if end is None:
            continue
        start, own = _local_start(text, at, done)
        if start == at:
            continue
        spelled = any(len(text[a:b]) > 1 for a, b in dots)
        if not real and not spelled and not _is_address(text, start, at, end, bool(own)):
            continue
        changes += [(a, b, ".") for a, b in own]
        if text[at : sign.end()] != "@":
            changes.append((at, sign.end(), "@"))
        changes += [(a, b, ".") for a, b in dots if b - a > 1]
        done = end
    return changes


def _domain_end(text: str, start: int, real: bool) -> tuple[int | None, list[tuple[int, int]]]:
    """End of the longest domain at a place, or None, and its dots.

    An ordinary dot with blanks counts only before a spelled-out one with a known
    ending, else the next sentence would belong to the domain.
    """
    label = _LABEL.match(text, start)
    if label is None:
        return None, []
    first = label[0].lower()
    dots: list[tuple[int, int]] = []
    best, n_best, wide, spelled = None, 0, False, False
    numbers = _is_number(first)
    while between := _BETWEEN.match(text, label.end()):
        label = _LABEL.match(text, between.end())
        dots.append(between.span())
        word = between["word"] is not None
        wide |= between["wide"] is not None
        spelled |= word
        last = label[0].lower()
        numbers = numbers and _is_number(last)
        if numbers:  # the parts of an IP address
            good = False
        elif word and last in _ENDINGS:
            good = True
        elif wide or not _LAST.match(last):
            good = False
        else:
            good = not spelled or real or (first not in _ORDINARY and last not in _ORDINARY)
        if good:
            best, n_best = label.end(), len(dots)
    return best, dots[:n_best]


def _local_start(text: str, end: int, done: int) -> tuple[int, list[tuple[int, int]]]:
    """Start of the local part that ends at a place, and its spelled-out dots."""
    start, dots = end, []
    while True:
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        k = start
        while k > done and text[k - 1] in " \t":
            k -= 1
        j = k - 3
        if k == start or j < done or text[j:k].lower() != "dot":
            break
        i = j
        while i > done and text[i - 1] in " \t":
            i -= 1
        if i == j or i <= done or text[i - 1] not in _LOCAL:
            break
        dots.append((i, start))
        start = i
    while start < end and not text[start].isalnum():
        start += 1
    return start, [d for d in reversed(dots) if d[0] > start]


def _is_address(text: str, start: int, at: int, end: int, spelled: bool) -> bool:
    """Whether "x at y.z" is an address rather than words before the name of a site.

    It is if x looks like an account (a letter, and a digit or a sign other than a
    hyphen), if a word such as "mail" or "contact" leads to it, or if it stands by itself.
    """
    local = text[start:at]
    if local.endswith(".") or local.lower() in _ORDINARY or not any(c.isalpha() for c in local):
        return False
    if spelled or any(c.isdigit() or c in "._%+" for c in local):
        return True
    if _CUE.search(text[max(0, start - 80) : start]):
        return True
    before = text[max(0, start - 80) : start].rstrip(" \t")
    alone = before[-1] in '\n<([{"“«:' if before else start <= 80
    return alone and _ALONE_END.match(text, end) is not None


def _is_number(label: str) -> bool:
    return label in _SPELLED or label.isdigit()


def _posed_digits(text: str) -> list[tuple[int, int, str]]:
    """Changes that turn signs posing as digits into digits.

    Only runs of such words count that have a sign right beside a digit. There, words
    with a digit are rewritten, and words without one between two that have.
    """
    changes = []
    for run in _POSED_RUN.finditer(text):
        if not _POSED.search(run[0]):
            continue
        words = list(_POSED_WORD.finditer(run[0]))
        real = [False, *(_DIGIT.search(w[0]) is not None for w in words), False]
        for k, w in enumerate(words, 1):
            if real[k] or (real[k - 1] and real[k + 1]):
                at = run.start() + w.start()
                changes += [(at + i, at + i + 1, _POSING[char]) for i, char in enumerate(w[0]) if char in _POSING]
    return changes


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Changes that turn the runs of spelled digits into digits."""
    changes = []
    for run in _SPELLED_RUN.finditer(text):
        words = list(_SPELLED_WORD.finditer(run[0]))
        if not any(w[0].lower() in _SPELLED for w in words):
            continue
        for w, after in zip(words, [*words[1:], None], strict=True):
            new = _SPELLED.get(w[0].lower(), w[0])
            # What stands between the digits of a run goes, so that they join; a dot
            # right between them stays, as in an address of numbers.
            changes.append((run.start() + w.start(), run.start() + w.end(), new))
            if after is not None and run[0][w.end() : after.start()] != ".":
                changes.append((run.start() + w.end(), run.start() + after.start(), ""))
    return changes


def find_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and all spans with the disguised ones, of each kind by start."""
    base = base_spans(text)
    own = normalise(text)
    if own.text == text:
        return base, base
    # Disjoint stretches that base spans cover, by start; added spans join them.
    taken: list[tuple[int, int]] = []
    for a, b in sorted(s for spans in base for s in spans):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    every = [list(spans) for spans in base]
    for spans, more in zip(every, base_spans(own.text), strict=True):
        for a, b in more:
            start, end = own.source(a, b)
            at = bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                spans.append((start, end))
                taken.insert(at, (start, end))
        spans.sort()
    return base, every


def listed(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end of all spans by kind and start, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans of each kind, the base spans and all spans, as text, of every document."""
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in KINDS), "n_added", "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch, texts in chunks(batches, "text"):
            found = [find_spans(t) for t in texts.to_pylist()]
            counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            added = pa.array([sum(map(len, every)) - sum(map(len, base)) for base, every in found], pa.int64())
            spans = [pa.array([listed(x[k]) for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, added, *spans], names=names)

    narrow = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base string, spans string"
    return narrow.mapInArrow(run, out).withColumnRenamed("id", id_col)


def masked_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    _, every = find_spans(text)
    if not any(every):
        return text
    spans = sorted((a, b, kind) for kind, own in zip(KINDS, every, strict=True) for a, b in own)
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with personal data masked in their texts; all other columns stay."""
    return replaced(documents, text_col, lambda texts: pa.array([masked_text(t) for t in texts.to_pylist()], pa.string()))
