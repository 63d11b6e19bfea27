"""Personal data with offset-preserving deobfuscation.

Identifiers are found in the text itself (base spans). Transducers then rewrite a disguised text - look-alike
characters, invisible characters, digits spelled as words, "at" and "dot" in place of signs - and keep for
each character that they write the source range that it stands for. Identifiers of the rewritten text are
mapped back to source ranges and added unless they lie within a base span of their kind: a plain fragment
of a disguised identifier stays a base span, and the whole identifier is added to it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, trimmed, tuned

KINDS = ("email", "ip", "card", "phone")
# every pattern reads a text in one pass: what repeats is possessive, and runs are entered at their first character only
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Look-alikes of ASCII letters and digits among Cyrillic and Greek letters, and signs (fixed values).
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ո": "n", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
_GONE = "­​‌‍⁠﻿"
_FOLD = re.compile("[" + re.escape("".join(_ALIKE)) + _GONE + "！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९①-⑨]")
_NUMBER = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(_NUMBER) + ")(?![A-Za-z])"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z]){_WORD}(?:[\x20-]++(?:{_WORD}|(?:dot|point)(?![A-Za-z])|[0-9.()](?:-*+[0-9.()])*+(?![A-Za-z]))){{2,}}+", re.I)
_ONE = re.compile(rf"(?P<digit>{_WORD})|(?P<dot>dot|point)(?![A-Za-z])", re.I)
_PLUS = re.compile(rf"(?<![A-Za-z])plus[\x20-]++(?={_WORD}|[0-9])", re.I)
_BRACKETED = r"(?<!\x20)\x20*+[\[({{<]\x20*+{0}\x20*+[\])}}>]\x20*+"
_AT = re.compile(_BRACKETED.format("at") + r"|(?<!\x20)\x20++(?:at\x20++|@\x20*+)|(?<=[A-Za-z0-9])@\x20++", re.I)
_PLAIN_AT = re.compile(r"(?<!\x20)\x20++at\x20++", re.I)
_DOT = re.compile(_BRACKETED.format(r"(?:dot|\.)") + r"|(?<!\x20)\x20++dot\x20++", re.I)
_SIGN = re.compile(_BRACKETED.format("at") + r"|(?<!\x20)\x20++at\x20++|(?<!\x20)\x20*+@\x20*+", re.I)
# names with full stops in them, and spelled dots between them; then a sign; then labels with either between them
_CHAIN = re.compile(rf"[A-Za-z0-9._%+-]++(?:(?:{_DOT.pattern})[A-Za-z0-9._%+-]++)*+", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_DOT.pattern}|\.)[A-Za-z0-9-]++)++", re.I)
#: Endings of files that aren't endings of domains: "look at notes.txt" is prose.
_FILES = frozenset("bak bat bmp cfg class conf cpp css csv dat dll doc docx exe gif gz html htm ini ipynb jar java jpeg jpg js json jsonl lock log mkv mp npy pdf parquet php png pptx sql svg tar tex toml tsv txt wav xls xlsx xml yaml yml".split())
_KNOWN = frozenset("com org net edu gov io info example test".split())
_HINT = re.compile(r"[\[({<]\x20*+(?:at|dot|\.)\x20*+[\])}>]|\x20at\x20++[^\s.]++\.[^\s]|\x20dot\x20|\x20@|@\x20", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Left of each sign, as far as names reach and the last find allows; right of it, the labels."""
    out, last, sign = [], 0, text.find("@")
    while sign >= 0:
        a = sign
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < sign and (domain := _DOMAIN.match(text, sign + 1)):
            last = domain.end()
            out.append((0, a, last))
        last = max(last, sign + 1)
        sign = text.find("@", last)
    return out


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the identifiers that stand in the text as they are, by kind, then start."""
    out = []
    if "@" in text:
        out += _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _address(local: str, domain: str, after: str) -> bool:
    """Whether "local at domain", with plain dots, has the form of an address: no space follows a dot, the last
    label has two letters or more and ends at a boundary, and the local part starts and ends with a letter, digit,
    _, + or -. Any ending will do but one of a file or a time ("9.am"). A capitalised last label, if it is not one
    of _KNOWN, begins the next sentence ("at noon.Then") and is passed over."""
    labels = domain.split(".")
    whole = not (after.isalnum() or after == "_")
    while len(labels) > 1 and whole and labels[-1][:1].isupper() and labels[-1][1:].islower() and labels[-1].lower() not in _KNOWN:
        labels.pop()
    last = labels[-1].lower()
    if len(labels) < 2 or not whole or not all(labels) or not (re.fullmatch("[a-z]{2,}", last) or re.fullmatch("xn--[a-z0-9-]+", last)) or last in _FILES:
        return False
    if last in ("am", "pm") and labels[-2].isdigit():
        return False
    return ".." not in local and local[0] not in ".%" and local[-1] not in ".%" and len(local) <= 64


class Tape:
    """A text with, for each character, the source range it stands for (None: nothing was rewritten yet)."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the current text, given in order, without overlaps."""
        if not changes:
            return
        start = self.start or range(len(self.text))
        end = self.end or range(1, len(self.text) + 1)
        text, first, last, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            first += start[at:a]
            last += end[at:a]
            first += [start[a]] * len(new)
            last += [end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        first += start[at:]
        last += end[at:]
        self.text, self.start, self.end = "".join(text), first, last

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _plain(c: str) -> str:
    if c in _GONE:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    if 0x2460 <= ord(c) <= 0x2468:
        return chr(ord(c) - 0x2460 + 49)
    digit = unicodedata.digit(c, None)
    folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
    return _ALIKE.get(folded, folded)


def deobfuscate(text: str) -> Tape:
    """The text as the transducers rewrite it, one after the other."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), _plain(m[0])) for m in _FOLD.finditer(text)])
    changes = []
    for run in _SPELLED_RUN.finditer(tape.text):
        previous = None
        for m in _ONE.finditer(tape.text, run.start(), run.end()):
            # the gap between two digits goes with the second, so the digits stand together
            a = previous if previous is not None and not tape.text[previous : m.start()].strip(" -") else m.start()
            if m["dot"]:
                changes.append((a, m.end(), "."))
            else:
                changes.append((a, m.end(), _NUMBER[m["digit"].lower()]))
            previous = m.end()
    plus = [(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)]
    tape.rewrite(sorted(plus + changes))
    if _HINT.search(tape.text):
        changes, at = [], 0
        while chain := _CHAIN.search(tape.text, at):
            at = chain.end()
            if not ((sign := _SIGN.match(tape.text, at)) and (labels := _LABELS.match(tape.text, sign.end()))):
                continue
            at = labels.end()
            dots = [(x.start(), x.end(), ".") for part in (chain, labels) for x in _DOT.finditer(tape.text, *part.span())]
            if _PLAIN_AT.fullmatch(sign[0]) and not dots and not _address(chain[0], labels[0], tape.text[at : at + 1]):
                continue  # "look at it. Then" is prose
            if dots or sign[0] != "@":
                changes += [(*sign.span(), "@"), *dots]
        tape.rewrite(sorted(changes))
        tape_text = tape.text
        parts = [(m.start(), m.end(), ".") for m in _DOT.finditer(tape_text) if tape_text[m.start() - 1 : m.start()].isdigit() and tape_text[m.end() : m.end() + 1].isdigit()]
        tape.rewrite(parts)
    return tape


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a text (null: empty): (kind, start, end) by kind, then start."""
    text = text or ""
    base = identifiers(text)
    tape = deobfuscate(text)
    if tape.start is None:
        return base, base
    every = set(base)
    for kind, a, b in identifiers(tape.text):
        a, b = tape.source(a, b)
        # base spans of a kind don't overlap, so only the last that starts no later can hold this one
        k = bisect_right(base, (kind, a, len(text))) - 1
        if k < 0 or base[k][0] != kind or base[k][2] < b:
            every.add((kind, a, b))
    return base, sorted(every)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in found])


def detect(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """docs without the text, with n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans and n_base;
    or, with redact, docs with the text's spans replaced by [EMAIL], [IP], [CARD] or [PHONE] (of overlapping
    spans, by the kind of the first) and n_chars, if there is such a column, brought up to date.

    Whole texts are read, however long; null texts count as empty (redacted: stay null); offsets are code
    points. Each row is read for itself, so repeated rows repeat; an empty table gives an empty result.
    Columns of docs with the names added here are replaced.
    """
    added = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"]
    if not redact:
        docs = docs.drop(*added)
    names = [c for c in docs.columns if redact or c != text]
    schema = docs.select(*names).schema
    if not redact:
        for k in added:
            schema = schema.add(k, "string" if k in ("base_sha256", "spans") else "long")

    def cleaned(t: str | None) -> str | None:
        if not t:
            return t
        out, at, marks = [], 0, []
        for kind, a, b in sorted(spans(t)[1], key=lambda x: (x[1], -x[2])):
            if marks and a < marks[-1][2]:
                marks[-1] = (marks[-1][0], marks[-1][1], max(b, marks[-1][2]))
            else:
                marks.append((kind, a, b))
        for kind, a, b in marks:
            out += [t[at:a], f"[{KINDS[kind].upper()}]"]
            at = b
        return "".join(out) + t[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                columns = {c: part.column(c) for c in names}
                texts = part.column(text).to_pylist()
                if redact:
                    texts = [cleaned(t) for t in texts]
                    columns[text] = pa.array(texts, part.column(text).type)
                    if "n_chars" in columns:
                        columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                else:
                    found = [spans(t) for t in texts]
                    for k, kind in enumerate(KINDS):
                        columns[f"n_{kind}"] = pa.array([sum(x[0] == k for x in every) for _, every in found], pa.int64())
                    columns["base_sha256"] = pa.array([sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                    columns["spans"] = pa.array([written(every) for _, every in found], pa.string())
                    columns["n_base"] = pa.array([len(base) for base, _ in found], pa.int64())
                yield pa.record_batch(columns)

    return docs.mapInArrow(trimmed(run), schema)


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by marks."""
    tuned(spark)
    return detect(docs, redact=True)
