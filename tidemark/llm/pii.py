"""Personal data in texts, disguised or plain, with the places in the source text.

Plain identifiers (the base) are emails, IPv4 addresses, payment cards and phone numbers. On top of these,
transducers rewrite a text that shows signs of a disguise: look-alike letters and digits of other scripts become
ASCII and invisible characters go, spelled digits become digits, and written-out "at" and "dot" become signs. Each
keeps, for every character it puts out, the stretch of the source it stands for. Identifiers found in the rewritten
text, with a rewritten character in them, are mapped back to the source and join the base spans.

Spans are in code points, the end exclusive. Defined results: null and empty texts have no spans; a base span always
stays, and a found span that overlaps a base span of its kind is left out; of several found ones the first wins.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
_CYRILLIC = dict(zip("аАВеЕкКМНоОрРсСТуУхХіІјЈѕЅԁԛԝһҺ", "aABeEkKMHoOpPcCTyYxXiIjJsSdqwhH", strict=True))
_GREEK = dict(zip("αΑΒΕεΖΗιΙΚκΜΝνΟορΡΤυΥΧχ", "aABEeZHiIKkMNvOopPTuYXx", strict=True))
_SIGNS = dict(zip("․。｡﹒﹫‐‑‒–—−∙", "....@------.", strict=True))
_HIDDEN = "­​‌‍⁠﻿"


def _fold(c: str) -> str | None:
    """The ASCII character that c stands for, "" if it is invisible, None if it stays."""
    if c in _HIDDEN:
        return ""
    if (found := _CYRILLIC.get(c) or _GREEK.get(c) or _SIGNS.get(c)) is not None:
        return found
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    wide = unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFF5E or 0x1D400 <= ord(c) <= 0x1D7FF or 0x2460 <= ord(c) <= 0x24E9 else ""
    return wide if len(wide) == 1 and wide.isascii() else None


#: Anything that _fold may change: not ASCII, not the rest of Latin, nor what a text in these scripts is full of.
_MAYBE_FOLDED = re.compile("[­Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍‐-—․⁠−∙①-ⓩ。﹒﹫﻿！-｡\U0001d400-\U0001d7ff]")

# Digits by name, in the languages of the corpus.
DIGITS = {
    **dict.fromkeys(("zero", "oh", "null", "cero", "zéro"), "0"),
    **dict.fromkeys(("one", "eins", "uno", "un"), "1"),
    **dict.fromkeys(("two", "zwei", "dos", "deux"), "2"),
    **dict.fromkeys(("three", "drei", "tres", "trois"), "3"),
    **dict.fromkeys(("four", "vier", "cuatro", "quatre"), "4"),
    **dict.fromkeys(("five", "fünf", "cinco", "cinq"), "5"),
    **dict.fromkeys(("six", "sechs", "seis"), "6"),
    **dict.fromkeys(("seven", "sieben", "siete", "sept"), "7"),
    **dict.fromkeys(("eight", "acht", "ocho", "huit"), "8"),
    **dict.fromkeys(("nine", "neun", "nueve", "neuf"), "9"),
}
_NAME = "|".join(sorted(DIGITS, key=lambda w: (-len(w), w)))
_ONE = rf"(?:{_NAME}|[0-9]+)"
#: A run of digits of which some are spelled: four or more in all, with or without a plus before it.
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:\+|plus)[ ]?)?{_ONE}(?:[ ,()-]{{1,3}}{_ONE}|[ ]?(?:dot|punkt|punto|point|\.)[ ]?{_ONE}){{3,}}(?![^\W_])", re.I)
#: Cheap tests on lower-case text (with a blank before it): without a match, the patterns above and below find nothing.
_MAY_SPELL = re.compile(rf"[^\w](?:{_NAME})(?:[ ,()-]{{1,3}}|[ ]?(?:dot|punkt|punto|point|\.)[ ]?)(?:{_NAME}|[0-9])")
_MAY_AT = re.compile(r"[\[({<][ ]?(?:at|@)|[ ](?:at|@)[ ]")
#: Four or more numbers joined by dots alone, written out, in brackets or plain.
_DOT_CHAIN = re.compile(rf"(?<![^\W_])(?:{_NAME}|[0-9]++)(?:(?:[ ]?(?:dot|punkt|punto|point)[ ]?|[ ]?[\[({{<][ ]?(?:dot|\.)[ ]?[\])}}>][ ]?|\.)(?:{_NAME}|[0-9]++)){{3,}}(?![^\W_])", re.I)
_MAY_DOT = re.compile(rf"[\[({{<][ ]?(?:dot|\.)|[ ]dot[ ]|(?:dot|punkt|punto|point)[ ]?(?:{_NAME}|[0-9])")
_WRITTEN_DOT = re.compile(r"dot|punkt|punto|point|[\[({<]", re.I)
_PIECE = re.compile(rf"(?:\+|plus)|{_NAME}|[0-9]|dot|punkt|punto|point|\.", re.I)
_AT = re.compile(r"[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?|[ ](?:at|@)[ ](?=[a-z0-9-]{1,63}(?:[ ]dot[ ]|[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?))", re.I)
_DOT = re.compile(r"(?<=[a-z0-9])(?:[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?|[ ]dot[ ])(?=[a-z0-9])", re.I)


class Mapped:
    """A text and, for each of its characters, the stretch of the source it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replaces stretches [a, b) by characters, each with the stretch of the present text that it stands for."""
        text, starts, ends, new, at = [], [], [], [], 0
        for a, b, put in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            new += self.new[at:a]
            for c, i, j in put:
                text.append(c)
                starts.append(self.starts[i])
                ends.append(self.ends[j - 1])
                new.append(True)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends, self.new = "".join(text), starts + self.starts[at:], ends + self.ends[at:], new + self.new[at:]

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _homoglyphs(m: Mapped) -> None:
    edits = []
    for hit in _MAYBE_FOLDED.finditer(m.text):
        if (c := _fold(hit[0])) is not None:
            edits.append((hit.start(), hit.end(), [(c, hit.start(), hit.end())] if c else []))
    m.rewrite(edits)


def _spelled(m: Mapped) -> None:
    edits = []
    for hit in _SPELLED.finditer(m.text):
        pieces = list(_PIECE.finditer(m.text, *hit.span()))
        if sum(p[0].lower() in DIGITS for p in pieces) < 3:
            continue
        put = []
        for p in pieces:
            w = p[0].lower()
            put.append((DIGITS.get(w) or ("+" if w in ("+", "plus") else w if w.isdigit() else "."), *p.span()))
        edits.append((*hit.span(), put))
    m.rewrite(edits)


def _dotted(m: Mapped) -> None:
    """Chains of numbers with a written dot, whatever part of the numbers is spelled."""
    edits = []
    for hit in _DOT_CHAIN.finditer(m.text):
        if _WRITTEN_DOT.search(hit[0]):
            pieces = list(_PIECE.finditer(m.text, *hit.span()))
            edits.append((*hit.span(), [(DIGITS.get(w := p[0].lower()) or (w if w.isdigit() else "."), *p.span()) for p in pieces]))
    m.rewrite(edits)


def _at_dot(m: Mapped) -> None:
    for sign, pattern in (("@", _AT), (".", _DOT)):
        m.rewrite([(*hit.span(), [(sign, *hit.span())]) for hit in pattern.finditer(m.text)])


def _emails(text: str) -> list[Span]:
    """The at signs, each with the local part that ends and the domain that starts there."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def _ips(text: str) -> list[Span]:
    """Of each chain of dotted numbers, every four in turn."""
    out = []
    for chain in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four):
                out.append((four[0].start(), four[3].end()))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> dict[str, list[Span]]:
    """The base identifiers of each kind: leftmost, not overlapping within a kind."""
    cards = [m.span() for m in _CARD.finditer(text) if len(d := _digits(m[0])) <= 19 and _luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": _emails(text) if "@" in text else [], "ip": _ips(text), "card": cards, "phone": phones}


def disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers that show only after rewriting, as spans of the source."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    low = " " + text.lower()
    folded = not text.isascii() and _MAYBE_FOLDED.search(text)
    dots = _MAY_DOT.search(low) and (_DOT.search(text) or _DOT_CHAIN.search(text))
    if not folded and not dots and not (_MAY_AT.search(low) and _AT.search(text)) and not (_MAY_SPELL.search(low) and _SPELLED.search(text)):
        return out
    m = Mapped(text)
    for transducer in (_homoglyphs, _spelled, _dotted, _at_dot):
        transducer(m)
    for kind, spans in find(m.text).items():
        at, i, plain = 0, 0, base[kind]
        for span in spans:
            a, b = m.source(span)
            # Both lists are in order and free of overlaps.
            while i < len(plain) and plain[i][1] <= a:
                i += 1
            if any(m.new[span[0] : span[1]]) and a >= at and not (i < len(plain) and plain[i][0] < b):
                out[kind].append((a, b))
                at = b
    return out


def written(spans: dict[str, list[Span]]) -> str:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    rows = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans[kind])
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def spans_of(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and all spans."""
    base = find(text or "")
    more = disguised(text or "", base)
    return base, {k: base[k] + more[k] for k in KINDS}


def redacted(text: str | None) -> str | None:
    """The text with <KIND> for each identifier; overlapping ones become one, named after the first."""
    if not text:
        return text
    rows = sorted((a, -b, k) for k, kind in enumerate(KINDS) for a, b in spans_of(text)[1][kind])
    out, at = [], 0
    for a, b, k in rows:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row."""

    def work(batches):
        for b in batches:
            found = [spans_of(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.record_batch([b.column(0), *counts, digests, pa.array([written(every) for _, every in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return common.map_batches(docs.select("doc_id", "text"), work, f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the identifiers in the text replaced."""

    def work(batches):
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([redacted(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return common.map_batches(docs, work, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without personal data in their texts; n_chars follows the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out
