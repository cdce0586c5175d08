"""Personal data with offset-preserving deobfuscation.

Identifiers are found in the text as it is, and again in a normalised text
that three transducers write: look-alike characters to ASCII, spelled digits to
digits, at and dot disguises to ``@`` and ``.``. Every normalised character
keeps its source range, so a span found there maps back to source characters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
SLICE = 256  # rows of a batch that are Python strings at a time

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a start inside a run of digits would see the same dots, so only its first digit is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        if domain := _DOMAIN.match(text, at + 1):
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                yield start, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _valid_ip(found: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found.split(".")))


def _valid_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if _valid_ip(m.group())]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if _valid_card(m.group())]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


class Traced:
    """A text whose characters know their source ranges."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges, given in order; each new character comes from its
        whole range."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += self.text[at:a], new
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def look_alikes() -> dict[str, str]:
    """By rule: compatibility forms of one ASCII character, decimal digits of
    all scripts, dashes, spaces; zero-width characters vanish. Letters that
    look like Latin ones are fixed values."""
    table = {}
    for code in range(0x80, 0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        plain = unicodedata.normalize("NFKC", c)
        if kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif len(plain) == 1 and 32 < ord(plain) < 127 and kind != "No":
            table[c] = plain
        elif kind == "Pd" or code == 0x2212:
            table[c] = "-"
        elif kind == "Zs":
            table[c] = " "
        elif kind == "Cf":
            table[c] = ""
    # fixed values: Cyrillic and Greek letters and Latin ones
    alike = ("аa вb сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ԝw хx уy АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY "
             "αa εe ιi κk νv οo ρp τt υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi 。. ․.")
    return table | {pair[0]: pair[1] for pair in alike.split()}


#: Digit words of four languages (fixed values).
SPELLED = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
                                   "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
           for i, w in enumerate(words.split())} | {"oh": "0"}
SPELLED_RUN = 4  # digits of digit words and figures in a row

_OPEN, _SHUT = r"[\(\[\{<]\s{0,3}", r"\s{0,3}[\)\]\}>]"
_AT = rf"\s{{0,3}}{_OPEN}(?:at|@){_SHUT}\s{{0,3}}"
_DOT = rf"\s{{0,3}}{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}\s{{0,3}}"
_BARE_AT, _BARE_DOT = r"(?:\s{1,3}|_)at(?:\s{1,3}|_)", r"(?:\s{1,3}|_)dot(?:\s{1,3}|_)"
_SPACED_AT, _SPACED_DOT = r"\s{0,3}@\s{0,3}", r"\s{0,3}\.\s{0,3}"


class Normaliser:
    def __init__(self):
        self.alike = look_alikes()
        word = "|".join(sorted(SPELLED, key=len, reverse=True))
        self.run = re.compile(rf"(?i)\b(?:plus[\s,-]{{1,3}})?(?:(?:{word}|[0-9]++)\b[\s,.-]{{1,3}})+(?:{word}|[0-9]++)\b")
        self.part = re.compile(rf"(?i)\b(?:plus|{word})\b|[0-9]+")
        octet = rf"(?:{word}|[0-9]{{1,3}})(?:[\s-]{{1,3}}(?:{word}|[0-9]{{1,3}})){{0,2}}"
        self.number = re.compile(rf"(?i)(?<!\w){octet}(?:{_BARE_DOT}{octet}){{3}}(?!\w)")
        label = r"[A-Za-z0-9-]{1,63}"
        dot = rf"(?:\.|{_DOT}|{_BARE_DOT})"
        self.mail = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+-][A-Za-z0-9%+_.-]{{0,63}}?(?:{dot}[A-Za-z0-9%+_-]{{1,63}}){{0,3}}"
                               rf"(?:{_AT}|{_BARE_AT}|{_SPACED_AT}){label}(?:{dot}{label}){{1,5}}(?![A-Za-z0-9-])")
        self.ats, self.dots = re.compile(rf"(?i){_AT}|{_BARE_AT}|{_SPACED_AT}"), re.compile(rf"(?i){_DOT}|{_BARE_DOT}|{_SPACED_DOT}")
        self.wrapped = re.compile(r"[(\[{<]\s{0,3}(?:at|\.|punkt|point|punto)\s{0,3}[)\]}>]")
        self.octets = re.compile(rf"(?i)[0-9]{{1,3}}(?:(?:\.|{_DOT}|{_BARE_DOT})[0-9]{{1,3}}){{3}}")

    def __call__(self, text: str) -> Traced | None:
        """None: nothing to normalise."""
        out = None
        if not text.isascii() and not self.alike.keys().isdisjoint(set(text)):
            out = Traced(text)
            out.rewrite([(i, i + 1, self.alike[c]) for i, c in enumerate(text) if c in self.alike])
            text = out.text
        low = text.lower()
        parts = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
        flags = bytes(map(SPELLED.__contains__, parts))
        digits = b"\1" * SPELLED_RUN in flags or (" dot " in low and 1 in flags) or (
            1 in flags and any(f and any(x[-1:].isdigit() or x[:1].isdigit() for x in (*parts[max(0, i - 1):i], *parts[i + 1:i + 2])) for i, f in enumerate(flags)))
        hidden = "dot" in low or "@" in low or self.wrapped.search(low)
        if not (digits or hidden):
            return out
        edits = [e for a, b in (self._runs(text) if digits else ()) for e in self._digits(text, a, b)]
        if digits:  # address parts in words, joined by the word dot
            busy = {a for a, _, _ in edits}
            edits += [e for m in self.number.finditer(text) for e in self._digits(text, *m.span()) if e[0] not in busy]
        if edits:
            out = out or Traced(text)
            out.rewrite(sorted(edits))
            text = out.text
        edits = []
        if hidden:
            for m in self.mail.finditer(text):
                plain = self._mail(m.group())
                edits += [(m.start() + a, m.start() + b, new) for a, b, new in plain]
            taken = {i for a, b, _ in edits for i in range(a, b)}
            for m in self.octets.finditer(text):
                edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in self.dots.finditer(m.group())
                          if d.group() != "." and m.start() + d.start() not in taken]
        if edits:
            out = out or Traced(text)
            out.rewrite(sorted(edits))
        return out

    def _runs(self, text: str) -> Iterator[tuple[int, int]]:
        """Ranges of digit words, or of them and figures, with SPELLED_RUN digits
        or more. A single digit word beside a number that stands as it is
        is an ordinary word."""
        plain = None
        for m in self.run.finditer(text):
            parts = [x.group() for x in self.part.finditer(text, *m.span())]
            figures = [x for x in parts if x[0].isdigit()]
            n = sum(x.lower() in SPELLED for x in parts)
            if not n or n + sum(map(len, figures)) < SPELLED_RUN:
                continue
            if figures and n == 1:
                plain = detect(text) if plain is None else plain
                if any(kind and a < m.end() and m.start() < b for kind, a, b in plain):
                    continue
            yield m.span()

    def _digits(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        """One digit for each word; what stands between two of them, or one and a figure, goes."""
        out, last, figure = [], a, False
        for m in self.part.finditer(text, a, b):
            between, word = text[last:m.start()], m.group().lower()
            both, figure = figure and word[0].isdigit(), word[0].isdigit()
            if m.start() > last and not both and not between.strip(" \t\n,-"):
                out.append((last, m.start(), ""))
            if not figure:
                out.append((*m.span(), "+" if word == "plus" else SPELLED[word]))
            last = m.end()
        return out

    def _mail(self, found: str) -> list[tuple[int, int, str]]:
        """Edits that turn a disguised address into a plain one. A bare ``at``
        counts only where a dot is disguised too."""
        ats = list(self.ats.finditer(found))
        if not ats:
            return []
        at = ats[-1]
        dots = [d for d in self.dots.finditer(found) if d.end() <= at.start() or d.start() >= at.end()]
        hidden = [d for d in dots if d.group() != "."]
        if "@" not in at.group() and re.fullmatch(rf"(?i){_BARE_AT}", at.group()) and not hidden:
            return []
        if at.group() == "@" and not hidden:
            return []
        return sorted([(*d.span(), ".") for d in hidden] + [(*at.span(), "@")] * (at.group() != "@"))


def spans_of(text: str, normalise: Normaliser) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, base) of all spans, in order."""
    base = detect(text)
    out = {span: True for span in base}
    if traced := normalise(text):
        for kind, a, b in detect(traced.text):
            span = (kind, traced.start[a], traced.end[b - 1])
            before = base[max(0, bisect.bisect_right(base, (*span[:2], len(text))) - 1):][:1]  # of its kind, the only one that can hold it
            if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in before):
                out.setdefault(span, False)
    return [(*span, own) for span, own in sorted(out.items())]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and ``spans``, an array of (kind, start,
    end, base) in code points, end exclusive, by kind as in KINDS, then start.
    ``base``: found in the text as it is. Spans of the normalised text are added
    unless they lie within a base span of their kind.

    Whole texts are searched; a null or empty text has no spans; repeated rows
    stay; an empty table gives an empty result; other columns are ignored. The
    searches take time in proportion to the text (no nested repetition over one
    character class), and rows pass through in small slices.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise = Normaliser()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in spans_of(t, normalise)] if t else []
                         for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(run, schema)


def masked(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; of spans that
    overlap, what is covered goes once, under the first one's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += text[at:s["start"]], f"[{s['kind'].upper()}]"
        at = max(at, s["end"])
    return "".join(out) + text[at:]
