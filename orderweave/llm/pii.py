"""Personal data in texts, also behind disguises, with positions in the source text.

Plain detectors find e-mail addresses, IP and card numbers and phone numbers. A chain of
transducers then rewrites the text: homoglyphs and foreign digits to ASCII, invisible
characters away, spelled digits to digits, at/dot disguises to ``@`` and ``.``. Each
transducer keeps a map from its output to its input, so what the detectors find in the
rewritten text is mapped back to the characters of the source. All work is per text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderweave.llm.words import steps

KINDS = ("email", "ip", "card", "phone")

#: Look-alikes of ASCII letters beyond those that Unicode itself decomposes to them.
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁһԛАВЕКМНОРСТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρıɡ",
    "aeopcyxijsdhqABEKMHOPCTXABEZHIKMNOPTYXoavpig", strict=True))
#: Spelled digits in the languages of the corpus.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve"}
#: At least so many digits and spelled digits in a row count as a number.
MIN_SPELLED = 3
#: Words for the at sign and the dot in the languages of the corpus. ``at`` and ``chez`` also stand in prose,
#: and so do the nouns among the dots: behind those the last label has to be a known end of a host.
AT_WORDS, PROSE_AT = ("at", "ät", "arroba", "arobase", "arobas", "klammeraffe", "chez"), ("at", "ät", "chez", "@")
DOT_WORDS, DOT_NOUNS = ("dot", "punkt", "point", "punto"), ("punkt", "point", "punto")
GENERIC = frozenset("com org net edu gov mil int info biz name pro app dev io eu example test".split())
ENDS = GENERIC | frozenset("de fr es ch at be lu li it pt nl dk pl cz ca uk us mx ar cl co pe".split())
#: ``at this point it`` and ``point de`` are prose.
POINT_ENDS = GENERIC | frozenset("fr ch lu ca uk".split())
#: Characters of a disguised name before, and of a disguised host after, its at sign; the longest
#: address has 64 and 255, and a spoken dot takes five or so.
LEFT, RIGHT = 64 * 4, 255 * 4

_DIGIT_OF = {word: digit for digit, words in SPELLED.items() for word in words.split()}
_SINGLE = frozenset(_DIGIT_OF) | frozenset("0123456789")
_TOKEN = re.compile(r"[^\W_]+")
_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_GAP = r"[\x20\t,.·-]{1,3}"
_RUN = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9])(?:{_GAP}(?:{_WORD}|[0-9])(?![^\W_])){{{MIN_SPELLED - 1},}}+", re.I)
_PIECE = re.compile(rf"{_WORD}|[0-9]|{_GAP}", re.I)
#: Digits and spelled digits in any mixture; commas part numbers here.
_MIXED = re.compile(
    rf"(?<![^\W_])(?:{_WORD}(?![^\W_])|[0-9]++)(?:[\x20\t().·-]{{1,3}}(?:{_WORD}|[0-9]++)(?![^\W_]))++", re.I)
_PART = re.compile(rf"{_WORD}|[0-9]++", re.I)
_PLUS_BEFORE = re.compile(r"(?:\+|(?<![^\W_])plus[\x20\t]{1,3})\Z", re.I)
_MARK = re.compile(
    rf"[\[({{<][\x20\t]{{0,3}}(?:({'|'.join(AT_WORDS)}|@)|({'|'.join(DOT_WORDS)}|\.))[\x20\t]{{0,3}}[\])}}>]", re.I)
_PLUS = re.compile(r"plus[\x20\t]{1,3}(?=[0-9])", re.I)
_AT = re.compile(rf"\b(?:{'|'.join(AT_WORDS)})\b|@", re.I)
_DOTS = rf"\x20{{1,3}}(?:{'|'.join(DOT_WORDS)})\x20{{1,3}}"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_DOTS}|\x20\.\x20|\.)[A-Za-z0-9-]++)++", re.I)
_SEPARATOR = re.compile(rf"{_DOTS}|\x20\.\x20|\.", re.I)
# Backwards; beside a plain at sign only ``dot`` is no prose.
_EMAN, _EMAN_PLAIN = (re.compile(
    rf"[A-Za-z0-9_%+-]++(?:(?:\x20{{1,3}}(?:{'|'.join(w[::-1] for w in words)})\x20{{1,3}}|\.)[A-Za-z0-9_%+-]++)*+", re.I)
    for words in (DOT_WORDS, DOT_WORDS[:1]))
_SPOKEN_DOT = re.compile(rf"{_DOTS}|\x20\.\x20", re.I)
_SPEAKS = re.compile(rf"@|\x20(?:{'|'.join((*AT_WORDS, 'dot'))})\x20")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """The base detectors, each in time linear in the text; ordered by start, then kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _NUMBERS.finditer(text):
        # Four numbers at a time, from the left.
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            length = sum(map(len, parts[i: i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i: i + 4]):
                out.append((at, 1, at + length))
            at += length + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@cache
def _ascii_of(char: str) -> str:
    """What a homoglyph transducer makes of a character: ASCII, nothing, or the character."""
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    if unicodedata.category(char) == "Cf":
        return ""
    if unicodedata.decimal(char, None) is not None:
        return str(unicodedata.decimal(char))
    if char.isspace() and char not in "\n\r":
        return " "
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else char


class Rewritten:
    """A text and, for stretches of it, where they stand in the text before."""

    def __init__(self, text: str, at: list[int], source: list[int], copied: list[bool], length: int) -> None:
        self.text, self.at, self.source, self.copied, self.length = text, at, source, copied, length

    @classmethod
    def by(cls, text: str, changes: Iterator[tuple[int, int, str]]) -> Rewritten:
        """Apply ordered changes (start, end, new); new text stands for all of its stretch."""
        out, at, source, copied = [], [0], [0], [True]
        done = length = 0
        for start, end, new in changes:
            out += [text[done:start], new]
            length += start - done
            at += [length, length + len(new)]
            source += [start, end]
            copied += [False, True]
            length += len(new)
            done = end
        return cls("".join([*out, text[done:]]), at, source, copied, len(text))

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The stretch before the rewriting of [start, end), which is not empty."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[i] + (start - self.at[i]) * self.copied[i]
        if self.copied[j]:
            return first, self.source[j] + end - self.at[j]
        return first, self.source[j + 1]


def _glyphs(text: str) -> Iterator[tuple[int, int, str]]:
    odd = {c: new for c in set(text) if c > "\x7f" and (new := _ascii_of(c)) != c}
    if odd:
        for m in re.finditer("[" + re.escape("".join(odd)) + "]", text):
            yield m.start(), m.end(), odd[m[0]]


def _has_spelled(text: str) -> bool:
    """Whether MIN_SPELLED tokens in a row are single digits or spelled ones."""
    flags = bytes(map(_SINGLE.__contains__, _TOKEN.findall(text.lower())))
    return flags.find(b"\1" * MIN_SPELLED) >= 0


def _digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits as digits, and dots, commas and wide gaps beside them as one blank."""
    for m in _RUN.finditer(text):
        pieces = list(_PIECE.finditer(m[0]))
        if any(p[0].lower() in _DIGIT_OF for p in pieces):
            for p in pieces:
                new = _DIGIT_OF.get(p[0].lower(), p[0] if p[0] in "0123456789- " else " ")
                if new != p[0]:
                    yield m.start() + p.start(), m.start() + p.end(), new


def _has_mixed(text: str) -> bool:
    """Whether a number and a spelled digit stand side by side."""
    if not re.search("[0-9]", text):
        return False
    tokens = _TOKEN.findall(text.lower())
    return any(w in _DIGIT_OF and any(t[0] in "0123456789" for t in (*tokens[i - 1: i], *tokens[i + 1: i + 2]))
               for i, w in enumerate(tokens))


def _mixed(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits as digits in a run that so has the digits of a phone or card.

    Spelled digits at the ends of a run are left out where it is a number without them.
    """
    for m in _MIXED.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), _DIGIT_OF.get(p[0].lower())) for p in _PART.finditer(m[0])]
        numbers = [i for i, p in enumerate(parts) if p[2] is None]
        if not numbers or len(numbers) == len(parts):
            continue
        digits = [d or text[s:e] for s, e, d in parts]
        low, high = numbers[0], numbers[-1] + 1
        if sum(map(len, digits[low:high])) > 19:
            continue
        called = _PLUS_BEFORE.search(text, max(0, m.start() - 9), m.start()) is not None

        def fits(i: int, j: int) -> bool:
            number = "".join(digits[i:j])  # noqa: B023
            return (called and i == 0 and 10 <= len(number) <= 15) or (14 <= len(number) <= 19 and luhn(number))  # noqa: B023

        ways = [(low, high), *((i, j) for i in range(max(0, low - 19), low + 1) for j in range(min(len(parts), high + 19), high - 1, -1))]
        i, j = next((w for w in ways if fits(*w)), (0, 0))
        if all(d is None for _, _, d in parts[i:j]):
            continue
        for k in range(i, j):
            s, e, d = parts[k]
            if d:
                yield s, e, d
            if k + 1 < j and (gap := text[e:parts[k + 1][0]]) not in (" ", "-"):
                # What a phone may hold stays; a card takes one blank.
                new = re.sub("[\t·]+", " ", gap) if called and i == 0 else " "
                if new != gap:
                    yield e, parts[k + 1][0], new


def _plus(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PLUS.finditer(text):
        if m.start() == 0 or not text[m.start() - 1].isalnum():
            yield m.start(), m.end(), "+"


def _marks(text: str) -> Iterator[tuple[int, int, str]]:
    """``[at]``, ``(dot)`` and the like, with the blanks around them."""
    done = 0
    for m in _MARK.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        yield start, end, "@" if m[1] else "."
        done = end


def _host_end(text: str, host: re.Match, word: str) -> tuple[int, list[tuple[int, int]]]:
    """Where the host ends, and its spoken dots; the labels behind the last dot that is no prose do not count."""
    cuts = [(host.start() + d.start(), host.start() + d.end()) for d in _SEPARATOR.finditer(host[0])]
    ends = [*[s for s, _ in cuts[1:]], host.end()]
    while cuts:
        start, end = cuts[-1]
        dot, label = text[start:end].strip().lower(), text[end:ends[-1]]
        letters = len(label) > 1 and label.isalpha()
        if dot in DOT_NOUNS:
            known = label.lower() in (POINT_ENDS if dot == "point" else ENDS)
            good = letters and (known or word not in PROSE_AT or (word == "at" and dot != "point"))
        elif dot == "." and end - start == 1 and word != "@" and all(e - s == 1 for s, e in cuts):
            # A word before a host that is written out.
            good = letters and (word not in PROSE_AT or (label in (label.lower(), label.upper()) and (
                len(label) == 2 or label.lower() in GENERIC)))
        else:
            good = True
        if good:
            break
        cuts.pop()
        ends.pop()
    return (ends[-1] if cuts else host.start()), [(s, e) for s, e in cuts if e - s > 1]


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    """``name at host dot tld``: an address only where a dot or the at sign is spoken, or blanks stand around the sign."""
    done = 0
    for m in _AT.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while end < len(text) and text[end] == " " and end - m.end() < 3:
            end += 1
        while start > done and text[start - 1] == " " and m.start() - start < 3:
            start -= 1
        blanks = start < m.start() or end > m.end()
        host = _HOST.match(text, end, end + RIGHT) if (m[0] == "@" or (start < m.start() and end > m.end())) else None
        left = _EMAN_PLAIN if m[0] == "@" and not blanks else _EMAN
        name = left.match(text[max(done, start - LEFT):start][::-1]) if host else None
        if not name:
            continue
        stop, dots = _host_end(text, host, m[0].lower())
        plain = _DOMAIN.match(text, start) if m[0] == "@" and not blanks else None
        if plain and text[plain.end(): plain.end() + 3] == " . ":  # a sentence ends behind the address
            stop, dots = plain.end(), []
        first = start - name.end()
        before = [d.span() for d in _SPOKEN_DOT.finditer(text, first, start)]
        if stop == host.start() or not (dots or blanks or (plain and before)):
            continue
        for d in before:
            yield *d, "."
        if text[start:end] != "@":
            yield start, end, "@"
        for d in dots:
            yield *d, "."
        done = stop


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the disguised ones that overlap none of their kind, or hold all that they overlap."""
    base = plain_spans(text)
    chain: list[Rewritten] = []
    now = text

    def rewrite(*steps_) -> None:  # noqa: ANN002
        nonlocal now
        for step in steps_:
            changes = list(step(now))
            if changes:
                chain.append(Rewritten.by(now, iter(changes)))
                now = chain[-1].text

    if not text.isascii():
        rewrite(_glyphs)
    if _has_mixed(now):
        rewrite(_mixed)
    if _has_spelled(now):
        rewrite(_digits)
    lower = now.lower()
    if "plus" in lower:
        rewrite(_plus)
    if "[" in lower or "(" in lower or "{" in lower or "<" in lower:
        rewrite(_marks)
    if _SPEAKS.search(now.lower()):
        rewrite(_spoken)
    if not chain:
        return base, base
    spans = list(base)
    taken = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    for start, kind, end in plain_spans(now):
        for r in reversed(chain):
            start, end = r.back(start, end)
        # Base spans of a kind are ordered and apart: those from the first that ends behind the start.
        at = bisect_left(taken[kind], (end,))
        overlapped = []
        while at and taken[kind][at - 1][1] > start:
            at -= 1
            overlapped.append(taken[kind][at])
        if all(start <= s and e <= end for s, e in overlapped) and (start, end) not in overlapped:
            spans.append((start, kind, end))
    return base, sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes one mark, named by its first span."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, *keep: str, redact: bool = False) -> DataFrame:
    """The columns ``keep``, base and spans (arrays of kind, start, end); redact: also the clean text.

    Positions are code points of the source text, end exclusive, ordered by start and kind.
    Null or empty text: no spans; a null text stays null. Repeated rows: each its own result.
    An empty table gives an empty result. Extra columns are not touched.
    """
    kept = docs.select(*keep, F.col("text").cast("string").alias("text"))
    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]]
    schema = ", ".join([*fields, f"base {span}", f"spans {span}", *(["clean string"] if redact else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            texts = part.column(len(keep)).to_pylist()
            found = [all_spans(t or "") for t in texts]
            columns = [part.column(i) for i in range(len(keep))]
            columns += [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[which]] for f in found], arrow) for which in (0, 1)]
            if redact:
                columns.append(pa.array([t if t is None else redacted(t, f[1]) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "base", "spans", *(["clean"] if redact else [])])

    return kept.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, a hash of these, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with the found spans of ``text`` replaced by marks; all other columns unchanged."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("text"))
    out = find(plain, *[f"c{i}" for i, c in enumerate(names) if c != "text"], redact=True)
    return out.select(*[F.col("clean" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
