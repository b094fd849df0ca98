"""Personal data, also where it is disguised, with spans in the original text.

Base spans come from the text as it stands. Then a chain of small transducers
rewrites it: look-alike characters and unusual digits become ASCII and
invisible characters go, spelled digits become digits, and "at"/"dot"
disguises become @ and dots. Each keeps its edits, through which every character leads
back to the source characters that it stands for. The same detectors read the rewritten text, and
what they find is mapped back; a span that overlaps a base span of its kind is
dropped, as is one that the rewriting has not changed.

A plain "at" counts before a domain with a plain "dot". Before a domain with dots only, which running prose has too
("closed at 10.30", "us at example.com"), the domain must end in letters, and the name before it must hold a
digit or a sign, follow a word for mail, or stand alone with its address in a line, quotes or brackets.

All scans take linear time: a text of a hundred thousand digits or dots is no
special case.

Defined cases: a null text is empty. Spans of one kind never overlap; those of
different kinds may. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import arrow_map, importable, row_groups, utf8

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> list[Span]:
    """Every @ with the longest local part before it and a dotted domain behind it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", at + 1)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def identifiers(text: str) -> dict[str, list[Span]]:
    """Spans of every kind, leftmost and non-overlapping per kind."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(map(_small, m.groups()))]
        found["card"] = [m.span() for m in CARD.finditer(text) if _card(m[0])]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


#: Letters that look like ASCII ones, and the ASCII ones in the same order.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅοαενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdqwhABEKMHOPCTXIJSoaevikptuxABEZHIKMNOPTYX", strict=True))
#: Characters without a width; dashes; other dots.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
DOTS = "\u2024\u3002\uff61"
UNUSUAL = re.compile(r"[^\x00-\x7fÀ-ſ]")
#: Spelled digits.
SPELLED = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
SPELLED_WORD = r"(?:" + "|".join(SPELLED) + r")"
SPELLED_RUN = re.compile(rf"(?<![a-z]){SPELLED_WORD}(?:[ -]{{1,3}}{SPELLED_WORD})+(?![a-z])", re.I)
SPELLED_ONE = re.compile(SPELLED_WORD, re.I)
OPEN, CLOSE = r"[ \t]*[(\[{<][ \t]*", r"[ \t]*[)\]}>][ \t]*"
BRACKETED_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){OPEN}(?:at|@){CLOSE}(?=[A-Za-z0-9])", re.I)
BRACKETED_DOT = re.compile(rf"(?<=[A-Za-z0-9]){OPEN}(?:dot|\.){CLOSE}(?=[A-Za-z0-9])", re.I)
PLAIN_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]{1,63}(?:\.|[ \t]{1,3}dot[ \t]{1,3})[A-Za-z0-9])", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}[ \t]{1,3}dot[ \t]{1,3}[A-Za-z0-9]", re.I)
#: Endings of what comes before an address; words that are no one's name in one.
MAIL_WORDS = ("mail", "mails", "mail to", "mailto", "mail:", "contact")
PRONOUNS = frozenset("me us him her them it you".split())
#: The empty string stands for a text's start or end. Plain numbers and their like are no names.
ALONE = ("", "\n", "\r", ":", "<", ">", "(", ")", "[", "]", '"')
NOT_NAME = re.compile(r"[0-9.%+-]+|[a-z]+[.%-]+|-+[a-z]+")
PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])", re.I)


class Rewritten:
    """A text and the edits that made it, from which a span's source follows.

    What is kept grows with the edits and not with the text.
    """

    def __init__(self, text: str):
        self.text, self.rounds = text, []

    def replace(self, pieces: list[tuple[int, int, str]]):
        """Put strings in place of ranges, which are in order and apart."""
        if not pieces:
            return
        texts, places, edits, at, grown = [], [], [], 0, 0
        for a, b, new in pieces:
            texts += [self.text[at:a], new]
            places.append(a + grown)
            grown += len(new) - (b - a)
            edits.append((a, b, b + grown))
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.rounds.append((places, edits))

    def source(self, start: int, end: int) -> Span:
        """Where the source characters of a span that is not empty begin and end."""
        first, last = start, end - 1
        for places, edits in reversed(self.rounds):
            first, last = self._before(places, edits, first, 0), self._before(places, edits, last, 1)
        return first, last + 1

    @staticmethod
    def _before(places, edits, at: int, side: int) -> int:
        """The character that one was made from: of a replaced range the first or the last."""
        k = bisect_right(places, at) - 1
        if k < 0:
            return at
        a, b, end = edits[k]
        return (a, b - 1)[side] if at < end else at - end + b


def _plain(c: str) -> str:
    """The ASCII character that ``c`` stands for, or ``c``."""
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in DOTS:
        return "."
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def look_alikes(own: Rewritten):
    found = ((m.start(), m.end(), _plain(m[0])) for m in UNUSUAL.finditer(own.text))
    own.replace([(a, b, new) for a, b, new in found if new != own.text[a:b]])


def spelled_digits(own: Rewritten):
    pieces = []
    for run in SPELLED_RUN.finditer(own.text):
        words = list(SPELLED_ONE.finditer(own.text, *run.span()))
        # A digit stands for its word and the gap behind it; the last one for its word alone.
        ends = [w.start() for w in words[1:]] + [words[-1].end()]
        pieces += [(w.start(), end, str(SPELLED.index(w[0].lower()))) for w, end in zip(words, ends)]
    own.replace(pieces)


def _in_address(text: str, at: re.Match) -> bool:
    """Whether a plain "at" is an address's and not that of running prose."""
    if SPELLED_DOMAIN.match(text, at.end()):
        return True
    domain = DOMAIN.match(text, at.end())
    last = domain[0].rstrip("-").rpartition(".")[2] if domain else ""
    if len(last) < 2 or not last.isalpha():
        return False
    start = at.start()
    while start > 0 and text[start - 1] in LOCAL:
        start -= 1
    name = text[start : at.start()].lower()
    if not name.isalpha():
        return not NOT_NAME.fullmatch(name)
    before = text[max(0, start - 16) : start].rstrip(" \t").lower()
    if name in PRONOUNS:
        return False
    return before.endswith(MAIL_WORDS) or before[-1:] in ALONE and text[domain.end() : domain.end() + 1] in ALONE


def at_and_dot(own: Rewritten):
    for pattern, sign in ((BRACKETED_AT, "@"), (BRACKETED_DOT, ".")):
        own.replace([(m.start(), m.end(), sign) for m in pattern.finditer(own.text)])
    own.replace([(m.start(), m.end(), "@") for m in PLAIN_AT.finditer(own.text) if _in_address(own.text, m)])
    if "@" in own.text:
        pieces = []
        for m in PLAIN_DOT.finditer(own.text):
            # Only within an address: back to the @ there is nothing but its domain.
            a = m.start()
            before = pieces[-1] if pieces else (0, 0, "")
            while a > before[1] and (own.text[a - 1].isalnum() or own.text[a - 1] in "-."):
                a -= 1
            inside = a > 0 and own.text[a - 1] == "@" or bool(pieces) and a == before[1]
            if inside:
                pieces.append((m.start(), m.end(), "."))
        own.replace(pieces)


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that appear only when the text's disguises are taken off."""
    own = Rewritten(text)
    look_alikes(own)
    spelled_digits(own)
    at_and_dot(own)
    if own.text == text:
        return {}
    found = {}
    for kind, spans in identifiers(own.text).items():
        kept = []
        for a, b in spans:
            start, end = own.source(a, b)
            apart = all(end <= s or e <= start for s, e in base[kind])
            if apart and text[start:end] != own.text[a:b]:
                kept.append((start, end))
        if kept:
            found[kind] = kept
    return found


SPAN = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans by kind, then start."""
    text = text or ""
    base = identifiers(text)
    more = added(text, base)
    rows = []
    for kind in KINDS:
        rows += sorted([(kind, a, b, True) for a, b in base[kind]] + [(kind, a, b, False) for a, b in more.get(kind, [])])
    return rows


_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
)


def find_personal_data(documents: DataFrame, output: str = "spans") -> DataFrame:
    """All columns and the spans of every text; a column of that name is replaced."""
    importable(documents.sparkSession)
    own = documents.select([c for c in documents.columns if c.lower() != output.lower()])
    text = own.columns.index("text")

    def run(batch):
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows = [[dict(zip(("kind", "start", "stop", "base"), s)) for s in spans_of(t.as_py())] for t in part.column(text)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _SPAN_TYPE)], [*part.schema.names, output])

    return arrow_map(own, T.StructType([*own.schema.fields, T.StructField(output, T._parse_datatype_string(SPAN))]), run)


def masked(text: str, rows) -> str:
    """The text with every span, or run of overlapping ones, replaced by its first kind."""
    parts, at = [], 0
    for a, b, kind in sorted((r["start"], r["stop"], r["kind"]) for r in rows):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def mask(texts, spans):
    return texts.combine(spans, lambda text, rows: text if text is None or not len(rows) else masked(text, rows))


def mask_documents(documents: DataFrame, length: str = "n_chars") -> DataFrame:
    """All columns, the spans of ``text`` replaced by their kinds; the length of a changed text follows.

    Spans are found and replaced in one function, so a task runs one Python worker and
    holds about a megabyte of texts at a time. A text without spans stays as it is, null
    included, and so does its length; a table without a column of lengths gets none.
    """
    importable(documents.sparkSession)
    names = documents.columns
    text, size = names.index("text"), names.index(length) if length in names else None

    def run(batch):
        _, offsets = utf8(batch.column(text))
        for i, j in row_groups(offsets):
            part = batch.slice(i, j - i)
            texts, changed = part.column(text).to_pylist(), {}
            for k, own in enumerate(texts):
                spans = spans_of(own)
                if spans:
                    rows = [dict(zip(("kind", "start", "stop"), s)) for s in spans]
                    texts[k] = changed[k] = masked(own, rows)
            columns = list(part.columns)
            if changed:
                columns[text] = pa.array(texts, part.schema.field(text).type)
                if size is not None:
                    sizes = part.column(size).to_pylist()
                    sizes = [len(changed[k]) if k in changed else n for k, n in enumerate(sizes)]
                    columns[size] = pa.array(sizes, part.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(documents, documents.schema, run)


def listed(rows) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in rows)


def digest(spans: str = "spans"):
    """Columns n_<kind> and base_sha256 of the base spans, and the list of all spans."""
    line = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    base = F.filter(spans, lambda s: s.base)
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return [*(count(k) for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col(spans)).alias("spans")]
