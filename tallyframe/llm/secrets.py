"""Secret scans: base patterns over the text and over every layer that can be decoded from it."""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: Kinds in the order of ties, each with its pattern, the group that is measured and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
WORDS = ("password", "passwd", "secret", "token", "api")
ORDER = {k: i for i, (k, *_) in enumerate(KINDS)}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Between two lines of one run; in quoted strings a line break can be written as \\n.
BREAK = r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t>]*+"
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK}[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:{BREAK}[A-Za-z0-9+/_-]++)++)={{0,2}}")
BREAK = re.compile(BREAK)
#: How gzip and zlib data begin in base64.
PACKED = re.compile(r"(?=H4sI|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r]))")
#: Patterns and escapes are ASCII, and what they can match is no shorter than this, in any layer.
ASCII = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
#: What compressed data holds is unpacked in parts of so many bytes at most, and scanned in windows that overlap.
PART, WINDOW, OVERLAP = 1 << 20, 16 << 20, 4 << 20

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Matches of the base patterns."""
    found: list[Span] = []
    low = text.lower()
    long = [w for w in text.split() if len(w) >= 16]
    wanted = (any(w in low for w in WORDS), any("AKIA" in w for w in long), any(LONG_HEX.search(w) for w in long))
    for (kind, pattern, group, least), needed in zip(KINDS, wanted, strict=True):
        if needed:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


class Layer:
    """A text decoded from its parent, with the ranges there that its characters come from, by runs; or from one range of the document, at, as a whole.

    A run is (first character, base, phase, num, den): character k comes from base + (k - first +
    phase) * num / den on, in steps of num / den, rounded outwards and up to the limit. Runs ascend, so a range comes from
    what its first and last character come from.
    """

    def __init__(self, text: str, parent: Layer | None = None, runs: list[tuple[int, int, int, int, int]] | None = None, at: tuple[int, int] | None = None, limit: int = 1 << 60):
        self.text, self.parent, self.runs, self.at, self.limit = text, parent, runs, at, limit

    def whole(self) -> bool:
        return self.parent is None and self.at is None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The range of the document that characters a to b come from."""
        layer = self
        while layer.at is None and layer.parent is not None:
            first, base, phase, num, den = layer.runs[bisect_right(layer.runs, a, key=itemgetter(0)) - 1]
            start = base + (a - first + phase) * num // den
            first, base, phase, num, den = layer.runs[bisect_right(layer.runs, b - 1, key=itemgetter(0)) - 1]
            a, b = start, min(base - -(b - first + phase) * num // den, layer.limit)
            layer = layer.parent
        return layer.at or (a, b)

    def key(self) -> tuple[bytes, int, int]:
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *self.origin(0, len(self.text)))


def rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by its decoded characters, each with its range in the match; None if nothing changes."""
    parts: list[str] = []
    runs: list[tuple[int, int, int, int, int]] = []
    at = size = 0

    def add(text: str, base: int, num: int) -> None:
        nonlocal size
        if not text:
            return
        parts.append(text)
        if layer.at is None:
            if not (runs and runs[-1][3] == num and runs[-1][1] + (size - runs[-1][0]) * num == base):
                runs.append((size, base, 0, num, 1))
            size += len(text)

    for m in pattern.finditer(layer.text):
        found = decode(m)
        if found is None:
            continue
        add(layer.text[at : m.start()], at, 1)
        at = m.start()
        for text, num in found:
            add(text, at, num)
            at += len(text) * num
    if not at:
        return None
    add(layer.text[at:], at, 1)
    text = "".join(parts)
    return Layer(text, layer, runs) if layer.at is None else Layer(text, at=layer.at)


def percent(m: re.Match) -> list[tuple[str, int]]:
    """Stretches of characters with the width of each in the match: of UTF-8 data, or of other data a character a byte."""
    data = bytes.fromhex(m[0].replace("%", ""))
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return [(data.decode("latin-1"), 3)]
    if len(text) == len(data):
        return [(text, 3)]
    return [("".join(x), 3 * n) for n, x in groupby(text, lambda c: 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4)]


def escape(m: re.Match) -> list[tuple[str, int]] | None:
    if m[1]:
        return [(chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00), len(m[0]))]
    code = int(m[8]) if m[8] else int(next(g for g in m.groups() if g), 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), len(m[0]))]


def packs(data: bytes | memoryview) -> bool:
    """Whether the data begins as gzip or zlib data does."""
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0


def chunks(data: bytes | memoryview) -> Iterator[bytes]:
    """The data, in a small piece, which most of what isn't compressed fails in, and larger ones."""
    at, size = 0, 1 << 10
    while at < len(data):
        yield bytes(data[at : at + size])
        at, size = at + size, 1 << 16


def inflated(source: Iterable[bytes], used: list[int] | None = None) -> Iterator[bytes]:
    """What gzip or zlib data holds, all members of it, up to its end or to where it breaks off or is broken; used[0]: so many bytes were read."""
    d, rest, read = None, b"", 0
    used = [0] if used is None else used
    for chunk in source:
        rest += chunk
        while rest:
            if d is None:
                if read:  # members can be filled up with zeros
                    read, rest = read + len(rest) - len(rest.lstrip(b"\0")), rest.lstrip(b"\0")
                if len(rest) < 3:
                    break
                if not packs(rest):
                    return
                d = zlib.decompressobj(47)
            spare = d.copy()
            try:
                out = d.decompress(rest, PART)
            except zlib.error:  # the bytes before the broken one, one by one, as the call gives nothing of them
                out = bytearray()
                for i in range(len(rest)):
                    try:
                        out += spare.decompress(rest[i : i + 1])
                    except zlib.error:
                        break
                    if out:
                        used[0] = read + i + 1
                if out:
                    yield bytes(out)
                return
            left = d.unused_data if d.eof else d.unconsumed_tail
            read, rest = read + len(rest) - len(left), left
            used[0] = read
            if out:
                yield out
            while not rest and not d.eof and (out := d.decompress(b"", PART)):
                yield out
            if d.eof:
                d = None


def unpack(data: bytes | memoryview) -> bytes | None:
    """The first part of what gzip or zlib data holds."""
    return next(inflated(chunks(data)), None) if packs(data) else None


def windows(parts: Iterable[bytes]) -> Iterator[bytes]:
    held, old = bytearray(), 0
    for part in parts:
        held += part
        if len(held) >= WINDOW:
            yield bytes(held)
            del held[:-OVERLAP]
            old = len(held)
    if len(held) > old:
        yield bytes(held)


def encoded(layer: Layer) -> Iterator[Layer]:
    """A layer for each stretch of ASCII in a base64 run, read from each of its first four characters, and for compressed data that begins anywhere in it.

    A run goes on over line breaks. Other bytes than ASCII are left out: no pattern holds them.
    """
    for m in BASE64.finditer(layer.text):
        joined = Layer(BREAK.sub("", m[0]), layer, lines(layer.text, m))
        run = joined.text.rstrip("=")
        if len(run) < 16:
            continue
        plain = run.translate({45: 43, 95: 47})
        data = []
        for i in range(4):
            part = plain[i : len(plain) - ((len(plain) - i) % 4 == 1)]
            data.append(binascii.a2b_base64(part + "=" * (-len(part) % 4)))
        for i in sorted({0, *(x.start() for x in PACKED.finditer(plain))}):
            blob = memoryview(data[i % 4])[i // 4 * 3 :]
            if (packed := unpack(blob)) is None:
                if i == 0 and deflated(blob):
                    for x in windows(raw(blob)):
                        yield Layer(x.decode("latin-1"), at=joined.origin(0, len(joined.text)))
                continue
            met, depth = {bytes(blob)}, 1
            while packed not in met and (inner := unpack(packed)) is not None:
                met.add(packed)
                packed, depth = inner, depth + 1
            used = [0]
            for _ in inflated(chunks(blob), used):
                pass
            end = min(i - (-used[0] * 4 // 3), len(run))
            at = joined.origin(i, end if end < len(run) else len(joined.text)) if used[0] else None
            for n in range(1, depth + 1):  # a text can look compressed by its first bytes
                parts = chunks(blob)
                for _ in range(n):
                    parts = inflated(parts)
                for x in windows(parts):
                    yield Layer(x.decode("latin-1"), at=at)
        for i, part in enumerate(data):
            for x in ASCII.finditer(part):
                yield Layer(x[0].decode(), joined, [(0, i, x.start(), 4, 3)], limit=len(run))


def lines(text: str, m: re.Match) -> list[tuple[int, int, int, int, int]]:
    """The runs of a match without the line breaks in it."""
    out, at, size = [], m.start(), 0
    for x in BREAK.finditer(text, m.start(), m.end()):
        out.append((size, at, 0, 1, 1))
        size, at = size + x.start() - at, x.end()
    return [*out, (size, at, 0, 1, 1)]


def raw(data: bytes | memoryview) -> Iterator[bytes]:
    """What deflated data without a header holds; an EOFError where it's broken or breaks off."""
    d = zlib.decompressobj(-15)
    for chunk in chunks(data):
        while chunk and not d.eof:
            try:
                yield d.decompress(chunk, PART)
            except zlib.error:
                raise EOFError from None
            chunk = d.unconsumed_tail
    while not d.eof and (out := d.decompress(b"", PART)):
        yield out
    if not d.eof:
        raise EOFError


def deflated(data: bytes | memoryview) -> bool:
    """Whether data is deflated as a whole, to something longer than a pattern's least match."""
    size = 0
    try:
        for x in raw(data):
            size += len(x)
    except EOFError:
        return False
    return size >= 16


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, kind and end, in code points of the text.

    The worklist gives layers that are still to be scanned and unwrapped: URL escapes, Unicode
    escapes and character references, base64, and gzip or zlib data in base64. It ends when no
    layer gives a new one; a layer that was met before, with the same place, is not opened again.
    """
    place = lambda s: (s[1], ORDER[s[0]], s[2])
    base = sorted(scan(text), key=place)
    spans, work, seen = set(base), [iter([Layer(text)])], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if not layer.whole():
            if not layer.text or (key := layer.key()) in seen:
                continue
            seen.add(key)
            spans |= {(kind, *layer.origin(a, b)) for kind, a, b in scan(layer.text)}
        work.append(encoded(layer))
        if "%" in layer.text and (x := rewritten(layer, PERCENT, percent)):
            work.append(iter([x]))
        if ("\\" in layer.text or "&#" in layer.text) and (x := rewritten(layer, ESCAPE, escape)):
            work.append(iter([x]))
    return base, sorted(spans, key=place)


SPANS = "array<struct<kind: string, start: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of each row.

    A null text is an empty one, without spans; a null doc_id is kept; repeated rows are
    scanned each. Nothing is shuffled: a row needs no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [find(t or "") for t in b.column(1).to_pylist()]
            base, spans = ([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, SPAN_TYPE), pa.array(spans, SPAN_TYPE)], ["doc_id", "base", "spans"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(texts, run, f"doc_id long, base {SPANS}, spans {SPANS}")


def masked(text: str, mask: str) -> str:
    """The text with each span, or run of overlapping ones, replaced by the mask."""
    parts, at = [], 0
    for _, a, b in find(text)[1]:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def mask_secrets(df: DataFrame, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The rows of df with every span of text_col masked; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            i = b.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, mask) for t in b.column(i).to_pylist()]
            yield b.set_column(i, text_col, pa.array(texts, pa.string()))

    return map_arrow(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
