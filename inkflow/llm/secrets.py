"""Secret scans through nested encodings.

A worklist holds layers of a text: the text itself, then what its percent escapes, Unicode escapes
and base64 or compressed runs decode to (over line breaks too, and out of step, and as UTF-16), until no new layer appears. Every character of a layer
knows the span of the original text that it came from, escape by escape, so findings map back. A layer that was seen
for the same span isn't decoded again, which ends cycles. Where an escape gives the first sign of another one at once,
CHAIN times or more (%25252541), all of them are read in one step: the layers between hold only fewer of the same digits.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html import unescape
from itertools import chain, groupby
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkflow.llm.common import lean, rows_of, table, texts

# The kinds of secrets, in their order, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api")  # one of them begins each assignment
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"""(?:%u[0-9A-Fa-f]{4}|\\u\{?[0-9A-Fa-f]{4,6}\}?|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+""")
ONE_ESCAPE = re.compile(r"[\\%]u\{?([0-9A-Fa-f]{4,6})\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|(&#[0-9xXA-Fa-f]+;)")
#: An escape of a character that begins an escape, and one escape of an ASCII character.
SIGN = re.compile(r"%(?:25|26|5[Cc])|\\(?:u\{?00(?:25|26|5[Cc])\}?|U000000(?:25|26|5[Cc])|x(?:25|26|5[Cc]))|&#(?:0*(?:37|38|92)|[xX]0*(?:25|26|5[Cc]));")
ASCII = re.compile(r"%([0-7][0-9A-Fa-f])|\\u\{?00([0-7][0-9A-Fa-f])\}?|\\U000000([0-7][0-9A-Fa-f])|\\x([0-7][0-9A-Fa-f])|&#[xX]0*([0-7]?[0-9A-Fa-f]);|&#0*([0-9]{1,2}|1[01][0-9]|12[0-7]);")
CHAIN = 4
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line breaks, each line of which may be indented.
_URL_SAFE = str.maketrans("-_", "+/")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+(?!-----)[A-Za-z0-9+/_-]++)+={0,2}")
GAP = re.compile(r"\r?\n[ \t]*")
#: An unpacked layer up to this size is held at once; a larger one is unpacked as a stream and scanned in windows.
UNPACKED = 16 << 20
CHUNK = 1 << 18
#: No secret and no encoding is shorter.
SHORTEST = 14
#: What stands in no text: control characters and bytes that aren't UTF-8.
BAD = re.compile("[\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]+")
#: Where windows may part: no secret, escape or base64 run goes over such a place.
#: Without such a place, a window ends this much later at any character, and the next one begins this much before.
SLACK, OVERLAP = 1 << 20, 1 << 12
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])|[,()!<>*~?\[\]|^$@]")
_BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)

Span = tuple[int, int, int]  # start, place in KINDS, end


def _assigned(text: str) -> Iterator[re.Match]:
    """What ASSIGN.finditer gives: its matches are tried where one of WORDS stands, which is found much faster than by the pattern."""
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is two characters
        yield from ASSIGN.finditer(text)
        return
    starts, end = [], 0
    for word in WORDS:
        at = lower.find(word)
        while at >= 0:
            starts.append(at)
            at = lower.find(word, at + 1)
    for at in sorted(starts):
        if at >= end and (m := ASSIGN.match(text, at)) is not None:
            end = m.end()
            yield m


def find(text: str) -> list[Span]:
    """The secrets of one layer, by start and kind. Matches that are too short are dropped, not extended."""
    found = [(m.start(), 0, m.end()) for m in _assigned(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Part(NamedTuple):
    """[start, stop) of a layer read as text; each of its characters stands for `per` characters in turn, or (0) for all of them."""

    start: int
    stop: int
    text: str
    per: int = 0


class Layer:
    """A decoded text whose characters know the span of the original that they came from.

    runs: (first, start, width, step) in order; up to the next run, character first + i stands for
    [start + i * step, start + i * step + width) of the original. Spans never go back.
    """

    def __init__(self, text: str, runs: list[tuple[int, int, int, int]]):
        self.text, self.runs, self._firsts = text, runs, [r[0] for r in runs]

    def _origin(self, at: int) -> tuple[int, int]:
        first, start, width, step = self.runs[bisect_right(self._firsts, at) - 1]
        start += (at - first) * step
        return start, start + width

    def span(self, start: int, stop: int) -> tuple[int, int]:
        return self._origin(start)[0], self._origin(stop - 1)[1]

    def replaced(self, parts: Iterable[Part]) -> Layer:
        """This layer with the parts, which come in order, read as their texts."""
        out, runs, size, at = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            i = bisect_right(self._firsts, a) - 1
            while a < b:
                first, start, width, step = self.runs[i]
                upto = min(b, self._firsts[i + 1]) if i + 1 < len(self.runs) else b
                runs.append((size, start + (a - first) * step, width, step))
                size, a, i = size + upto - a, upto, i + 1

        for start, stop, text, per in parts:
            keep(at, start)
            i = bisect_right(self._firsts, start) - 1
            if text and per and (i + 1 == len(self.runs) or self._firsts[i + 1] >= stop):
                first, origin, width, step = self.runs[i]
                runs.append((size, origin + (start - first) * step, (per - 1) * step + width, per * step))
            else:
                for k in range(0, len(text), 1 if per else max(1, len(text))):
                    a, b = self.span(start + k * per, start + (k + 1) * per) if per else self.span(start, stop)
                    runs.append((size + k, a, b - a, 0))
            size += len(text)
            out += [self.text[at:start], text]
            at = stop
        keep(at, len(self.text))
        return Layer("".join([*out, self.text[at:]]), runs)


def _opener(head: bytes):
    """A decompressor for what starts with head, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def _chunks(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    for at in range(0, len(data), CHUNK):
        yield bytes(view[at : at + CHUNK])


def _members(source: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """What a compressed layer holds, member after member, in chunks. A broken one ends where it breaks, and raises only before any output."""
    chunks, data, any_ = source(), b"", False
    while True:
        while len(data) < 6 and (more := next(chunks, None)) is not None:
            data += more
        if (opened := _opener(data)) is None:
            return
        while not opened.eof:
            try:
                out = opened.decompress(data, CHUNK)
            except _BROKEN:
                if any_:
                    return
                raise
            data = getattr(opened, "unconsumed_tail", b"")
            if out:
                any_ = True
                yield out
            if not (out or data or opened.eof):
                if (data := next(chunks, None)) is None:
                    return
        data = opened.unused_data
        while not data.lstrip(b"\0") and (more := next(chunks, None)) is not None:
            data = more
        data = data.lstrip(b"\0")


def _unpacked(data: bytes) -> Callable[[], Iterator[bytes]] | None:
    """The chunks that data holds below all its compressed layers; None if it isn't compressed. A layer that comes again ends it."""
    source, seen, opened = partial(_chunks, data), {hashlib.sha1(data).digest()}, False
    while _opener(next(source(), b"")) is not None:
        inner, held, size, digest = partial(_members, source), [], 0, hashlib.sha1()
        try:
            for chunk in inner():
                digest.update(chunk)
                size += len(chunk)
                if size <= UNPACKED:
                    held.append(chunk)
        except _BROKEN:
            break
        if digest.digest() in seen:
            break
        seen.add(digest.digest())
        source, opened = partial(_chunks, b"".join(held)) if size <= UNPACKED else inner, True
    return source if opened else None


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """The texts of a stream of bytes, parted by what is no text, in windows of UNPACKED characters and SLACK.

    A window ends at the first safe place behind UNPACKED characters. Where there is none, it ends anyway, and the next one repeats
    its last OVERLAP characters: all that is found in such a layer stands for the whole layer, so a longer match is still a match, and of
    base64 that goes on, the next window reads the rest.
    """
    decoder, held, size = codecs.getincrementaldecoder("utf-8")("surrogateescape"), [], 0
    for chunk in chain(chunks, (None,)):
        text = decoder.decode(chunk or b"", chunk is None)
        for i, part in enumerate([text] if chunk and len(text) == len(chunk) and _ASCII[np.frombuffer(chunk, dtype=np.uint8)].all() else BAD.split(text)):
            if i:
                if size >= SHORTEST:
                    yield "".join(held)
                held, size = [], 0
            if size > UNPACKED and (cut := SAFE.search(part)):
                yield "".join([*held, part[: cut.start()]])
                held, size, part = [], 0, part[cut.start() :]
            elif size > UNPACKED + SLACK:
                whole = "".join(held)
                yield whole
                held, size = [whole[-OVERLAP:]], OVERLAP
                del whole
            held.append(part)
            size += len(part)
    if size >= SHORTEST:
        yield "".join(held)


# The first bytes of what is compressed.
MAGICS = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
#: Printable ASCII as UTF-16, low bytes first and high bytes first.
WIDE = ((re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){14,}"), "utf-16-le"), (re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){14,}"), "utf-16-be"))
_ASCII = np.array([9 <= b <= 13 or 32 <= b <= 126 for b in range(256)])
_STEP = SHORTEST // 2


def _opened(data: bytes) -> Iterator[int]:
    """Where something compressed may begin; the first byte always."""
    found = {0}
    for magic in MAGICS:
        at = data.find(magic)
        while at >= 0:
            found.add(at)
            at = data.find(magic, at + 1)
    yield from sorted(found)


def _stretches(data: bytes) -> list[tuple[int, int]]:
    """[start, stop) of data's parts of SHORTEST bytes or more that hold UTF-8 text, found without decoding the others.

    A part of that length covers two neighbours of every _STEP-th byte, so these are looked at first.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    high = bool(len(raw)) and int(raw.max()) >= 0xC2  # else no byte begins a longer character
    few = raw[::_STEP]
    likely = _ASCII[few] | (few >= 0x80) if high else _ASCII[few]
    if not (likely[:-1] & likely[1:]).any():
        return []
    found, last = [], -1  # the last byte that is in no text
    for at in range(0, len(raw), CHUNK):
        before = min(at, 3)  # a character may begin in the block before, and end in the next one
        good = _good(raw[at - before : at + CHUNK + 3], high)[before : before + CHUNK]
        bad = np.flatnonzero(~good[: len(raw) - at]) + at
        if len(bad):
            starts = np.concatenate(([last], bad[:-1])) + 1
            long = bad - starts >= SHORTEST
            found += zip(starts[long].tolist(), bad[long].tolist(), strict=True)
            last = int(bad[-1])
    return [*found, (last + 1, len(raw))] if len(raw) - last > SHORTEST else found


def _good(raw: np.ndarray, high: bool) -> np.ndarray:
    """Whether each byte is printable ASCII or part of a longer UTF-8 character."""
    good = _ASCII[raw]
    if high:
        after = [np.concatenate((raw[k:], np.zeros(min(k, len(raw)), dtype=np.uint8))) for k in (1, 2, 3)]
        more = [a & 0xC0 == 0x80 for a in after]
        low = np.select([raw == 0xE0, raw == 0xF0], [np.uint8(0xA0), np.uint8(0x90)], np.uint8(0x80))
        top = np.select([raw == 0xED, raw == 0xF4], [np.uint8(0x9F), np.uint8(0x8F)], np.uint8(0xBF))
        second = more[0] & (after[0] >= low) & (after[0] <= top)
        lengths = ((2, (raw >= 0xC2) & (raw <= 0xDF) & second), (3, (raw >= 0xE0) & (raw <= 0xEF) & second & more[1]), (4, (raw >= 0xF0) & (raw <= 0xF4) & second & more[1] & more[2]))
        for n, leads in lengths:
            for k in range(n):
                good[k:] |= leads[: len(raw) - k]
    return good


def _raw(data: bytes) -> Callable[[], Iterator[bytes]] | None:
    """The chunks that a deflated stream without a header holds; None unless it ends where data does."""

    def inner() -> Iterator[bytes]:
        opened, rest = zlib.decompressobj(-15), data
        while not opened.eof and (out := opened.decompress(rest, CHUNK)):
            rest = opened.unconsumed_tail
            yield out
        if not opened.eof or opened.unused_data:
            raise EOFError

    try:
        return inner if sum(map(len, inner())) >= SHORTEST else None
    except _BROKEN:
        return None


def _from_base64(body: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, text): what base64 without its padding holds, and the characters that hold it.

    The payload may start out of step, after a path for instance, so all four alignments are read,
    unless the first makes one text, or one gives the bytes of the one before (a letter that repeats).
    """
    body, last = body.translate(_URL_SAFE), b""
    for step in range(4):
        n = len(body) - step
        n -= n % 4 == 1
        if n < 2:
            return
        data = base64.b64decode(body[step : step + n] + "=" * (-n % 4))
        size = min(len(data), len(last)) - 2
        if size > 0 and len(last) - len(data) < 4 and data[:size] == last[:size]:
            continue
        last = data
        for at in _opened(data):
            if (source := _unpacked(data[at:] if at else data)) is not None:
                yield from ((step + at * 4 // 3, len(body), text) for text in _texts(source()))
        if not step and (source := _raw(data)) is not None:
            yield from ((0, len(body), text) for text in _texts(source()))
        for pattern, codec in WIDE if b"\0" in data else ():
            for m in pattern.finditer(data):
                yield step + m.start() * 4 // 3, len(body) if m.end() == len(data) else step + -(-m.end() * 4 // 3), m[0].decode(codec)
        found = _stretches(data)
        for at, end in found:
            if len(text := data[at:end].decode("utf-8")) >= SHORTEST:
                yield step + at * 4 // 3, len(body) if end == len(data) else step + -(-end * 4 // 3), text
        if not step and found == [(0, len(data))]:
            return


def _percent(text: str) -> Iterator[Part]:
    """Percent escapes, a part for characters of as many bytes; bytes that aren't UTF-8 become U+FFFD one by one."""
    for m in PERCENT.finditer(text):
        at, found = m.start(), unquote_to_bytes(m[0]).decode("utf-8", "surrogateescape")
        if found.isascii():
            yield Part(at, m.end(), found, 3)
            continue
        for per, group in groupby(found, lambda c: 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode())):
            chars = "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in group)
            yield Part(at, at := at + per * len(chars), chars, per)


def _escapes(text: str) -> Iterator[Part]:
    """Unicode escapes, a part for neighbours of one length; surrogates pair, or become U+FFFD."""
    for run in UNICODE.finditer(text):
        units: list[Part] = []
        for m in ONE_ESCAPE.finditer(text, run.start(), run.end()):
            code = int(m[1] or m[2] or m[3], 16) if not m[4] else None
            char = unescape(m[4]) if code is None else chr(code) if code < 0x110000 else "\ufffd"
            if "\udc00" <= char <= "\udfff" and units and "\ud800" <= units[-1].text <= "\udbff":
                char = (units[-1].text + char).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
                units[-1] = Part(units[-1].start, m.end(), char)
            else:
                units.append(Part(m.start(), m.end(), char))
        for per, group in groupby(units, lambda u: (u.stop - u.start) * (len(u.text) == 1)):
            same = list(group)
            chars = "".join("\ufffd" if "\ud800" <= u.text <= "\udfff" else u.text for u in same)
            if per:
                yield Part(same[0].start, same[-1].stop, chars, per)
            else:
                yield from same


def _chains(text: str) -> Iterator[Part]:
    """Escapes that give the sign of the next escape, CHAIN times or more, and the character that the last one gives."""
    at = 0
    while (m := SIGN.search(text, at)) is not None:
        at, steps, char = m.end(), 1, _ascii(ASCII.match(m[0]))
        # Of the digits after a sign, an escape has fewer than sixteen.
        while char in "%&\\" and (inner := ASCII.match(char + text[at : at + 16])) is not None:
            at, steps, char = at + inner.end() - 1, steps + 1, _ascii(inner)
        if steps >= CHAIN:
            yield Part(m.start(), at, char)


def _ascii(m: re.Match) -> str:
    return chr(int(m[6])) if m[6] else chr(int(next(filter(None, m.groups())), 16))


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers one step below: one for each encoding that the layer holds."""
    text = layer.text
    if ("%" in text or "\\" in text or "&#" in text) and (parts := list(_chains(text))):
        yield layer.replaced(parts)
    else:
        if "%" in text and (parts := list(_percent(text))):
            yield layer.replaced(parts)
        if ("\\" in text or "&#" in text or "%u" in text) and (parts := list(_escapes(text))):
            yield layer.replaced(parts)
    yield from _wrapped(layer)
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        for start, stop, inner in _from_base64(body):
            yield _whole(inner, *layer.span(m.start() + start, m.end() if stop == len(body) else m.start() + stop))


def _whole(text: str, start: int, stop: int) -> Layer:
    return Layer(text, [(0, start, stop - start, 0)])


def _wrapped(layer: Layer) -> Iterator[Layer]:
    """The layers of base64 that goes over line breaks, as far as they do."""
    for m in WRAPPED.finditer(layer.text) if "\n" in layer.text else ():
        run = m[0].rstrip("=")
        firsts, origins, parts, size, at = [], [], [], 0, 0  # of each line: its place in the body, and in the run
        for a, b in chain((g.span() for g in GAP.finditer(run)), ((len(run), len(run)),)):
            firsts.append(size)
            origins.append(at)
            parts.append(run[at:a])
            size, at = size + a - at, b
        if size < 16:
            continue
        for start, stop, inner in _from_base64("".join(parts)):
            i, j = bisect_right(firsts, start) - 1, bisect_right(firsts, stop - 1) - 1
            if i < j:
                end = len(m[0]) if stop == size else origins[j] + stop - firsts[j]
                yield _whole(inner, *layer.span(m.start() + origins[i] + start - firsts[i], m.start() + end))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(the text's own secrets, all secrets), each by start and kind, ends exclusive, in code points."""
    own = find(text)
    everything, work, seen = set(own), [decoded(Layer(text, [(0, 0, 1, 1)]))], {(0, len(text), hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest())}
    while work:  # depth first, so that one window of a large layer is held at a time
        if (inner := next(work[-1], None)) is None:
            work.pop()
            continue
        if not inner.text:
            continue
        key = (*inner.span(0, len(inner.text)), hashlib.sha1(inner.text.encode("utf-8", "surrogatepass")).digest())
        if key in seen:
            continue
        seen.add(key)
        for start, kind, stop in find(inner.text):
            a, b = inner.span(start, stop)
            everything.add((a, kind, b))
        work.append(decoded(inner))
    return own, sorted(everything)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def redact(text: str, spans: list[Span], mark: str = "<secret>") -> str:
    """text with every span, or run of overlapping spans, replaced by mark."""
    out, at, end = [], 0, -1
    for start, _, stop in spans:
        if start >= end:
            out += [text[at:start], mark] if start >= at else []
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs, on its whole text.

    Null and empty texts have no secrets. Rows that repeat, or lack a doc_id, are scanned like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                counts: tuple[list, list, list] = [], [], []
                sums, spans = [], []
                for text in part.column("text").to_pylist():
                    own, every = scan(text.decode("utf-8", "replace"))
                    for kind, column in enumerate(counts):
                        column.append(sum(s[1] == kind for s in own))
                    sums.append(hashlib.sha256(listed(own).encode()).hexdigest())
                    spans.append(listed(every))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret, at any layer, replaced in `text`; a null text stays null, other columns and all rows stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, column=at):
                clean = [None if t is None else redact(t, s) if (s := scan(t)[1]) else t for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(clean, part.column(at).type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
