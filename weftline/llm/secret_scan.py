"""Secret scans through nested encodings: a worklist of layers, each rescanned, to a fixpoint.

The first layer is the text. From each layer come further ones: its lines with URL escapes undone,
its lines with Unicode escapes undone, and what its base64 runs hold, unpacked as long as that is
compressed. Each layer keeps, for each of its characters, the span of the text it came from, so a
secret found deep inside is reported where it stands in the text. A layer that was there before, with the same
places, is not taken again, so cycles end, and layers that come about in several orders are looked at once. The
list ends when no layer gives a new one. Where LEVELS escapes within each other were undone one by one, what is left of
them is undone to its end in one step.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds of secrets, in the order of reports: pattern, group whose length counts, least length.
KINDS = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a longest run of 32 or more
}
ORDER = {k: i for i, k in enumerate(KINDS)}

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: base64 in lines of equal length, as in mail.
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n){1,}[A-Za-z0-9+/]+={0,2}")
CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")
#: A run at the end of its line, and one that starts the next.
LINE_END = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]++)[ \t]*+\r?\n")
NEXT_LINE = re.compile(r"[ \t]*+([A-Za-z0-9+/_-]++)")
#: Bytes without which no pattern of KINDS and no encoding has a match.
SIGNS = re.compile(rb"(?i:passw(?:or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_=-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]")
#: Runs of ASCII characters of two or four bytes, either end first. The zeros around the first and the last may be missing.
WIDE = [(n, re.compile(rb"[\t-\r\x20-\x7e]?(?:\0{%d}[\t-\r\x20-\x7e]){7,}" % (n - 1))) for n in (2, 4)]
#: Bytes of unpacked data after which layers() pauses, and most bytes held at once of data that has no place to cut it.
UNPACK_LIMIT = 32 << 20
#: Unpacked data is looked at in blocks of this size, cut where no pattern of KINDS and no encoding can go across: after a
#: character that none of them has, or after several zeros.
BLOCK = 4 << 20
SAFE = re.compile(rb"[(),!?<>\[\]*$|~@^]|[\x80-\xff](?=[\x00-\x7f])|\0{8}")
NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/_-]")
#: Bytes that two blocks share where there is no such place.
OVERLAP = 1 << 16
#: Levels of escapes that are undone, and scanned, one by one; and the end of an escape, for those below them.
LEVELS = 32
ESCAPE_END = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});)\Z")
LONGEST_ESCAPE = 11
#: Bytes of UTF-8 and units of UTF-16 that stand for a character together.
TOGETHER = re.compile("[\ud800-\udbff][\udc00-\udfff]|[\udc80-\udcff]+")
#: Layers that a document remembers, twice.
REMEMBERED = 200_000
#: Compressed layers directly in each other that are followed.
DEPTH = 100


@dataclass
class Layer:
    """text with the span of the document that each character comes from, whether it was decoded, and the
    layers it came from."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    decoded: np.ndarray
    before: tuple[bytes, ...] = ()
    level: int = 0

    def state(self) -> bytes:
        """Equal for layers of the same text, places and decoded characters."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for x in (self.starts, self.ends, self.decoded):
            h.update(x[:1].tobytes() if not x.strides[0] else x.tobytes())
        return h.digest() + bytes([self.level > LEVELS])

    def digest(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@dataclass
class Budget:
    """left: bytes until layers() pauses; spent: it paused; rest: what it goes on with; cut: a run was cut where
    something may go across; seen: packed runs by place and digest; failed: the last run unpacked was no packed data;
    hold: most bytes held at once without a place to cut them."""

    left: int = UNPACK_LIMIT
    spent: bool = field(default=False)
    rest: list = field(default_factory=list)
    cut: bool = field(default=False)
    seen: set = field(default_factory=set)
    failed: bool = field(default=False)

    def __post_init__(self):
        self.hold = self.left


def scan(text: str) -> list[tuple[int, str, int]]:
    """start, kind, end of a text's own secrets: leftmost matches that don't overlap, for each kind."""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    return found


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], ORDER[x[1]], x[2])))


class Stepwise:
    """zlib's and zstd's decompressors, used as those of bz2 and lzma."""

    def __init__(self, inner, zstd: bool = False):
        self.inner, self.zstd, self.rest, self.needs_input = inner, zstd, b"", True

    @property
    def eof(self) -> bool:
        return self.inner.eof

    @property
    def unused_data(self) -> bytes:
        return self.inner.unused_data + (self.rest if self.zstd else b"")

    def decompress(self, data: bytes, limit: int) -> bytes:
        data = self.rest + data
        if self.zstd:  # has no limit, so it gets little at a time
            self.rest = data[256:]
            made = self.inner.decompress(data[:256])
            self.needs_input = not self.rest
        else:
            made = self.inner.decompress(data, limit)
            self.rest = self.inner.unconsumed_tail
            self.needs_input = not self.rest and len(made) < limit
        return made


def decompressor(data: bytes):
    """One for data that starts so, or None."""
    if data[:2] == b"\x1f\x8b":
        return Stepwise(zlib.decompressobj(31))
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return Stepwise(zlib.decompressobj())
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00" or data[:3] == b"\x5d\x00\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd" or data[1:4] == b"\x2a\x4d\x18" and data[0] >> 4 == 5:  # or a frame to skip
        import zstandard

        return Stepwise(zstandard.ZstdDecompressor().decompressobj(), zstd=True)
    return None


def inflate(made_by, data: bytes, source: Iterator[bytes], budget: Budget) -> Iterator[bytes]:
    """What one compressed layer holds, piece by piece, as far as it is sound: all its members (streams, frames), and what
    stands after them. data is its start, source gives the rest."""
    first, held = True, deque(data[i : i + OVERLAP] for i in range(0, len(data), OVERLAP))
    while made_by is not None:
        some = False
        while not made_by.eof:
            piece = b""
            if made_by.needs_input and not (piece := held.popleft() if held else next(source, b"")):
                return
            try:
                made = made_by.decompress(piece, 1 << 20)
            except Exception as e:  # zstandard has its own kind, and may not be there
                if not isinstance(e, (zlib.error, OSError, lzma.LZMAError, EOFError)) and type(e).__name__ != "ZstdError":
                    raise
                budget.failed = True
                if not first and not some:  # it only looked like a member
                    yield from (data, *held)
                    yield from source
                return
            if made:
                some = True
                yield made
        data, first = made_by.unused_data.lstrip(b"\0"), False  # zeros may stand between members
        while len(data) < 6 and (more := held.popleft() if held else next(source, b"")):
            data = (data + more).lstrip(b"\0")
        held.appendleft(data)
        made_by = decompressor(data)
    yield from held
    yield from source


def unpacked(source: Iterator[bytes], budget: Budget, before: tuple[bytes, ...] = ()) -> Iterator[bytes]:
    """The innermost data of compressed layers, piece by piece."""
    data, ended = bytearray(), False
    while len(data) < 1 << 20 and not ended:
        more = next(source, b"")
        data += more
        ended = not more
    data = bytes(data)
    own = hashlib.blake2b(data, digest_size=16).digest()
    made_by = None if ended and own in before else decompressor(data)
    if made_by is None:
        yield data
        yield from source
    elif len(before) == DEPTH:
        budget.cut = True
    else:
        some = False
        for piece in unpacked(inflate(made_by, data, source, budget), budget, (*before, own)):
            some = some or bool(piece)
            yield piece
        if before and not some:  # it only looked like a compressed layer
            yield data
            yield from source


def last_of(pattern: re.Pattern, data: bytearray, end: int) -> int:
    """Where the last match in data before end ends, or 0."""
    for stop in range(end, 0, -OVERLAP):
        if spots := [m.end() for m in pattern.finditer(data, max(stop - OVERLAP, 0), stop)]:
            return spots[-1]
    return 0


def blocks(pieces: Iterator[bytes], budget: Budget) -> Iterator[bytes]:
    """pieces put together, and cut at SAFE."""
    held, wanted = bytearray(), min(BLOCK, budget.hold)
    for piece in pieces:
        held += piece
        while len(held) >= wanted:
            if at := last_of(SAFE, held, len(held)):
                yield bytes(held[:at])
                del held[:at]
                wanted = min(BLOCK, budget.hold)
            elif len(held) < budget.hold:
                wanted = min(2 * len(held), budget.hold)  # looks again when there is twice as much
            else:
                budget.cut = True
                yield bytes(held[: budget.hold])
                at = max(budget.hold - OVERLAP, budget.hold // 2)
                at -= (at - last_of(NOT_BASE64, held, at)) % 4  # what base64 goes across stays in step
                del held[:at]
                wanted = budget.hold
    if held:
        yield bytes(held)


def readable(data: bytes, packed: bool = False) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """data as texts, each with the bytes (first, and the one after the last) of its characters: as UTF-8, where bytes that are
    none are single characters; and its runs of UTF-16 and UTF-32. Data that is no plain text counts only where SIGNS finds
    something. packed: the bytes' places are not wanted, all are 0."""
    plain = True
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text, plain = data.decode("utf-8", "surrogateescape"), False
    if text and (plain and not CONTROL.search(text) or SIGNS.search(data)):
        if packed:
            yield text, np.broadcast_to(0, len(text)), np.broadcast_to(0, len(text))
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            sizes[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
            ends = np.cumsum(sizes)
            yield text, ends - sizes, ends
    if b"\0" in data:
        for size, pattern in WIDE:
            for m in pattern.finditer(data):
                run = m[0].replace(b"\0", b"")
                if SIGNS.search(run):
                    # the last character of a run may stand without its zeros, which may belong to the next character
                    first = m.start() + size * np.arange(len(run))
                    yield run.decode("ascii"), first * (not packed), (np.minimum(first + size, m.end())) * (not packed)


def replaced(layer: Layer, start: int, end: int, parts: list[tuple[int, int, str]]) -> Layer:
    """The layer's characters start to end, with each part's (from, to) by its text."""
    texts, starts, ends, decoded, at = [], [], [], [], start
    for i, j, new in [*parts, (end, end, "")]:
        texts += [layer.text[at:i], new]
        starts += [layer.starts[at:i], np.full(len(new), layer.starts[i] if i < len(layer.starts) else 0)]
        ends += [layer.ends[at:i], np.full(len(new), layer.ends[j - 1] if j else 0)]
        decoded += [layer.decoded[at:i], np.ones(len(new), bool)]
        at = j
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends), np.concatenate(decoded))


def lines_around(text: str, spots: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Lines that have spots: start, end, the spots' numbers. No pattern of KINDS crosses a line feed."""
    i = 0
    while i < len(spots):
        start = text.rfind("\n", 0, spots[i][0]) + 1
        end = text.find("\n", spots[i][1])
        end = len(text) if end < 0 else end
        j = i
        while j < len(spots) and spots[j][0] < end:
            j += 1
        yield start, end, list(range(i, j))
        i = j


def unescaped(m: re.Match) -> str | None:
    brace, units, wide, byte, hexa, number = m.groups()
    try:
        if units:
            return bytes.fromhex(units.replace("\\u", "")).decode("utf-16-be", "replace")
        return chr(int(brace or wide or byte or hexa, 16) if number is None else int(number))
    except (ValueError, OverflowError):
        return None


def settled(layer: Layer, start: int, end: int) -> Layer:
    """The layer's characters start to end with all escapes undone, those that come about as well: characters are
    put on a stack one by one, and as soon as its top is an escape, what that stands for takes its place."""
    text, starts, ends, decoded = [], [], [], []
    for i in range(start, end):
        text.append(layer.text[i])
        starts.append(layer.starts[i])
        ends.append(layer.ends[i])
        decoded.append(layer.decoded[i])
        while text[-1] in "0123456789abcdefABCDEF;}" and (m := ESCAPE_END.search("".join(text[-LONGEST_ESCAPE:]))):
            byte, *points, number = m.groups()
            value = int(byte or next(filter(None, points), ""), 16) if number is None else int(number)
            if value > 0x10FFFF:
                break
            n = len(m[0])
            text[-n:], starts[-n:], ends[-n:], decoded[-n:] = [chr(value + 0xDC00 if byte and value > 127 else value)], [starts[-n]], [ends[-1]], [True]
    inner = Layer("".join(text), np.array(starts), np.array(ends), np.array(decoded, bool))
    parts = []
    for m in TOGETHER.finditer(inner.text):
        at = m.start()
        if "\ud800" <= m[0][0] <= "\udbff":
            parts.append((at, at + 2, m[0].encode("utf-16-le", "surrogatepass").decode("utf-16-le")))
            continue
        for c in m[0].encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape"):
            n = len(c.encode("utf-8", "surrogateescape"))
            parts.append((at, at + n, c))
            at += n
    return replaced(inner, 0, len(inner.text), parts)


def unescapes(layer: Layer) -> Iterator[Layer]:
    """A layer's lines with escapes undone."""
    text = layer.text
    if layer.level > LEVELS:
        return
    if layer.level == LEVELS:
        spots = [m.span() for m in chain(URL.finditer(text), UNICODE.finditer(text))]
        for start, end, _ in lines_around(text, sorted(spots)):
            yield settled(layer, start, end)
        return
    if "%" in text:
        spots = []
        for m in URL.finditer(text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            at = m.start()
            for c in raw.decode("utf-8", "surrogateescape"):  # each character, or byte of none, with its own escapes
                n = len(c.encode("utf-8", "surrogateescape"))
                spots.append((at, at + 3 * n, c))
                at += 3 * n
        for start, end, own in lines_around(text, [s[:2] for s in spots]):
            yield replaced(layer, start, end, [spots[i] for i in own])
    if "\\" in text or "&#" in text:
        spots = [(m.start(), m.end(), c) for m in UNICODE.finditer(text) if (c := unescaped(m)) is not None]
        for start, end, own in lines_around(text, [s[:2] for s in spots]):
            yield replaced(layer, start, end, [spots[i] for i in own])


def unwrap(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The layers that a layer holds."""
    text = layer.text
    for inner in unescapes(layer):
        inner.level = layer.level + 1
        yield inner
    for places in base64_runs(text):
        run = "".join(text[i:j] for i, j in places).replace("-", "+").replace("_", "/")
        run = run[: len(run) - (len(run) % 4 == 1)]
        try:
            data = base64.b64decode(run + "=" * (-len(run) % 4))
        except ValueError:
            continue
        first, last = places[0][0], places[-1][0] + len(run) - 1 - sum(j - i for i, j in places[:-1])
        if decompressor(data) is not None:
            key = (int(layer.starts[first]), int(layer.ends[last]), hashlib.blake2b(data, digest_size=16).digest())
            if key in budget.seen:
                continue
            budget.seen.add(key)
            budget.failed, some = False, False
            inside = unpacked_layers(data, key[:2], budget)
            if budget.left <= 0:
                budget.rest.append((inside, (*layer.before, layer.digest())))
                inside = ()
            for inner in inside:
                some = True
                budget.left -= len(inner.text)
                yield inner
                if budget.left <= 0:
                    budget.spent = True
                    budget.rest.append((inside, (*layer.before, layer.digest())))
                    break
            if some and not budget.failed:
                continue
        same = not layer.starts.strides[0]  # all characters have one place
        where = None if same else np.concatenate([np.arange(i, j) for i, j in places])
        for inner, begins, ends in readable(data, same):
            if same:
                starts, stops = (np.broadcast_to(x[0], len(inner)) for x in (layer.starts, layer.ends))
            else:
                starts, stops = layer.starts[where[begins * 8 // 6]], layer.ends[where[(ends * 8 - 1) // 6]]
            yield Layer(inner, starts, stops, np.broadcast_to(True, len(inner)))


def unpacked_layers(data: bytes, place: tuple[int, int], budget: Budget) -> Iterator[Layer]:
    """The layers that packed data at a place of the document holds, each text once."""
    seen = set()
    for block in blocks(unpacked(iter([data]), budget), budget):
        own = hashlib.blake2b(block, digest_size=16).digest()
        if own in seen:
            continue
        seen.add(own)
        for inner, _, _ in readable(block, packed=True):
            n = len(inner)
            yield Layer(inner, np.broadcast_to(place[0], n), np.broadcast_to(place[1], n), np.broadcast_to(True, n))


def base64_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs that may be base64, as the places of their characters: each longest run; its parts between - and _
    or / where these may be no part of it; and runs over several lines."""
    for m in BASE64.finditer(text):
        run, at = m[0], m.start()
        yield [(at, m.end())]
        for marks in (r"[^-_]{16,}", r"[^/]{16,}", r"[^-_/+]{16,}"):
            for p in re.finditer(marks, run):
                if len(p[0]) < len(run):
                    yield [(at + p.start(), at + p.end())]
    if "\n" in text:
        seen = set()
        for places in wrapped_runs(text):
            if places[-1][1] - places[0][0] >= 16 and sum(j - i for i, j in places) >= 16 and tuple(places) not in seen:
                seen.add(tuple(places))
                yield places


def wrapped_runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs over several lines: those of WRAPPED, and lines of one width each, indented or not, the last one shorter or not.
    Where the first line has something else before its run, this may be shorter; where the last may be no part, without it too."""
    for m in WRAPPED.finditer(text):
        yield [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[A-Za-z0-9+/]+", m[0])]
    places, lead, expected = [], [], -1
    for m in LINE_END.finditer(text):
        i, j = m.span(1)
        if i != expected or not places or j - i != places[0][1] - places[0][0]:
            lead = places if i == expected and len(places) == 1 and places[0][1] - places[0][0] < j - i else []
            if lead and (line := text.rfind("\n", 0, lead[0][0])) >= 0 and not text[line:lead[0][0]].strip():
                lead = []
            places = []
        places.append((i, j))
        width, n = j - i, NEXT_LINE.match(text, m.end())
        expected = n.start(1) if n else -1
        size = n.end(1) - expected if n else 0
        if size == width and LINE_END.match(text, expected):
            continue
        ends = [[n.span(1)]] if 0 < size <= width else []
        if not ends or text[n.end(1) : n.end(1) + 1] != "=":
            ends.append([])
        for end in ends:
            for start in ([], lead) if lead else ([],):
                if len(start) + len(places) + len(end) > 1:
                    yield [*start, *places, *end]


def layers(text: str, budget: Budget) -> Iterator[Layer]:
    """All layers below a text, each once for each place, until unpacked data has more than the budget. resumed() goes on."""
    n = len(text)
    return below([Layer(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))], budget)


def below(work: list[Layer], budget: Budget) -> Iterator[Layer]:
    """The layers below those of work. If there are more than it remembers, some may come again; cycles end all the same."""
    seen, older = set(), set()
    while work:
        layer = work.pop()
        before = (*layer.before, layer.digest())
        for inner in unwrap(layer, budget):
            state = inner.state()
            if state in seen or state in older or inner.digest() in before:
                continue
            if len(seen) >= REMEMBERED:
                seen, older = set(), seen
            seen.add(state)
            inner.before = before
            yield inner
            work.append(inner)


def resumed(budget: Budget) -> Iterator[Layer]:
    """The layers that layers() left."""
    while budget.rest:
        inside, before = budget.rest.pop()
        budget.left = UNPACK_LIMIT
        for inner in inside:
            if inner.digest() not in before:
                inner.before = before
                yield inner
                yield from below([inner], budget)
                budget.left = UNPACK_LIMIT


def secrets(text: str) -> tuple[list, list, int, bool]:
    """A text's own spans, all spans, number of layers, whether a run was cut where something may go across."""
    base, budget, n = scan(text), Budget(), 0
    everything = set(base)
    for layer in chain(layers(text, budget), resumed(budget)):
        n += 1
        for start, kind, end in scan(layer.text):
            if layer.decoded[start:end].any():  # else it stands as it is in the layer before
                everything.add((int(layer.starts[start]), kind, int(layer.ends[end - 1])))
    return base, list(everything), n, budget.cut


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of docs: doc_id, n_assign, n_access, n_hex and base_sha256 of the text's own secrets,
    spans (kind:start:end in code points, end exclusive, by start, comma-joined) of these and of those
    within its layers, n_layers, and truncated (true if unpacked data has a run of
    more than UNPACK_LIMIT bytes without a place to cut it, or more than DEPTH compressed layers in each other).

    Null is the empty text, which has none. Repeated rows get a row each; an empty table gives none.
    One pass, no shuffle.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "truncated"]
    kinds = [docs.schema[doc_id].dataType, T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for t in b.column(1):
                base, everything, n, spent = secrets(t.as_py() or "")
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(everything), n, spent))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:], strict=True))], schema=arrow)

    return docs.select(doc_id, text).mapInArrow(find, schema)
