"""A small PDF reader and writer: counts pages, and saves files anew without metadata.

It reads objects where they stand (and in object streams), not by the cross-reference table, so it reads
damaged tables, too. Encrypted files are errors. Saving packs objects into object streams; page content is
copied as it is, only uncompressed streams are deflated.
"""

from __future__ import annotations

import re
import zlib
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PDF, MAX_OBJECTS = 50_000_000, 500_000
DEEPEST = 100

WS = b"\0\t\n\f\r "
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\0\t\n\f\r ]*>|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+)", re.S)
OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj\b")
OBJ_STREAM_COUNT = re.compile(rb"/ObjStm\b")


class PdfError(ValueError):
    pass


class Name(bytes):
    """A name without its slash."""


class Ref(tuple):
    """number, generation."""


class Raw(bytes):
    """A number, keyword or string as it is written."""


class Stream:
    def __init__(self, head: dict, data: bytes):
        self.head, self.data = head, data


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes:
        m = TOKEN.match(self.data, self.at)
        if not m:
            raise PdfError("PDF: unexpected end")
        self.at = m.end()
        return m[1]

    def string(self) -> bytes:
        """A string in parentheses, which may nest; self.at is behind the first."""
        start, depth = self.at - 1, 1
        while depth:
            c = self.data[self.at : self.at + 1]
            if not c:
                raise PdfError("PDF: string is not closed")
            self.at += 2 if c == b"\\" else 1
            depth += (c == b"(") - (c == b")")
        return self.data[start : self.at]

    def value(self, depth: int = 0) -> Any:
        if depth > DEEPEST:
            raise PdfError("PDF: nested too deeply")
        t = self.token()
        if t == b"<<":
            out: dict = {}
            while (k := self.token()) != b">>":
                if k[:1] != b"/":
                    raise PdfError("PDF: key is no name")
                out[Name(k[1:])] = self.value(depth + 1)
            return out
        if t == b"[":
            items = []
            while True:
                mark = self.at
                if self.token() == b"]":
                    return items
                self.at = mark
                items.append(self.value(depth + 1))
        if t == b"(":
            return Raw(self.string())
        if t[:1] == b"/":
            return Name(t[1:])
        if t.isdigit():
            m = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])").match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref((int(t), int(m[1])))
        return Raw(t)


def written(v: Any) -> bytes:
    if isinstance(v, dict):
        return b"<<" + b"".join(b"/" + k + b" " + written(x) for k, x in v.items()) + b">>"
    if isinstance(v, list):
        return b"[" + b" ".join(map(written, v)) + b"]"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    return b"/" + v if isinstance(v, Name) else bytes(v)


def declared_objects(data: bytes) -> int:
    """An upper estimate without parsing: objects, and what object streams say they hold."""
    n = len(OBJECT.findall(data))
    for m in OBJ_STREAM_COUNT.finditer(data):
        near = re.search(rb"/N[\0\t\n\f\r ]+(\d+)", data[max(0, m.start() - 200) : m.end() + 200])
        n += int(near[1]) if near else 0
    return n


def filtered(s: Stream) -> bytes:
    """A stream's data; only plain and deflated ones (with PNG predictors) are read."""
    kinds = s.head.get(b"Filter", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    data = s.data
    for k in kinds:
        if k != b"FlateDecode":
            raise PdfError(f"PDF: unsupported filter {k.decode('latin-1')}")
        d = zlib.decompressobj()
        try:
            data = d.decompress(data, MAX_PDF)
        except zlib.error as e:
            raise PdfError("PDF: corrupt stream") from e
    return data


class Pdf:
    def __init__(self, data: bytes):
        if len(data) > MAX_PDF:
            raise PdfError(f"PDF is larger than {MAX_PDF} bytes")
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF")
        if declared_objects(data) > MAX_OBJECTS:
            raise PdfError(f"PDF declares more than {MAX_OBJECTS} objects")
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        at = 0
        marks = re.compile(OBJECT.pattern + rb"|\btrailer\b")
        while m := marks.search(data, at):
            r = Reader(data, m.end())
            try:
                v = r.value()
            except PdfError:
                at = m.end()
                continue
            at = r.at
            if m[1] is None:
                self.trailer |= v if isinstance(v, dict) else {}
                continue
            s = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)").match(data, r.at)
            if s and isinstance(v, dict):
                v, at = self.stream(v, data, s.end())
            self.objects[int(m[1])] = v
        for s in [o for o in self.objects.values() if isinstance(o, Stream)]:
            if s.head.get(b"Type") == b"ObjStm":
                self.inside(s)
            elif s.head.get(b"Type") == b"XRef":
                self.trailer |= {k: x for k, x in s.head.items() if k in (b"Root", b"Info", b"ID", b"Encrypt")}
        if b"Encrypt" in self.trailer:
            raise PdfError("PDF is encrypted")
        if len(self.objects) > MAX_OBJECTS:
            raise PdfError(f"PDF holds more than {MAX_OBJECTS} objects")

    def stream(self, head: dict, data: bytes, start: int) -> tuple[Stream, int]:
        size = head.get(b"Length")
        if isinstance(size, Raw) and size.isdigit() and re.compile(rb"[\0\t\n\f\r ]*endstream").match(data, start + int(size)):
            end = start + int(size)
        else:
            end = data.find(b"endstream", start)
            if end < 0:
                raise PdfError("PDF: stream is not closed")
            while end > start and data[end - 1] in b"\r\n" and data[end - 2 : end] != b"":
                end -= 1
                if data[end : end + 1] == b"\r" or data[end - 1 : end] != b"\r":
                    break
        return Stream(head, data[start:end]), end

    def inside(self, s: Stream) -> None:
        data = filtered(s)
        n, first = int(s.head.get(b"N", b"0")), int(s.head.get(b"First", b"0"))
        places = data[:first].split()
        for number, offset in list(zip(places[::2], places[1::2], strict=False))[:n]:
            self.objects.setdefault(int(number), Reader(data, first + int(offset)).value())

    def of(self, v: Any) -> Any:
        for _ in range(DEEPEST):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v[0])
        raise PdfError("PDF: references go in circles")

    def root(self) -> dict:
        root = self.of(self.trailer.get(b"Root"))
        if not isinstance(root, dict):
            root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get(b"Type") == b"Catalog"), None)
        if root is None:
            raise PdfError("PDF has no catalog")
        return root

    def pages(self) -> list[dict]:
        out, seen, todo = [], set(), [self.root().get(b"Pages")]
        while todo:
            v = todo.pop()
            node = self.of(v)
            if not isinstance(node, dict) or isinstance(v, Ref) and v in seen:
                continue
            seen.add(v if isinstance(v, Ref) else None)
            kids = self.of(node.get(b"Kids"))
            if isinstance(kids, list):
                todo += reversed(kids)
            else:
                out.append(node)
        return out

    def save(self) -> bytes:
        """Without document information and XMP metadata; of objects, what the catalog reaches, packed in object streams."""
        root = self.root()
        heads = [o.head if isinstance(o, Stream) else o for o in self.objects.values()]
        for h in [root, *(h for h in heads if isinstance(h, dict))]:
            h.pop(Name(b"Metadata"), None)
        root_ref = self.trailer.get(b"Root")
        if not isinstance(root_ref, Ref):
            root_ref = Ref((next(k for k, o in self.objects.items() if o is root), 0))
        reached: dict[int, None] = {}
        todo: list[Any] = [root_ref]
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                if v[0] in self.objects and v[0] not in reached:
                    reached[v[0]] = None
                    todo.append(self.objects[v[0]])
            elif isinstance(v, (dict, Stream)):
                todo += (v.head if isinstance(v, Stream) else v).values()
            elif isinstance(v, list):
                todo += v
        keep = sorted(reached)
        streams = [k for k in keep if isinstance(self.objects[k], Stream)]
        plain = [k for k in keep if not isinstance(self.objects[k], Stream)]
        out, where = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
        following = max(keep, default=0) + 1

        def put(number: int, head: dict, data: bytes) -> None:
            where[number] = (1, len(out), 0)
            out.extend(b"%d 0 obj\n" % number + written({**head, Name(b"Length"): Raw(b"%d" % len(data))}) + b"\nstream\n" + data + b"\nendstream\nendobj\n")

        for k in streams:
            s = self.objects[k]
            head = {n: v for n, v in s.head.items() if n != b"Length"}
            packed = zlib.compress(s.data, 9)
            if b"Filter" not in head and len(packed) < len(s.data):
                put(k, {**head, Name(b"Filter"): Name(b"FlateDecode")}, packed)
            else:
                put(k, head, s.data)
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            texts = [written(self.objects[k]) for k in part]
            places, at = [], 0
            for k, t in zip(part, texts, strict=True):
                places.append(b"%d %d" % (k, at))
                at += len(t) + 1
            index = b" ".join(places) + b"\n"
            number, following = following, following + 1
            put(number, {Name(b"Type"): Name(b"ObjStm"), Name(b"N"): Raw(b"%d" % len(part)), Name(b"First"): Raw(b"%d" % len(index)), Name(b"Filter"): Name(b"FlateDecode")}, zlib.compress(index + b"\n".join(texts), 9))
            where |= {k: (2, number, j) for j, k in enumerate(part)}
        start = len(out)
        where[following] = (1, start, 0)
        rows = b"".join(bytes([t]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for t, a, b in (where.get(k, (0, 0, 0)) for k in range(following + 1)))
        put(following, {Name(b"Type"): Name(b"XRef"), Name(b"Size"): Raw(b"%d" % (following + 1)), Name(b"W"): [Raw(b"1"), Raw(b"4"), Raw(b"2")], Name(b"Root"): root_ref, Name(b"Filter"): Name(b"FlateDecode")}, zlib.compress(rows, 9))
        return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def page_count(data: bytes) -> int:
    return len(Pdf(data).pages())


def shrink(data: bytes) -> tuple[bytes, float]:
    """The file saved anew, and the percentage saved, to one decimal."""
    out = Pdf(data).save()
    return out, round((len(data) - len(out)) / len(data) * 100 + 1e-12, 1) if data else 0.0


REPORT = T.StructType([T.StructField("pages", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("saved_pct", T.DoubleType()), T.StructField("error", T.StringType())])


def shrunk(content: Column) -> Column:
    """pages, content, saved_pct of PDF bytes; error where they can't be read. Null is null."""

    @F.pandas_udf(REPORT)
    def run(rows: pd.Series) -> pd.DataFrame:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return (None, None, None, None)
            try:
                out, saved = shrink(bytes(data))
                return (page_count(bytes(data)), out, saved, None)
            except ValueError as e:
                return (None, None, None, str(e))

        made = pd.DataFrame([one(d) for d in rows], columns=REPORT.names)
        return made.assign(pages=made.pages.astype("Int64"))

    return run(content)
