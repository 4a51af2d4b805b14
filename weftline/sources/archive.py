"""zip, tar, tar.gz and gzip: making and reading them within limits, and as table functions.

Reading never trusts a declared size: bytes are counted as they are inflated.
"""

from __future__ import annotations

import io
import posixpath
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("zip", "gzip", "tar", "tar.gz")
MIME = {"zip": "application/zip", "gzip": "application/gzip", "tar": "application/x-tar", "tar.gz": "application/gzip"}
MAX_BYTES, MAX_ENTRIES, MAX_TEXT = 20_000_000, 2_000, 100_000


class ArchiveError(ValueError):
    pass


@dataclass
class Entry:
    """A file: its bytes and its time in ms since the epoch, or None."""

    name: str
    data: bytes
    mtime: int | None = None

    @property
    def text(self) -> tuple[str | None, bool]:
        """The data as text if it looks like one, at most MAX_TEXT characters; whether that cut it."""
        try:
            s = self.data.decode("utf-8")
        except UnicodeDecodeError:
            return None, False
        if any(c < " " and c not in "\t\n\r" or c in "\x7f�" for c in s):
            return None, False
        return s[:MAX_TEXT], len(s) > MAX_TEXT


class Budget:
    """Bytes and entries that may still come out of an archive."""

    def __init__(self) -> None:
        self.bytes, self.entries = MAX_BYTES, MAX_ENTRIES

    def entry(self) -> None:
        self.entries -= 1
        if self.entries < 0:
            raise ArchiveError(f"archive holds more than {MAX_ENTRIES} entries")

    def take(self, n: int) -> None:
        self.bytes -= n
        if self.bytes < 0:
            raise ArchiveError(f"archive unpacks to more than {MAX_BYTES} bytes")

    def inflate(self, data: bytes, window: int) -> bytes:
        """zlib data in pieces, counted. Raises on corrupt or cut data."""
        d, out = zlib.decompressobj(window), []
        rest = data
        try:
            while rest and not d.eof:
                out.append(d.decompress(rest, 1 << 16))
                self.take(len(out[-1]))
                rest = d.unconsumed_tail
            out.append(d.flush())
            self.take(len(out[-1]))
        except zlib.error as e:
            raise ArchiveError(f"corrupt data: {e}") from e
        if not d.eof:
            raise ArchiveError("data ends early")
        return b"".join(out)


def safe_path(root: str, name: str) -> str:
    """Where an entry may be written: below root, or not at all."""
    if not name or name.startswith(("/", "\\")) or len(name) > 1 and name[1] == ":":
        raise ArchiveError(f"unsafe entry name: {name!r}")
    path = posixpath.normpath(posixpath.join(root, name.replace("\\", "/")))
    if path != root and not path.startswith(root.rstrip("/") + "/"):
        raise ArchiveError(f"entry name leaves the target: {name!r}")
    return path


def check_entries(entries: list[Entry]) -> None:
    names = [e.name for e in entries]
    if not entries or len(entries) > MAX_ENTRIES:
        raise ArchiveError(f"an archive takes 1 to {MAX_ENTRIES} files")
    if "" in names or "__proto__" in names or len(set(names)) < len(names):
        raise ArchiveError("names must be given, allowed and different")
    if sum(len(e.data) for e in entries) > MAX_BYTES:
        raise ArchiveError(f"files hold more than {MAX_BYTES} bytes")


# ---------- gzip ----------


def gzip_create(data: bytes, mtime: int = 0, name: str | None = None) -> bytes:
    """mtime in ms. Equal input gives equal bytes."""
    if mtime < 0:
        raise ArchiveError("time is negative")
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 8 if name else 0, mtime // 1000, 0, 3) + (name.encode("latin-1", "replace") + b"\0" if name else b"")
    return head + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_extract(raw: bytes, budget: Budget | None = None) -> Entry:
    if raw[:3] != b"\x1f\x8b\x08" or len(raw) < 18:
        raise ArchiveError("not gzip data")
    flags, seconds = raw[3], struct.unpack_from("<I", raw, 4)[0]
    at, name = 10, "data"
    if flags & 4:
        at += 2 + struct.unpack_from("<H", raw, at)[0]
    if flags & 8:
        end = raw.index(b"\0", at)
        name = raw[at:end].decode("latin-1")
    return Entry(name, (budget or Budget()).inflate(raw, 31), seconds * 1000 or None)


# ---------- zip ----------

EPOCH_1980 = (1980, 1, 1, 0, 0, 0)


def zip_create(entries: list[Entry]) -> bytes:
    check_entries(entries)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for e in entries:
            when = EPOCH_1980 if e.mtime is None else time.gmtime(e.mtime / 1000)[:6]
            if not 1980 <= when[0] <= 2099:
                raise ArchiveError("a zip file's years are 1980 to 2099")
            z.writestr(zipfile.ZipInfo(e.name, when), e.data, zipfile.ZIP_DEFLATED, 6)
    return out.getvalue()


def dos_time(day: tuple) -> int | None:
    """ms of a directory's date and time (UTC); the zero date is none."""
    import calendar

    if day[1] == 0 or day[2] == 0:
        return None
    return calendar.timegm((*day, 0, 0, 0)) * 1000


def zip_extract(raw: bytes) -> list[Entry]:
    budget, out = Budget(), []
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = z.infolist()
        for info in infos:
            budget.entry()
        for info in infos:
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
                raise ArchiveError(f"{info.filename}: unsupported compression or encryption")
            parts = []
            with z.open(info) as f:
                while piece := f.read(1 << 16):
                    budget.take(len(piece))
                    parts.append(piece)
            out.append(Entry(info.filename, b"".join(parts), dos_time(info.date_time)))
    except (zipfile.BadZipFile, zlib.error, EOFError, struct.error, NotImplementedError, OSError) as e:
        raise ArchiveError(f"corrupt zip: {e}") from e
    return out


# ---------- tar ----------

BLOCK = 512


def tar_header(name: str, size: int, mtime: int | None) -> bytes:
    raw = name.encode()
    if len(raw) > 100:
        raise ArchiveError(f"name is longer than 100 bytes: {name}")
    if mtime is not None and mtime < 0:
        raise ArchiveError("time is negative")
    fields = (raw, b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"%011o\0" % ((mtime or 0) // 1000), b" " * 8, b"0", b"", b"ustar\x0000")
    head = struct.pack("100s8s8s8s12s12s8s1s100s8s247x", *fields)
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def tar_create(entries: list[Entry]) -> bytes:
    check_entries(entries)
    padded = lambda d: d + b"\0" * (-len(d) % BLOCK)
    return b"".join(tar_header(e.name, len(e.data), e.mtime) + padded(e.data) for e in entries) + b"\0" * (2 * BLOCK)


def tar_number(raw: bytes) -> int:
    """Octal text, or base 256 (two's complement) where the first bit is set."""
    if raw[0] & 0x80:
        value = int.from_bytes(raw, "big") & ~(1 << (8 * len(raw) - 1))
        return value - (1 << (8 * len(raw) - 1)) if raw[0] & 0x40 else value
    text = raw.split(b"\0")[0].strip()
    try:
        return int(text, 8) if text else 0
    except ValueError as e:
        raise ArchiveError("tar: bad number") from e


def pax_records(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        space = data.find(b" ", at)
        size = data[at:space]
        if space < 0 or not size.isdigit() or int(size) <= space + 1 - at or at + int(size) > len(data):
            raise ArchiveError("tar: bad extended header")
        key, _, value = data[space + 1 : at + int(size) - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        at += int(size)
    return out


def tar_extract(raw: bytes) -> tuple[list[Entry], list[tuple[str, str]]]:
    """Regular files, and the names and type flags of what else there is."""
    budget, out, skipped = Budget(), [], []
    at, long_name, own, common = 0, None, {}, {}
    while at + BLOCK <= len(raw):
        head = raw[at : at + BLOCK]
        if not any(head):
            break
        total = sum(head) - sum(head[148:156]) + 8 * 32
        if tar_number(head[148:156]) != total:
            raise ArchiveError("tar: checksum doesn't fit")
        budget.entry()
        size, flag = tar_number(head[124:136]), chr(head[156] or 48)
        if size < 0 or at + BLOCK + size > len(raw):
            raise ArchiveError("tar: an entry goes beyond the end")
        data = raw[at + BLOCK : at + BLOCK + size]
        at += BLOCK + size + -size % BLOCK
        cstring = lambda a, b: head[a:b].split(b"\0")[0].decode("utf-8", "replace")  # noqa: B023, E731
        if flag in "LKxg":
            budget.take(size)
            if flag == "L":
                long_name = data.split(b"\0")[0].decode("utf-8", "replace")
            elif flag == "x":
                own = pax_records(data)
            elif flag == "g":
                common |= pax_records(data)
            continue
        prefix = cstring(345, 500) if head[257:262] == b"ustar" else ""
        name = long_name or own.get("path") or common.get("path") or (f"{prefix}/{cstring(0, 100)}" if prefix else cstring(0, 100))
        sparse = flag == "S" or any(k.startswith("GNU.sparse") for k in own)
        if flag in "07" and not sparse:
            budget.take(size)
            out.append(Entry(name, data, tar_number(head[136:148]) * 1000))
        else:
            skipped.append((name, "S" if sparse else flag))
        long_name, own = None, {}
    return out, skipped


# ---------- any ----------


def create(kind: str, entries: list[Entry]) -> bytes:
    if kind == "gzip":
        if len(entries) != 1:
            raise ArchiveError("gzip takes exactly 1 file")
        return gzip_create(entries[0].data, entries[0].mtime or 0, entries[0].name)
    if kind == "zip":
        return zip_create(entries)
    if kind in ("tar", "tar.gz"):
        return tar_create(entries) if kind == "tar" else gzip_create(tar_create(entries))
    raise ArchiveError(f"unknown archive format: {kind}")


def extract(kind: str, raw: bytes) -> tuple[list[Entry], list[tuple[str, str]]]:
    if kind == "zip":
        return zip_extract(raw), []
    if kind == "gzip":
        return [gzip_extract(raw)], []
    if kind in ("tar", "tar.gz"):
        return tar_extract(raw if kind == "tar" else gzip_extract(raw).data)
    raise ArchiveError(f"unknown archive format: {kind}")


def pack(rows: DataFrame, bundle: str, kind: str, name: str = "name", content: str = "content", mtime: str | None = None) -> DataFrame:
    """bundle, archive, type, files: one archive for each bundle, its files in order of name. An archive's limits bound
    what of a bundle meets in one task; a bundle above them is an error."""
    schema = T.StructType([T.StructField("bundle", rows.schema[bundle].dataType), T.StructField("archive", T.BinaryType()), T.StructField("type", T.StringType()), T.StructField("files", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name")
        entries = [Entry(n, bytes(d), None if pd.isna(m) else int(m)) for n, d, m in zip(group["name"], group["content"], group["mtime"], strict=True)]
        return pd.DataFrame([(group["bundle"].iloc[0], create(kind, entries), MIME[kind], len(entries))], columns=["bundle", "archive", "type", "files"])

    when = F.lit(None).cast("long") if mtime is None else F.col(mtime).cast("long")
    return rows.select(F.col(bundle).alias("bundle"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), when.alias("mtime")).groupBy("bundle").applyInPandas(run, schema)


ENTRY = "name string, bytes long, text string, truncated boolean, data binary, mtime long, skipped string, error string"


def unpack(rows: DataFrame, kind: str, archive: str = "archive", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and a row for each entry. What is no regular file has its type flag in skipped; an archive that can't be
    read gives one row with its error. For files, see weftline.sources.files."""
    schema = T.StructType([rows.schema[k] for k in keep] + list(T._parse_datatype_string(ENTRY)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[Any, ...]] = []
            for row in frame.itertuples(index=False):
                own = tuple(row[:-1])
                try:
                    entries, skipped = extract(kind, bytes(row[-1]))
                    out += [(*own, e.name, len(e.data), *e.text, e.data, e.mtime, None, None) for e in entries]
                    out += [(*own, n, 0, None, False, None, None, flag, None) for n, flag in skipped]
                except ArchiveError as e:
                    out.append((*own, None, None, None, None, None, None, None, str(e)))
            made = pd.DataFrame(out, columns=schema.names)
            for c in ("bytes", "mtime"):
                made[c] = made[c].astype("Int64")
            yield made

    return rows.select(*keep, archive).mapInPandas(run, schema)
