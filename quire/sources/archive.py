"""ZIP archives read within limits, so that no small file can unpack to a huge one."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ArchiveError(ValueError):
    """code: entry_too_large, archive_too_large, too_many_entries, ratio_too_high, missing_entry, not_utf8 or not_an_archive."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    entry_bytes: int = 100 << 20
    total_bytes: int = 500 << 20
    entries: int = 10_000
    ratio: int | None = 100


#: Word and Excel files are bounded by their sizes alone, as in the reference: repeated text packs well.
BY_SIZE = Limits(ratio=None)


_ENTRY, _HEAD = "<4s6H3L5H2L", "<4s5H3L2H"


@dataclass(slots=True)
class Entry:
    file_size: int
    compress_size: int
    method: int
    crc: int
    at: int
    end: int
    name: bytes


def directory(content: bytes) -> tuple[list[str], dict[str, Entry]] | None:
    """The names and entries of an archive of the plainest kind, as most are: nothing before, between or after its
    parts, no comments, extra fields, ciphers or 64-bit sizes. None for all others, which zipfile reads."""
    last = len(content) - 22
    if last < 0 or content[last : last + 4] != b"PK\5\6":
        return None
    disk, first, here, n, size, start, comment = struct.unpack_from("<4H2LH", content, last + 4)
    if disk or first or comment or here != n or start + size != last:
        return None
    names, entries, at, before = [], {}, start, None
    for _ in range(n):
        if at + 46 > last:
            return None
        mark, _, needs, flags, method, _, _, crc, packed, whole, named, extra, said, _, _, _, place = struct.unpack_from(_ENTRY, content, at)
        raw = content[at + 46 : at + 46 + named]
        at += 46 + named
        if mark != b"PK\1\2" or needs > 20 or flags or method not in (0, 8) or extra or said or max(packed, whole, place) == 0xFFFFFFFF or not raw.isascii() or b"\0" in raw:
            return None
        if before is not None:
            before.end = place
        if before is not None and before.at >= place or before is None and place:
            return None
        before = Entry(whole, packed, method, crc, place, start, raw)
        name = raw.decode()
        names.append(name)
        entries[name] = before
    return (names, entries) if at == last else None


class Archive:
    """An archive; bytes_read and entries_read count what was taken from it."""

    def __init__(self, content: bytes, limits: Limits = Limits()):
        self.content, self.limits, self.bytes_read, self.entries_read = content, limits, 0, 0
        found = directory(content)
        if found is None:
            found = self.zip.namelist(), self.zip.NameToInfo
        self._names, self._entries = found
        if len(self._names) > limits.entries:
            raise ArchiveError("too_many_entries", str(len(self._names)))

    @cached_property
    def zip(self) -> zipfile.ZipFile:
        try:
            return zipfile.ZipFile(io.BytesIO(self.content))
        except zipfile.BadZipFile as e:
            raise ArchiveError("not_an_archive", str(e)) from e

    def names(self) -> list[str]:
        return self._names

    def has(self, name: str) -> bool:
        return name in self._entries

    def _plain(self, e: Entry) -> bytes | None:
        """An entry's bytes, or None where anything is out of order, for zipfile to say what."""
        if e.at + 30 > e.end:
            return None
        mark, _, flags, method, _, _, _, _, _, named, extra = struct.unpack_from(_HEAD, self.content, e.at)
        start = e.at + 30 + named + extra
        if mark != b"PK\3\4" or flags or method != e.method or self.content[e.at + 30 : e.at + 30 + named] != e.name or start + e.compress_size > e.end:
            return None
        out = self.content[start : start + e.compress_size]
        if method == 8:
            z = zlib.decompressobj(-15)
            try:
                out = z.decompress(out, self.limits.entry_bytes + 1)
            except zlib.error:
                return None
            if not z.eof or z.unused_data:
                return None
        return out if len(out) == e.file_size and zlib.crc32(out) == e.crc else None

    def read(self, name: str) -> bytes:
        """An entry's bytes; what the directory says of its size is checked first, what comes out after that."""
        info = self._entries.get(name)
        if info is None:
            raise ArchiveError("missing_entry", name)
        lim = self.limits
        if info.file_size > lim.entry_bytes:
            raise ArchiveError("entry_too_large", name)
        if lim.ratio is not None and info.compress_size and info.file_size / info.compress_size > lim.ratio:
            raise ArchiveError("ratio_too_high", name)
        if self.bytes_read + info.file_size > lim.total_bytes:
            raise ArchiveError("archive_too_large", name)
        out = self._plain(info) if isinstance(info, Entry) else None
        if out is None:
            with self.zip.open(name) as f:
                out = f.read(lim.entry_bytes + 1)
        if len(out) > lim.entry_bytes:
            raise ArchiveError("entry_too_large", name)
        self.bytes_read += len(out)
        self.entries_read += 1
        if self.entries_read > lim.entries:
            raise ArchiveError("too_many_entries", name)
        return out

    def text(self, name: str) -> str:
        try:
            return self.read(name).decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise ArchiveError("not_utf8", name) from e


def audit(entries: DataFrame, key: str = "archive", order: str = "entry_idx", limits: Limits = Limits()) -> DataFrame:
    """entries (key, order, bytes, packed) with running totals and the limit that reading each would break, or null."""
    w = Window.partitionBy(key).orderBy(order)
    out = entries.withColumns({"total": F.sum("bytes").over(w), "nth": F.row_number().over(w)})
    broken = (
        F.when(F.col("nth") > limits.entries, "too_many_entries")
        .when(F.col("bytes") > limits.entry_bytes, "entry_too_large")
        .when((F.col("packed") > 0) & (F.col("bytes") / F.col("packed") > limits.ratio), "ratio_too_high")
        .when(F.col("total") > limits.total_bytes, "archive_too_large")
    )
    return out.withColumn("broken", broken)
