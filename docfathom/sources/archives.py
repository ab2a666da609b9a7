"""Checks of uploaded archives: members, sizes, names and checksums, read from binary files in Arrow batches."""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds of an archive, and the one file it must hold.
MOST_MEMBERS, MOST_MEMBER, MOST_TOTAL, NEEDED = 1000, 10 << 20, 50 << 20, "SKILL.md"


def archive_issue(data: bytes | None) -> str | None:
    """Why an archive is refused, or None. Nothing is unpacked beyond its stated size."""
    if not data:
        return "empty"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = z.infolist()
            if len(members) > MOST_MEMBERS:
                return "too many members"
            if sum(m.file_size for m in members) > MOST_TOTAL:
                return "too large"
            names = set()
            for m in members:
                parts = m.filename.rstrip("/").split("/")
                if m.filename.startswith("/") or "\\" in m.filename or any(p in ("", ".", "..") for p in parts) or any(ord(c) < 32 for c in m.filename):
                    return "unsafe name"
                if m.filename in names:
                    return "repeated name"
                names.add(m.filename)
                if m.flag_bits & 1:
                    return "encrypted"
                if stat.S_ISLNK(m.external_attr >> 16):
                    return "link"
                if m.file_size > MOST_MEMBER:
                    return "member too large"
                if not m.is_dir():
                    with z.open(m) as f:  # reading to the end checks the sum
                        left = m.file_size
                        while chunk := f.read(1 << 16):
                            left -= len(chunk)
                            if left < 0:
                                return "wrong size"
            found = [m for m in members if m.filename.rsplit("/", 1)[-1] == NEEDED]
            if len(found) != 1 or not found[0].file_size:
                return f"needs one {NEEDED}"
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, ValueError):
        return "broken"
    return None


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([archive_issue(x) for x in batch.column(1).to_pylist()], pa.string())], names=["path", "issue"])


def inspect_archives(files: DataFrame) -> DataFrame:
    """(path, issue) of a ``binaryFile`` table; a null issue means the archive is sound."""
    return files.select("path", "content").mapInArrow(_inspect, "path string, issue string")


def image_kind(data: bytes | None) -> str | None:
    """png, jpeg or webp by the first bytes, else None."""
    head = bytes(data or b"")[:12]
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if head.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    return "webp" if head[:4] == b"RIFF" and head[8:] == b"WEBP" else None
