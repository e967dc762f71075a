"""Page archives (zip, tar) as a data source: read by ranges, several tasks to an archive; written as streams, all or none.

Reading: an archive is cut by its bytes as other splittable files are; a task
opens the directory of members (a zip's is at its end, a tar's headers stand before
each member) and reads those members that begin in its range.  So planning lists
files only, a large archive is many tasks' work, and no task holds more than a
member and a bounded batch.  Filters on names and archives are pushed down: what they drop isn't read.

Writing: rows come dealt out by archive and in order of names; entries are
streamed to a file under ``_temporary``, which gets its name when all tasks have ended well.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..operators.catalog import IMAGE_SUFFIXES

SCHEMA = "archive string, container string, member string, name string, index int, total_count long, length long, content binary"
#: Bytes of an archive that one task reads, and of small archives that one task takes together.
SPLIT = 64 << 20
#: Where smaller ranges would make more tasks than this, they grow, up to ``SPLIT``.
TASKS = 1024
HEAD = 520
#: Bytes read ahead of the place in an archive, and those gathered for a write.
AHEAD = 64 << 10
#: Rows and bytes of contents that go to Spark, or come from it, at once.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
ARROW = pa.schema([("archive", pa.string()), ("container", pa.string()), ("member", pa.string()), ("name", pa.string()), ("index", pa.int32()), ("total_count", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
TEMPORARY = "_temporary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there; an error for schemes it has no client for."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def reachable(path: str) -> bool:
    try:
        opened(path)[0].get_file_info(opened(path)[1])
    except (OSError, ValueError, ImportError):
        return False
    return True


@dataclass
class Split(InputPartition):
    """Byte ranges of archives; members that begin there are read."""

    parts: list[tuple[str, int, int]]


def container_of(head: bytes) -> str | None:
    """A readable kind by the first bytes: other kinds are left out."""
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "CBZ"
    return "TAR" if head[257:262] == b"ustar" else None


def members(file: io.RawIOBase, kind: str) -> Iterator[tuple[str, int, int, object, object]]:
    """Name, place, size, handle and entry of each file in an archive; contents aren't read."""
    if kind == "CBZ":
        z = zipfile.ZipFile(file)
        for i in z.infolist():
            if not i.is_dir():
                yield i.filename, i.header_offset, i.file_size, z, i
    else:
        t = tarfile.open(fileobj=file, mode="r:")
        for i in t:
            if i.isfile():
                yield i.name, i.offset, i.size, t, i


def content_of(file: io.RawIOBase, kind: str, handle: object, entry: object) -> bytes:
    """A member's content; one that is stored as it is needs no reader of its own."""
    if kind != "CBZ":
        return handle.extractfile(entry).read()
    if entry.compress_type == zipfile.ZIP_STORED and not entry.flag_bits & 1:
        file.seek(entry.header_offset)
        head = file.read(30)
        if len(head) == 30 and head[:4] == b"PK\x03\x04":
            flags, named, more = struct.unpack_from("<H", head, 6)[0], *struct.unpack_from("<HH", head, 26)
            name = file.read(named + more)[:named]
            data = file.read(entry.file_size)
            if name == entry.orig_filename.encode("utf-8" if flags & 0x800 else "cp437", "replace") and len(data) == entry.file_size and zlib.crc32(data) == entry.CRC:
                return data
    # compressed, or damaged: that is for the library to say
    return handle.read(entry)


def base_name(member: str) -> str:
    return member.rsplit("/", 1)[-1]


def is_image(name: str) -> bool:
    return "." in name and name.rsplit(".", 1)[-1].lower() in IMAGE_SUFFIXES


#: What each kind of filter says of a value.
TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}
PUSHED = ("archive", "member", "name")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.images = options.get("images", "true") == "true"
        self.content = options.get("content", "true") == "true"
        self.split = int(options.get("split", SPLIT))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, column: str, value: str) -> bool:
        return all(TESTS[type(f)](value, f) for f in self.filters if f.attribute[0] == column)

    def partitions(self) -> list[Split]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        listed = (f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f"/{TEMPORARY}/" not in f.path)
        kept = sorted((f for f in listed if self.wanted("archive", self.named(f.path))), key=lambda f: f.path)
        # each range of an archive reads its directory anew, and each task has a price
        split = max(self.split, min(SPLIT, -(-sum(f.size for f in kept) // TASKS)))
        out, group, size = [], [], 0
        for f in kept:
            if f.size > split:
                out += [Split([(f.path, a, min(a + split, f.size))]) for a in range(0, f.size, split)]
                continue
            if group and size + f.size > split:
                out.append(Split(group))
                group, size = [], 0
            group.append((f.path, 0, f.size))
            size += f.size
        return out + [Split(group)] if group or not out else out

    def named(self, path: str) -> str:
        """A path with its scheme, as Spark's own sources give it."""
        head = self.path.split("://", 1)[0] if "://" in self.path else "file"
        return f"{head}:{path}" if head == "file" else f"{head}://{path}"

    def read(self, partition: Split) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path, first, end in partition.parts:
            with fs.open_input_file(path) as raw, io.BufferedReader(raw, AHEAD) as file:
                yield from self.of_archive(file, self.named(path), first, end)

    def of_archive(self, file: io.RawIOBase, archive: str, first: int, end: int) -> Iterator[tuple]:
        kind = container_of(file.read(HEAD))
        if kind is None:
            return
        file.seek(0)
        listed = [m for m in members(file, kind) if not self.images or is_image(base_name(m[0]))]
        listed.sort(key=lambda m: (base_name(m[0]).encode("utf-8", "surrogatepass"), m[0]))
        for index, (member, at, size, handle, entry) in enumerate(listed):
            name = base_name(member)
            if first <= at < end and self.wanted("name", name) and self.wanted("member", member):
                data = content_of(file, kind, handle, entry) if self.content else None
                yield archive, kind, member, name, index, len(listed), size, data


class BatchReader(ArchiveReader):
    """The same rows in Arrow batches."""

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in super().read(partition):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.comment = options["path"], options.get("comment", "")
        self.method = zipfile.ZIP_DEFLATED if int(options.get("level", "0")) else zipfile.ZIP_STORED
        self.level = int(options.get("level", "0")) or None
        self.overwrite = overwrite
        if lacking := {"archive", "name", "content"} - set(columns):
            raise ValueError(f"columns are lacking: {sorted(lacking)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        folder = f"{root}/{TEMPORARY}/{self.job}"
        done, z, out, current = [], None, None, None
        try:
            for archive, name, content in _rows(iterator):
                if archive != current or not z:
                    if z:
                        z.close()
                        out.close()
                    current = archive
                    if not current or "/" in current or current in (".", ".."):
                        raise ValueError(f"not the name of an archive: {current!r}")
                    if not done:
                        fs.create_dir(folder, recursive=True)
                    at = f"{folder}/{uuid.uuid4().hex}"
                    out = io.BufferedWriter(_Stream(fs.open_output_stream(at)), AHEAD)
                    z = zipfile.ZipFile(out, "w", self.method, compresslevel=self.level)
                    z.comment = self.comment.encode()
                    done.append((current, at))
                if self.method == zipfile.ZIP_STORED:
                    _store(z, _entry(name, self.method), content)
                else:
                    z.writestr(_entry(name, self.method), content)
            if z:
                z.close()
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        made = [x for m in messages if m for x in m.archives]
        twice = len(made) - len({name for name, _ in made})
        if self.overwrite:
            there = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file]
            for f in there:
                fs.delete_file(f.path)
        if twice or any(f.is_file for f in fs.get_file_info([f"{root}/{name}" for name, _ in made])):
            self.abort(messages)
            raise ValueError("an archive of that name is there already" if not twice else "an archive's rows were in several tasks; deal them out by archive")
        fs.create_dir(root, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(x[1], f"{root}/{x[0]}"), made))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        at = f"{root}/{TEMPORARY}/{self.job}"
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)
        above = f"{root}/{TEMPORARY}"
        if fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


@dataclass
class Written(WriterCommitMessage):
    """Archives of a task, each with the file that holds it until the job has ended."""

    archives: list[tuple[str, str]]


def _entry(name: str, method: int) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name)
    info.compress_type = method
    info.external_attr = 0o600 << 16
    return info


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("archive", "name", "content")))


def _store(z: zipfile.ZipFile, info: zipfile.ZipInfo, data: bytes) -> None:
    """An entry as it is, its size and sum in the header before it; as ``ZipFile.mkdir`` adds one."""
    info.CRC, info.file_size, info.compress_size, info.header_offset = zlib.crc32(data), len(data), len(data), z.fp.tell()
    z.fp.write(info.FileHeader())
    z.fp.write(data)
    z.filelist.append(info)
    z.NameToInfo[info.filename] = info
    z.start_dir = z.fp.tell()


class _Stream(io.RawIOBase):
    """An output stream without places, as a file that zip entries can be written to one behind the other."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            super().close()
            self.out.close()


class Comics(DataSource):
    """Format ``comics``; options ``path``, to read ``images`` (else all members), ``content`` and ``split``, to write ``comment`` and ``level``."""

    @classmethod
    def name(cls) -> str:
        return "comics"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return BatchReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema.names, overwrite)
