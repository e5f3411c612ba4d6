"""Lines of .xz files: a data source that reads each compressed block in a task of its own.

An .xz file ends with an index of its blocks, so where they lie is known from
the last bytes. `spark.read.format("xz_lines")` makes a task of each block (or
of a run of them), decodes it piece by piece and gives the lines that start in
it; the last one may end in a later block. Files whose blocks are many, as the
parallel compressors make them, are thus read by many tasks; a file of a single
block is one task. Writing with the same format makes a file of many blocks in
each task.
"""

from __future__ import annotations

import fnmatch
import io
import lzma
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

# Fixed values of the format: marks at the start and end of a stream, sizes of header and footer.
STREAM_MARK, END_MARK = b"\xfd7zXZ\x00", b"YZ"
HEADER = FOOTER = 12
READ_BYTES = 1 << 18  # compressed bytes asked for at a time
TEXT_BYTES = 1 << 20  # decoded bytes worked on at a time
BATCH_BYTES = 4 << 20  # of lines in a record batch
BLOCK_BYTES = 8 << 20  # of lines in a written block
SCHEMA = "value string, source_file string"


@dataclass(frozen=True)
class Block:
    """A compressed block: where it lies, its bytes without padding, its decoded bytes, and the stream's flags."""

    offset: int
    packed: int
    size: int
    flags: bytes


def _padded(n: int) -> int:
    return -(-n // 4) * 4


def _little(n: int) -> bytes:
    return n.to_bytes(4, "little")


def _number(n: int) -> bytes:
    """A whole number in groups of seven bits, lowest first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] & 128:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return n | data[at] << shift, at + 1


def _header(flags: bytes) -> bytes:
    return STREAM_MARK + flags + _little(crc32(flags))


def _tail(flags: bytes, records: Sequence[tuple[int, int]]) -> bytes:
    """Index and footer of a stream with blocks of these (packed, decoded) sizes."""
    index = b"\0" + _number(len(records)) + b"".join(_number(a) + _number(b) for a, b in records)
    index = index.ljust(_padded(len(index)), b"\0")
    index += _little(crc32(index))
    end = _little(len(index) // 4 - 1) + flags
    return index + _little(crc32(end)) + end + END_MARK


def _broken(name: str, what: str) -> ValueError:
    return ValueError(f"{name}: {what}; the file is no finished .xz file")


def find_blocks(file, size: int, name: str = "") -> list[Block]:
    """All blocks of a file that can seek, from the indexes of its streams, last stream first."""

    def read(start: int, n: int) -> bytes:
        if start < 0:
            raise _broken(name, "a stream is cut off")
        file.seek(start)
        return file.read(n)

    found: list[Block] = []
    end = size
    while end > 0:
        footer = read(end - FOOTER, FOOTER)
        if footer[-4:] == b"\0\0\0\0" and end % 4 == 0:  # padding between streams
            end -= 4
            if not end:
                raise _broken(name, "there is no stream")
            continue
        if footer[-2:] != END_MARK or _little(crc32(footer[4:10])) != footer[:4]:
            raise _broken(name, "the end of a stream is missing")
        flags = footer[8:10]
        length = (int.from_bytes(footer[4:8], "little") + 1) * 4
        start = end - FOOTER - length
        index = read(start, length)
        if _little(crc32(index[:-4])) != index[-4:] or index[0]:
            raise _broken(name, "an index is damaged")
        records, at = _read_number(index, 1)
        sizes = []
        for _ in range(records):
            packed, at = _read_number(index, at)
            plain, at = _read_number(index, at)
            sizes.append((packed, plain))
        first = start - sum(_padded(packed) for packed, _ in sizes)
        if read(first - HEADER, HEADER) != _header(flags):
            raise _broken(name, "the start of a stream is missing")
        own = []
        for packed, plain in sizes:
            own.append(Block(first, packed, plain, flags))
            first += _padded(packed)
        found[:0] = own
        end = start - sum(_padded(packed) for packed, _ in sizes) - HEADER
    return found


def decoded(file, block: Block) -> Iterator[bytes]:
    """The text of one block in pieces, checked: the block is read as a stream of its own."""
    decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)

    def parts():
        yield _header(block.flags)
        at, left = block.offset, _padded(block.packed)
        while left:
            file.seek(at)
            part = file.read(min(READ_BYTES, left))
            if not part:
                raise ValueError("an .xz block is cut off")
            yield part
            at, left = at + len(part), left - len(part)
        yield _tail(block.flags, [(block.packed, block.size)])

    for part in parts():
        out = decoder.decompress(part, TEXT_BYTES)
        while out or not (decoder.needs_input or decoder.eof):
            if out:
                yield out
            out = b"" if decoder.eof or decoder.needs_input else decoder.decompress(b"", TEXT_BYTES)


def lines_of(file, blocks: list[Block], first: int, last: int) -> Iterator[list[bytes]]:
    """Lines that start in the blocks from `first` up to, without, `last`.

    A line that starts exactly at a border of blocks belongs to the block
    before it, so a task skips what comes before its first line break and goes
    on after its own blocks up to the next one.
    """
    rest, skipping = b"", first > 0
    for block in blocks[first:last]:
        for text in decoded(file, block):
            if skipping:
                _, found, text = text.partition(b"\n")
                if not found:
                    continue
                skipping = False
            rest += text
            if b"\n" in text:
                *done, rest = rest.split(b"\n")
                yield done
    if skipping:
        return
    for block in blocks[last:]:
        for text in decoded(file, block):
            end, found, _ = text.partition(b"\n")
            rest += end
            if found:
                yield [rest]
                return
    if rest:
        yield [rest]


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local or a URI) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def xz_files(path: str) -> list[str]:
    """The file itself, the .xz files of a folder, or those whose last name matches a pattern, in order."""
    files, own = store(path)
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    folder, _, pattern = own.rstrip("/").rpartition("/")
    if not any(c in pattern for c in "*?["):
        info = files.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [head + own]
        folder, pattern = own.rstrip("/"), "*.xz"
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = [f.path for f in found if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
    return [head + name for name in sorted(names)]


@dataclass
class Run(InputPartition):
    """Blocks `first` up to `last` of a file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class XzReader(DataSourceReader):
    def __init__(self, paths: list[str], task_bytes: int):
        self.paths, self.task_bytes = paths, task_bytes

    def partitions(self) -> list[Run]:
        runs = []
        for path in self.paths:
            files, own = store(path)
            with files.open_input_file(own) as file:
                blocks = find_blocks(file, file.size(), path)
            first, held = 0, 0
            for i, block in enumerate(blocks):
                held += block.size
                if held >= self.task_bytes or i + 1 == len(blocks):
                    runs.append(Run(path, first, i + 1))
                    first, held = i + 1, 0
        return runs

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without any block has one empty partition
            return
        files, own = store(partition.path)
        name = own.rpartition("/")[2]

        def batch(lines: list[bytes]) -> pa.RecordBatch:
            texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
            values = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays([values, pa.array([name] * len(texts), pa.string())], ["value", "source_file"])

        with files.open_input_file(own) as file:
            blocks = find_blocks(file, file.size(), partition.path)
            held, size = [], 0
            for lines in lines_of(file, blocks, partition.first, partition.last):
                held += lines
                size += sum(map(len, lines))
                if size > BATCH_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class XzWriter(DataSourceArrowWriter):
    """One file for each task, moved into place when all tasks have ended."""

    def __init__(self, path: str, block_bytes: int, overwrite: bool):
        self.path, self.block_bytes, self.overwrite = path.rstrip("/"), block_bytes, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = store(self.path)
        name, records, flags, out = f"part-{uuid.uuid4().hex}.xz", [], b"", None

        def block(lines: list[bytes]):
            nonlocal flags, out
            text = b"\n".join(lines) + b"\n"
            stream = lzma.compress(text, lzma.FORMAT_XZ, lzma.CHECK_CRC64)
            (own,) = find_blocks(io.BytesIO(stream), len(stream))
            if out is None:
                files.create_dir(f"{folder}/{self.job}", recursive=True)
                out, flags = files.open_output_stream(f"{folder}/{self.job}/{name}"), own.flags
                out.write(_header(flags))
            out.write(stream[own.offset : own.offset + _padded(own.packed)])
            records.append((own.packed, own.size))

        held, size = [], 0
        for batch in iterator:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(line or b"")
                size += len(held[-1]) + 1
                if size >= self.block_bytes:
                    block(held)
                    held, size = [], 0
        if held:
            block(held)
        if out is None:
            return Written(None)
        out.write(_tail(flags, records))
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = store(self.path)
        files.create_dir(folder, recursive=True)
        old = xz_files(self.path) if self.overwrite else []
        for message in messages:
            if message is not None and message.name:
                files.move(f"{folder}/{self.job}/{message.name}", f"{folder}/{message.name}")
        for path in old:
            files.delete_file(store(path)[1])
        self._clear(files, folder)
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


class XzLines(DataSource):
    """Options: `path`, or `paths` with one to a line; `task_bytes`, text that a task reads at least if a file
    has as much (default: one block); `block_bytes`, lines of a written block."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XzReader:
        paths = self.options["paths"].split("\n") if "paths" in self.options else [self.options["path"]]
        return XzReader([f for p in paths for f in xz_files(p)], int(self.options.get("task_bytes", 0)))

    def writer(self, schema, overwrite: bool) -> XzWriter:
        return XzWriter(self.options["path"], int(self.options.get("block_bytes", BLOCK_BYTES)), overwrite)


def read_xz_lines(spark: SparkSession, paths: Sequence[str], task_bytes: int = 0) -> DataFrame:
    """(value, source_file): all lines of .xz files, folders or patterns of names; one task a block by default."""
    spark.dataSource.register(XzLines)
    return spark.read.format("xz_lines").option("paths", "\n".join(paths)).option("task_bytes", task_bytes).load()


def write_xz_lines(lines: DataFrame, path: str, mode: str = "append", block_bytes: int = BLOCK_BYTES) -> None:
    """Write the first column, a string, as .xz files of many blocks, one file for each task that has rows."""
    lines.sparkSession.dataSource.register(XzLines)
    lines.write.format("xz_lines").mode(mode).option("block_bytes", block_bytes).save(path)
